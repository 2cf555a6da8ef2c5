"""Affiliations in front matter: the region, candidate lines, countries, search queries, review targets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from corvelo.functions import vocabulary as V
from corvelo.functions.text import country_codes, single_country
from corvelo.operators.checks import require_covered
from corvelo.operators.records import merge_affiliations

_BROKEN = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")
_CORRESPONDENCE, _END, _KEYWORD, _NUMBERED = (re.compile(p) for p in (V.CORRESPONDENCE, V.FRONT_MATTER_END, "(?i)" + V.AFFILIATION_KEYWORDS, V.NUMBERED_LINE))
_MARK = re.compile(r"(?<!\d)\d+(?=\s*[A-Z])")
_EDGE = " ,;*†‡0123456789"


def plain_key(text: str) -> str:
    """Lower-case ASCII letters and digits of a text, single spaces between."""
    return re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()).strip()


def region(text: str, lines_before: int = 40, fallback: int = 15) -> str:
    """The part of front matter that lists affiliations. Of the `lines_before` lines before a correspondence
    note, those from the first numbered line that names an organisation, or the last `fallback` lines where
    there is none; without a note, what stands before the abstract or introduction."""
    text = _BROKEN.sub("", text or "")
    note = _CORRESPONDENCE.search(text)
    if not note:
        return _END.split(text, maxsplit=1)[0]
    lines = text[: note.start()].splitlines()
    numbered = lambda line: _NUMBERED.search(line) and _KEYWORD.search(re.sub(r"(?<=\d)(?=[A-Za-z])", " ", line))
    start = next((k for k in range(max(0, len(lines) - lines_before), len(lines)) if numbered(lines[k])), max(0, len(lines) - fallback))
    return "\n".join(lines[start:])


def numbered_parts(line: str) -> list[str]:
    """The parts of a line such as `1Org A 2Org B`, without their numbers; none where there are no numbers."""
    line = " ".join(line.split())
    marks = list(_MARK.finditer(line))
    return [line[m.end() : n].strip(" ,;*0123456789") for m, n in zip(marks, [m.start() for m in marks[1:]] + [len(line)])]


def candidates(text: str, known: Collection[str] = (), shortest: int = 4, longest: int = 300) -> list[str]:
    """Distinct affiliations of a region: parts of numbered lines that name an organisation by a keyword or a
    known key (`known`), then whole lines by a keyword. Where there are none, the short lines before the
    abstract that hold a known key. Publishers are left out."""
    holds = lambda part: any(f" {k} " in f" {plain_key(part)} " for k in known)
    lines = [" ".join(line.split()) for line in region(text).splitlines()]
    parts = [(p, _KEYWORD.search(p) or holds(p)) for line in lines for p in numbered_parts(line)]
    parts += [(p, _KEYWORD.search(p)) for line in lines for p in [line.strip(_EDGE)]]
    fit = [p for p, ok in parts if shortest <= len(p) <= longest and ok and not any(e in plain_key(p) for e in V.NON_AUTHOR_ORGANIZATIONS)]
    if not fit:
        before = re.split(r"(?im)^\s*abstract\s*$", text or "", maxsplit=1)[0]
        fit = [p for line in before.splitlines() for p in [" ".join(line.split()).strip(_EDGE)] if shortest <= len(p) <= 180 and holds(p)]
    return list(dict.fromkeys(fit))


@pandas_udf(StringType())
def affiliation_region(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: region(t) if t is not None else None)


@pandas_udf(ArrayType(StringType()))
def candidate_lines(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: candidates(t) if t is not None else [])


def augment_countries(frame: DataFrame, text: str, method: str | None = None) -> DataFrame:
    """Adds an affiliation for each country that the front matter names and no affiliation has, merged with
    those there are, a diagnostic of the outcome, and `method` to match_method if given. A null text adds
    the diagnostic only."""
    held = F.coalesce("affiliations", F.array())
    blank = F.lit(None).cast("string")
    codes = country_codes(affiliation_region(F.col(text)))
    known = F.coalesce(F.transform(held, lambda a: a["country_code"]), F.array())
    # The added affiliation's name, the diagnostic's stage and outcomes.
    name = lambda c: F.concat(F.lit("Country explicitly stated in PDF affiliation block ("), c, F.lit(")"))
    extra = F.transform(F.array_except(codes, known), lambda c: F.struct(F.lit("").alias("institution_id"), name(c).alias("institution_name"), c.alias("country_code"), blank.alias("institution_type")))
    outcome = F.when(F.col(text).isNull(), "not_available").when(F.size(codes) > 0, "success").otherwise("unresolved")
    note = F.struct(F.lit("pdf_country_census").alias("stage"), outcome.alias("outcome"), F.when(F.col(text).isNull(), "No official PDF URL").otherwise(F.array_join(codes, ",")).alias("detail"))
    changed = {"affiliations": merge_affiliations(F.concat(held, F.when(F.col(text).isNull(), F.slice(extra, 1, 0)).otherwise(extra))), "diagnostics": F.concat(F.coalesce("diagnostics", F.array()), F.array(note))}
    if method:
        changed["match_method"] = F.concat_ws("+", F.nullif("match_method", F.lit("")), F.lit(method))
    return frame.withColumns(changed)


def resolved_country(name: Column, registry_country: Column) -> Column:
    """The one country a name mentions, else that of the registry."""
    return F.coalesce(single_country(country_codes(name)), registry_country)


def search_queries(author: Column, organisation: Column, year: Column) -> Column:
    """The queries put to a search service about an author's affiliation."""
    return F.array(F.format_string('"%s" "%s" affiliation', author, organisation), F.format_string('"%s" "%s" %d', author, organisation, year), F.format_string('"%s" site:orcid.org', author))


def valid_request(author: Column, organisation: Column, day: Column, results: Column) -> Column:
    return (F.length(F.trim(author)) > 0) & (F.length(F.trim(organisation)) > 0) & day.rlike(r"^\d{4}-\d{2}-\d{2}$") & results.between(1, 20)


def review_targets(queue: DataFrame, papers: DataFrame, order: str) -> DataFrame:
    """The source papers of failed reviews, in queue order: the later source wins, empty authors come from
    the queue; raises where a paper is missing."""
    failed = queue.where(F.col("review_status") == "fail").select("venue", "paper_id", F.col("authors").alias("_authors"), "queue_seq")
    last = papers.groupBy(F.col("venue_key").alias("venue"), "paper_id").agg(F.max_by(F.struct(*papers.columns), order).alias("p"))
    require_covered(failed.select("venue", "paper_id"), last, ["venue", "paper_id"])
    names = F.filter(F.split("_authors", r"\s*\|\s*"), lambda a: a != "")
    joined = failed.join(last, ["venue", "paper_id"])
    return joined.select("queue_seq", F.col("p").withField("authors", F.when(F.size("p.authors") > 0, F.col("p.authors")).otherwise(names)).alias("p")).select("queue_seq", "p.*").orderBy("queue_seq")
