"""Scalar text functions as column expressions; Arrow UDFs only where the JVM has no equivalent."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from corvelo.functions import vocabulary as V
from corvelo.functions.vocabulary import ABBREVIATIONS, COUNTRY_ALIASES


def _per_value(values: pd.Series, change) -> pd.Series:
    known = {v: change(v) for v in values.dropna().unique()}
    return values.map(lambda v: known.get(v))


@pandas_udf(StringType())
def unescape(values: pd.Series) -> pd.Series:
    """HTML entities, named and numeric, as characters."""
    return _per_value(values, html.unescape)


@pandas_udf(StringType())
def strip_marks(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return _per_value(values, lambda v: v if v.isascii() else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


@pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return _per_value(values, str.casefold)


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(text: Column) -> Column:
    """White space of any kind as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_space(text: Column) -> Column:
    return collapse(unescape(text))


def reduce_key(text: Column) -> Column:
    """Lower-case letters and digits of ASCII, everything else a single space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def title_key(title: Column) -> Column:
    """The comparison key of a title: unescaped, without marks, lower case, alphanumeric words."""
    return reduce_key(strip_marks(unescape(title)))


def organisation_key(name: Column) -> Column:
    """The comparison key of an affiliation, without leading contribution notes."""
    return F.trim(F.regexp_replace(casefold(strip_marks(F.regexp_replace(name, V.LEADING_NOTE, ""))), "[^a-z0-9]+", " "))


@pandas_udf(ArrayType(StringType()))
def organisation_keys(names: pd.Series) -> pd.Series:
    """`organisation_key` of every entry of an array; "" for null."""
    note, known = re.compile(V.LEADING_NOTE), {None: ""}

    def key(name: str | None) -> str:
        if name not in known:
            bare = unicodedata.normalize("NFKD", note.sub("", name))
            known[name] = re.sub("[^a-z0-9]+", " ", "".join(c for c in bare if not unicodedata.combining(c)).casefold()).strip()
        return known[name]

    return names.map(lambda entries: [key(n) for n in entries] if entries is not None else [])


def compact_key(text: Column) -> Column:
    """LaTeX commands reduced to their argument, then letters and digits only."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\\[A-Za-z]+\{([^{}]*)\}", "$1"), "[^A-Za-z0-9]+", ""))


def word_list(text: Column) -> Column:
    """ASCII words of a text without marks, in order."""
    return F.regexp_extract_all(F.lower(strip_marks(text)), F.lit("([a-z0-9]+)"), 1)


def split_authors(text: Column) -> Column:
    """Names of a list separated by comma, semicolon or the word and."""
    parts = F.split(text, r"\s*(?:[,;]|\band\b)\s*")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]+>", " "))


def split_list(text: Column, separator: str) -> Column:
    """Entries of a delimited string, trimmed, blanks dropped; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def number(text: Column) -> Column:
    """A number with thousands commas; null where there is none."""
    return F.regexp_replace(text, r"[,\s]", "").try_cast("double")


def iso_date(text: Column) -> Column:
    """A full ISO date; partial and invalid ones give null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


# Fixed value: a sentence ends before white space and a capital letter, opening marks aside.
SENTENCE_END = r"(?<=[.!?])\s+(?=[\"'“”‘’(]*[A-ZÁÀÂÃÉÊÍÓÔÕÚÜÇ])"


def split_sentences(text: Column) -> Column:
    """Sentences that end in . ! or ? before a capital letter, not after an abbreviation or in a decimal."""
    held = text
    for short in ABBREVIATIONS:
        held = F.replace(held, F.lit(short), F.lit(short.replace(".", "\u0001")))
    held = F.regexp_replace(held, r"(\d)\.(?=\d)", "$1\u0001")
    parts = F.split(held, SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def country_codes(text: Column) -> Column:
    """Sorted codes of the countries a text names as whole words; words broken over lines are joined, and
    campuses that bear another territory's name count where they are."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    joined = F.regexp_replace(joined, r"(?U)\s+", " ")
    for pattern, name in V.CAMPUSES:
        joined = F.regexp_replace(joined, pattern, name)
    shown = {"US": "US", "GB": "UK"}  # in capitals

    def codes(t: Column) -> Column:
        tests = []
        for code, names in COUNTRY_ALIASES.items():
            named = t.rlike(r"(?iU)(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)")
            if code in shown:
                named = named | t.rlike(rf"(?<![A-Z]){shown[code]}(?![A-Z])")
            tests.append(F.when(named, F.lit(code)))
        return F.array_sort(F.array_compact(F.array(*tests)))

    return let(joined, codes)


def single_country(codes: Column) -> Column:
    """The only code of an array; null for none or several."""
    return F.when(F.size(codes) == 1, F.element_at(codes, 1))


def noted_countries(note: Column) -> Column:
    """Codes in a reviewer's note: its first line of expected countries, or the whole note where there is
    none, up to a remark on the pipeline; names, and the ISO codes of the alias table in capitals; UK
    counts as GB."""
    note = F.coalesce(note, F.lit(""))
    said = F.coalesce(F.nullif(F.regexp_extract(note, V.EXPECTED_COUNTRIES, 1), F.lit("")), note)
    said = F.split(said, V.PIPELINE_REMARK, 2)[0]
    capitals = F.transform(F.regexp_extract_all(said, F.lit(r"(?<![A-Z])([A-Z]{2})(?![A-Z])"), 1), lambda c: F.when(c == "UK", "GB").otherwise(c))
    return F.array_sort(F.array_union(country_codes(said), F.array_intersect(capitals, F.array(*map(F.lit, COUNTRY_ALIASES)))))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces; none for a shorter list."""

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, each).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def plain_tokens(text: Column) -> Column:
    """Words and single punctuation marks of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+|[^\w\s])"), 1)


def windows(items: Column, longest: int) -> Column:
    """All runs of 1 to `longest` neighbouring entries, joined by spaces."""
    return F.concat(*(ngrams(items, n) for n in range(1, longest + 1)))


def abstract_part(text: Column) -> Column:
    """A text in single spaces; where an abstract heading stands in its first 1,200 characters, what follows
    it up to the heading of the introduction."""

    def part(t: Column) -> Column:
        after = F.regexp_extract(F.substring(t, 1, 1200), r"(?is)^(.*?" + V.ABSTRACT_HEADING.removeprefix("(?i)") + ")", 1)
        return F.when(after != "", F.split(F.substr(t, F.length(after) + 1), V.INTRODUCTION_HEADING, 2)[0]).otherwise(t)

    return let(collapse(F.coalesce(text, F.lit(""))), part)


def evidence_units(title: Column, abstract: Column) -> Column:
    """The title, then the sentences of the abstract, in lower case; a blank title stays as unit 0."""
    sentences = F.filter(F.transform(F.split(F.lower(abstract_part(abstract)), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.concat(F.array(F.trim(F.lower(F.coalesce(title, F.lit(""))))), sentences)


def screen(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the dimensions whose pattern a text matches, in order of the table."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items())))


def classify_units(units: Column, patterns: dict[str, tuple[str, str | None, str | None]]) -> Column:
    """Dimensions found in a text's units. A unit is evidence where it matches the first pattern, or, as the title (unit
    0), the second, and does not match the third when read after the title."""

    def found(u: Column, anywhere: str, in_title: str | None, exclude: str | None) -> Column:
        def hit(unit: Column, i: Column) -> Column:
            match = unit.rlike(anywhere) | ((i == 0) & unit.rlike(in_title)) if in_title else unit.rlike(anywhere)
            return match & ~F.concat(u[0], F.lit(". "), unit).rlike(exclude) if exclude else match

        return F.exists(F.transform(u, hit), lambda x: x)

    plain = F.transform(units, lambda unit: F.regexp_replace(unit, V.NO_EVIDENCE, ""))
    return let(plain, lambda u: F.array_compact(F.array(*(F.when(found(u, *p), F.lit(name)) for name, p in patterns.items()))))


def lexically_supported(name: Column, text: Column, generic: list[str] = V.GENERIC_WORDS, least: int = 2) -> Column:
    """Whether a key occurs whole in a text key, or shares `least` words that are not generic; blank keys
    support nothing."""
    shared = F.array_intersect(F.array_except(F.split(name, " "), F.array(*map(F.lit, generic))), F.split(text, " "))
    return (F.length(name) > 0) & (F.length(text) > 0) & (_holds(text, name) | (F.size(shared) >= least))


def _holds(text: Column, words: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


def text_supports(name: Column, text: Column, generic: list[str] = V.GENERIC_WORDS, ambiguous: list[str] = V.AMBIGUOUS_NAMES, least: int = 2, share: float = 0.6) -> Column:
    """Whether a text key holds a name key, a leading article aside, or `least` of its distinctive words and
    `share` of them; ambiguous bare names and blank keys are never supported."""
    own = F.array_except(F.split(name, " "), F.array(*map(F.lit, generic)))
    shared = F.size(F.array_intersect(own, F.split(text, " ")))
    known = (F.length(name) > 0) & (F.length(text) > 0) & ~name.isin(ambiguous)
    return known & (_holds(text, F.regexp_replace(name, "^the ", "")) | ((shared >= least) & (shared >= share * F.size(own))))


def mentions_all(words: Column, text_words: Column, ignored: list[str] = V.ENTITY_IGNORED) -> Column:
    """Whether every telling word of an entity, one at least, occurs in a text."""
    return let(F.array_except(words, F.array(*map(F.lit, ignored))), lambda own: (F.size(own) > 0) & (F.size(F.array_except(own, text_words)) == 0))


def frontmatter(text: Column, key: str) -> Column:
    """The value of a front-matter key, without quotes; null where absent."""
    found = F.regexp_extract(text, rf"(?m)^[ \t]*{key}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit(""))


def strip_markdown(text: Column) -> Column:
    """Prose of a Markdown block: no images, links by their text, no emphasis, list and quote marks."""
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^#{1,6}\s+", ""), (r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", "$1"), ("<[^>]+>", " ")):
        text = F.regexp_replace(text, pattern, by)
    return collapse(text)


def prose_blocks(text: Column) -> Column:
    """Prose blocks of a Markdown text: fenced code dropped, headings apart, blocks at blank lines."""
    no_code = F.regexp_replace(text, r"(?ms)^\s*(`{3,}|~{3,}).*?(?:^\s*\1\s*$|\z)", "\n\n")
    apart = F.regexp_replace(no_code, r"(?m)^(#{1,6}\s+.*)$", "\n\n$1\n\n")
    return F.filter(F.transform(F.split(apart, r"\n\s*\n"), strip_markdown), lambda b: b != "")


def balanced_fences(text: Column) -> Column:
    """Whether code fences and div blocks of a document close."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return (count(r"(?m)^\s*```") % 2 == 0) & (count(r"(?m)^\s*:::+\s*\{?[\w.]") == count(r"(?m)^\s*:::+\s*$"))


def heading_levels(text: Column) -> Column:
    """Levels of the headings of a Markdown text outside code."""
    no_code = F.regexp_replace(text, r"(?ms)^\s*```.*?^\s*```\s*$", "")
    return F.transform(F.regexp_extract_all(no_code, F.lit(r"(?m)^(#{1,6})\s"), 1), lambda h: F.length(h))


PROTECTED = r"(`[^`\n]+`|\$[^$\n]+\$|https?://[^\s)>\]]+|<[^>\n]+>)"


def protect(text: Column) -> Column:
    """(masked, kept): code, mathematics, links and tags replaced by numbered marks, and what they were."""
    kept = F.regexp_extract_all(text, F.lit(PROTECTED), 1)
    pieces = F.split(text, PROTECTED, -1)
    marked = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("⟦"), (i - 1).cast("string"), F.lit("⟧"), p)))
    return F.struct(F.array_join(marked, "").alias("masked"), kept.alias("kept"))


def restore(masked: Column, kept: Column) -> Column:
    """The text with the marks of `protect` replaced by what they stood for."""
    return F.aggregate(F.transform(kept, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), masked, lambda text, x: F.replace(text, F.concat(F.lit("⟦"), x["i"].cast("string"), F.lit("⟧")), x["k"]))


def reviewed_text(reviewed: Column, original: Column) -> Column:
    """The reviewed text unless blank, else the original, trimmed."""
    return F.coalesce(F.nullif(F.trim(reviewed), F.lit("")), F.trim(original))


def transition_score(similarity: Column, left_lines: Column, right_lines: Column, left_chars: Column, right_chars: Column, merge: float = 0.08, length: float = 0.08) -> Column:
    """Similarity less penalties for merged lines and for unequal lengths."""
    return similarity - merge * (left_lines + right_lines - 2) - length * F.abs(F.log((left_chars + 1) / (right_chars + 1)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def canonical_json(*columns: str) -> Column:
    """JSON of columns in order of name, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
