"""Review queues: signals, priorities, snapshots, freezing, edit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvelo.functions.text import let, organisation_keys
from corvelo.functions.vocabulary import MULTINATIONALS
from corvelo.operators.checks import violations
from corvelo.operators.indicators import distinct_codes
from corvelo.schemas import QUEUE

STATUSES = ("unreviewed", "pass", "fail", "defer")
PRIORITIES = {"high": 1, "medium": 2, "low": 3}


def system_signal(openalex_id: Column, affiliations: Column, method: Column) -> tuple[Column, Column, Column]:
    """(signal, priority, reason) of a reconciled record: the first case that holds."""
    held = F.coalesce(affiliations, F.array())
    placed = lambda a: F.coalesce(a["country_code"], F.lit("")) != ""
    keyed = F.arrays_zip(organisation_keys(F.transform(held, lambda a: a["institution_name"])).alias("k"), held.alias("a"))

    def unplaced(keyed: Column) -> Column:
        resolved = F.transform(F.filter(keyed, lambda x: placed(x["a"])), lambda x: x["k"])
        open_ = F.filter(keyed, lambda x: ~placed(x["a"]) & x["k"].isin(MULTINATIONALS) & ~F.array_contains(resolved, x["k"]))
        return F.array_sort(F.array_distinct(F.transform(open_, lambda x: x["a"]["institution_name"])))

    branches = let(keyed, unplaced)
    mixed = F.contains(F.coalesce(method, F.lit("")), F.lit("fallback")) | F.contains(F.coalesce(method, F.lit("")), F.lit("pdf-ner"))
    # Signals, priorities and reasons.
    cases = [
        (F.size(held) == 0, "unreconciled", "high", F.lit("No affiliation was resolved")),
        (~F.exists(held, placed), "country_missing", "high", F.lit("Affiliations exist but no country was resolved")),
        (F.size(branches) > 0, "ambiguous_multinational_branch", "high", F.concat(F.lit("Branch location is unresolved for: "), F.array_join(branches, ", "))),
        (F.coalesce(openalex_id, F.lit("")) == "", "fallback_only", "medium", F.lit("Country evidence comes only from PDF/ROR fallback")),
        (mixed, "mixed_sources", "medium", F.lit("OpenAlex work and fallback affiliations are combined")),
        (F.lit(True), "automatic_pass", "low", F.lit("Automatic match has country-bearing affiliations")),
    ]
    first = lambda place: F.coalesce(*(F.when(c[0], c[place] if place == 3 else F.lit(c[place])) for c in cases))
    return first(1), first(2), first(3)


def review_queue(reconciled: DataFrame) -> DataFrame:
    """Queue rows of reconciled records, most urgent first, in the fixed column order."""
    signal, priority, reason = system_signal(F.col("openalex_id"), F.col("affiliations"), F.col("match_method"))
    p = lambda c: F.coalesce(F.col(f"paper.{c}"), F.lit(""))
    blank = F.lit("")
    rows = reconciled.select(
        F.concat_ws(":", p("venue_key"), p("paper_id")).alias("review_id"), p("venue_key").alias("venue"), p("paper_id").alias("paper_id"), p("track").alias("track"), p("title").alias("title"),
        F.coalesce(F.array_join("paper.authors", " | "), blank).alias("authors"), p("official_url").alias("official_url"), p("pdf_url").alias("pdf_url"), F.coalesce("openalex_id", blank).alias("openalex_id"), F.coalesce("match_method", blank).alias("match_method"),
        F.to_json("affiliations").alias("affiliations_json"), signal.alias("system_signal"), priority.alias("priority"), reason.alias("priority_reason"), F.lit("unreviewed").alias("review_status"), blank.alias("confidence"), blank.alias("failure_codes"), blank.alias("review_note"), F.lit("no").alias("add_to_regression"),
    )
    rank = F.element_at(F.create_map(*[x for k, v in PRIORITIES.items() for x in (F.lit(k), F.lit(v))]), F.col("priority"))
    return rows.select(*QUEUE).orderBy(rank, "venue", "paper_id")


def status_snapshot(queue: DataFrame, status: str, domain: tuple[str, ...]) -> DataFrame:
    """Counts over a fixed domain of statuses, zero where there is none."""
    known = queue.sparkSession.createDataFrame([(s,) for s in domain], f"{status} string")
    return F.broadcast(known).join(queue.groupBy(status).agg(F.count(F.lit(1)).alias("n")), status, "left").fillna(0, ["n"])


def freeze_manifest(queue: DataFrame) -> DataFrame:
    """One row: counts of pass, fail and defer, and a hash over the sorted ids and statuses."""
    one = lambda s: F.coalesce(F.sum((F.col("review_status") == s).cast("int")), F.lit(0))
    line = F.sha2(F.concat_ws("|", "review_id", "review_status"), 256)
    digest = F.sum(F.conv(F.substring(line, 1, 12), 16, 10).cast("decimal(20,0)")).cast("string")  # independent of row order
    return queue.agg(one("pass").alias("passed"), one("fail").alias("failed"), one("defer").alias("deferred"), F.count(F.lit(1)).alias("n"), F.sha2(F.coalesce(digest, F.lit("")), 256).alias("digest"))


def edit_violations() -> Column:
    """What keeps a review edit (review_status, confidence, failure_codes, review_note) from being stored."""
    status = F.col("review_status")
    return violations(
        known_status=status.isin(*STATUSES),
        fail_needs_code=(status != "fail") | (F.length("failure_codes") > 0),
        defer_needs_note=(status != "defer") | (F.length("review_note") > 0),
        decision_needs_confidence=(status == "unreviewed") | F.col("confidence").isin("low", "medium", "high"),
    )


def expectations(queue: DataFrame) -> DataFrame:
    """Expected countries per reviewed record: from the note where it failed, else from its affiliations."""
    from corvelo.functions.text import noted_countries

    held = F.from_json("affiliations_json", "array<struct<institution_id:string,institution_name:string,country_code:string,institution_type:string>>")
    given = distinct_codes(F.transform(held, lambda a: a["country_code"]))
    return queue.where(F.col("review_status").isin("pass", "fail")).select("review_id", F.when(F.col("review_status") == "fail", noted_countries(F.col("review_note"))).otherwise(given).alias("expected_countries"), "review_status")
