"""The pN_ queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvelo.session import cut_lineage, shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def _text_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The three text fields of problem 1 as rows (field, seq, pos, value)."""
    titles = table(spark, folder, "paper").select(F.lit("title").alias("field"), "seq", F.lit(0).alias("pos"), F.col("title").alias("value"))
    names = (
        table(spark, folder, "reconciled")
        .select("seq", F.posexplode("affiliations.institution_name").alias("pos", "value"))
        .select(F.lit("institution_name").alias("field"), "seq", "pos", "value")
    )
    portuguese = table(spark, folder, "translation_eval_segments").select(F.lit("portuguese").alias("field"), "seq", F.lit(0).alias("pos"), F.col("portuguese").alias("value"))
    return titles.unionByName(names).unionByName(portuguese)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.unify import find_disguised

    return find_disguised(_text_fields(spark, folder)).select("field", "seq", "pos")


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.unify import unified

    return unified(_text_fields(spark, folder)).select("field", "seq", "pos", "unified")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.variants import attribute_organisations, attribute_people

    source = lambda p: F.concat_ws("|", f"{p}venue_key", F.coalesce(F.when(F.col(f"{p}paper_id") != "", F.col(f"{p}paper_id")), F.col(f"{p}title")))
    held = table(spark, folder, "reconciled").select("seq", source("paper.").alias("source"), F.posexplode("affiliations").alias("pos", "a"))
    held = held.select("seq", "source", "pos", F.col("a.institution_name").alias("name"), F.nullif("a.country_code", F.lit("")).alias("country"), F.nullif("a.institution_id", F.lit("")).alias("entity_id"))
    found = cut_lineage(attribute_organisations(held)).select("name", F.col("country").alias("home"), F.col("entity_id").alias("found"))
    open_ = held.where("entity_id IS NULL").join(found, "name").where(F.col("country").eqNullSafe(F.col("home")))
    organisations = open_.select(F.lit("institution_name").alias("field"), "seq", "pos", F.col("found").alias("entity_id"))
    written = table(spark, folder, "paper").select("seq", source("").alias("source"), F.posexplode("authors").alias("pos", "name"))
    profiles = table(spark, folder, "author_profile").select(F.col("profile_id").alias("entity_id"), F.col("preferred_name").alias("preferred"))
    people = written.join(cut_lineage(attribute_people(written, profiles)).select("name", "entity_id"), "name")
    people = people.join(profiles.distinct(), "entity_id").where(F.col("name") != F.col("preferred"))
    return organisations.unionByName(people.select(F.lit("authors").alias("field"), "seq", "pos", "entity_id")).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.pairwise import rank_models

    return rank_models(table(spark, folder, "translation_eval_pairwise_decisions")).select("direction", "rank_no", "model")


def _links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Confidences of all pairs of papers and works, and the papers that hold a link already."""
    from corvelo.llm.linkage import link_papers

    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    fields = [F.struct(blank("venue_key").alias("venue_key"), blank("paper_id").alias("paper_id")).alias("paper_key"), F.col("title"), F.col("authors").alias("names"), "doi", "year", F.col("venue_key").alias("venue")]
    keyed = (blank("venue_key").isNotNull()) & (blank("paper_id").isNotNull())
    papers = table(spark, folder, "paper").where(keyed).select(*fields)
    reconciled = table(spark, folder, "reconciled")
    held = reconciled.select("paper.*", "openalex_id").where(keyed & F.col("openalex_id").isNotNull() & (F.col("openalex_id") != ""))
    known = held.select(fields[0], F.col("openalex_id").alias("work_id")).distinct()
    works = table(spark, folder, "openalex_work").select(F.col("openalex_id").alias("work_id"), "title", F.col("author_names").alias("names"), "doi", F.col("publication_year").alias("year"), F.col("source_name").alias("venue"))
    return link_papers(papers, works, known), known.select("paper_key").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    links, held = _links(spark, folder)
    return links.where("confidence >= 0.5").join(held, "paper_key", "left_anti").select("paper_key.venue_key", "paper_key.paper_id", F.col("work_id").alias("openalex_id")).distinct()


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The members after two runs that share a ledger: over the rows that came first, then over all."""
    from corvelo.llm.sample import halving_rates, paper_key, update_ledger

    papers = table(spark, folder, "paper").select(paper_key().alias("key"), F.col("batch_no").alias("epoch"), "seq")
    ledger = shared_path(spark, "ledger")
    half = (papers.agg(F.max("seq")).first()[0] or 0) / 2
    update_ledger(papers.where(F.col("seq") <= half), ledger, halving_rates())
    return update_ledger(papers, ledger, halving_rates()).where("chosen").select("key", "first_epoch", "rate", "draw")


P5_SAMPLE_SQL = """
WITH keyed AS (
  SELECT coalesce('id|' || coalesce(nullif(trim(venue_key), ''), '') || '|' || nullif(trim(paper_id), ''),
                  'title|' || nullif(regexp_replace(title, '^ +| +$', '', 'g'), '')) AS key, coalesce(batch_no, 0) AS epoch, seq
  FROM paper),
first AS (SELECT key, arg_min(epoch, seq) AS first_epoch FROM keyed WHERE key IS NOT NULL GROUP BY key),
drawn AS (
  SELECT key, first_epoch, 0.2 / pow(2.0, floor(first_epoch / 12.0)) AS rate,
         CAST('0x' || substr(sha256('sample|0|' || key), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM first)
SELECT key, first_epoch, rate, draw FROM drawn WHERE draw < rate
"""


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.align import align_passages

    review = table(spark, folder, "translation_eval_alignment_review")
    passages = table(spark, folder, "translation_benchmark_passages").join(review.select("pair_id"), "pair_id", "left_anti")
    return align_passages(passages, review.select("english", "portuguese", "alignment_type", "review_status"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.packing import pack_texts, token_counter

    return pack_texts(table(spark, folder, "documents"), token_counter(spark)(F.col("text")))


def p7_unused(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.packing import unused_space

    return unused_space(p7_containers(spark, folder), 2048)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.leaks import find_leaks

    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.llm.subjects import assign_subjects

    labels = table(spark, folder, "subject_label")
    found = assign_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_area"), labels)
    return found.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "subject").distinct()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_unified, p2_found, p3_found, p4_found, p5_sample, p6_found, p7_containers, p7_unused, p8_found, p9_found)}


def oracle_sql() -> dict[str, str]:
    return {"p5_sample": P5_SAMPLE_SQL}
