"""Record matching: exact, aliased, fuzzy, contained; the reconciliation ladder with its trail."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from corvelo.functions import text as T
from corvelo.session import cut_lineage, drop_cut


@pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters of two keys over their length (matching blocks, junk heuristics off
    for keys this short)."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=len(y or "") >= 200).ratio() for x, y in zip(a, b)], dtype="float64")


def blocked_pairs(left: DataFrame, right: DataFrame, key: str, blocks: list[Column], least: float) -> DataFrame:
    """Pairs of keys (_l, _r, similarity) that share one of the blocking expressions on `key` and reach `least`."""

    def blocked(rows: DataFrame, into: str) -> DataFrame:
        keyed = rows.select(F.col(key).alias(into), F.explode(F.array_distinct(F.array(*blocks))).alias("_block"))
        return keyed.where(F.col("_block").isNotNull() & (F.col("_block") != ""))

    pairs = blocked(left, "_l").join(blocked(right, "_r"), "_block").drop("_block").distinct()
    pairs = pairs.where(F.least(F.length("_l"), F.length("_r")) * 2 / (F.length("_l") + F.length("_r")) >= least)  # no ratio can be higher
    return pairs.withColumn("similarity", matching_ratio("_l", "_r")).where(F.col("similarity") >= least)


def near_letters(left: list[str], right: list[str], most: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of keys whose letters' counts (by code modulo 64) differ by `most` in all. Keys of a side
    are of one length.

    A bit tells whether a letter is there more than so many times, so the bits that two keys differ in are no more
    than their counts' difference: the 64 bits that part the keys best rule most pairs out, 64 more
    most of the others, and the counts themselves decide.
    """

    def counts(keys) -> np.ndarray:
        codes = np.frombuffer("".join(keys).encode("utf-32-le"), dtype="<u4").reshape(len(keys), -1) % 64
        at = np.arange(len(keys))[:, None] * 64 + codes
        return np.bincount(at.ravel(), minlength=64 * len(keys)).reshape(len(keys), 64).astype("int32")

    a, b = counts(left), counts(right)
    some = np.concatenate([a[:: max(1, len(a) // 32)], b[:: max(1, len(b) // 32)]])
    share = (some[:, :, None] > np.arange(16)).mean(axis=0).ravel()
    best = np.argsort(-share * (1 - share), kind="stable")[:128]
    bits = lambda c: np.ascontiguousarray(np.packbits(c[:, best // 16] > best % 16, axis=1)).view("uint64")
    u, v = bits(a), bits(b)
    x, y = np.divmod(np.flatnonzero(np.bitwise_count(u[:, 0][:, None] ^ v[:, 0][None, :]) <= min(int(most), 64)), len(right))
    held = np.bitwise_count(u[x] ^ v[y]).sum(axis=1, dtype="int32") <= most
    x, y = x[held], y[held]
    held = np.abs(a[x] - b[y]).sum(axis=1) <= most
    return x[held], y[held]


def similar_pairs(left: DataFrame, right: DataFrame, key: str, least: float, size: int = 500) -> DataFrame:
    """All pairs of keys (_l, _r, similarity) that reach `least`.

    Matching blocks are a common subsequence, so at most `1 - least` of the letters of both keys are to be
    deleted or inserted. That bounds the lengths, the difference of the letters' counts and the edit
    distance; only these bounds are used before the ratio, so no pair is lost. Keys are compared in packs
    of one length with `size` keys at most on average.
    """
    slack = f"{1 - least + 1e-9!r}D"
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * left.sparkSession.sparkContext.defaultParallelism)

    def packs(rows: DataFrame, n: str, into: str) -> DataFrame:
        keys = rows.where(F.length(key) > 0).select(F.col(key).alias("k")).distinct().withColumn(n, F.length("k"))
        parts = keys.groupBy(n).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
        return keys.join(parts, n).groupBy(n, F.pmod(F.xxhash64("k"), F.col("parts")).alias("part")).agg(F.collect_list("k").alias(into)).drop("part")

    l, r = packs(left, "_n", "_ls"), packs(right, "_m", "_rs")
    # |n - m| <= slack * (n + m), as a join on the length
    reach = F.sequence(F.ceil(F.expr(f"_n * (1 - {slack}) / (1 + {slack})")), F.floor(F.expr(f"_n * (1 + {slack}) / (1 - {slack})")))
    l = l.withColumn("_m", F.explode(reach.cast("array<int>")))
    packed = l.repartition(tasks, "_m").join(r.repartition(tasks, "_m"), "_m").select("_ls", "_rs")

    def near(frames):
        for frame in frames:
            for ls, rs in zip(frame["_ls"], frame["_rs"]):
                x, y = near_letters(ls, rs, (1 - least) * (len(ls[0]) + len(rs[0])) + 1e-6)
                yield pd.DataFrame({"_l": [ls[i] for i in x], "_r": [rs[j] for j in y]}, dtype="object")

    pairs = packed.mapInPandas(near, "_l string, _r string").where(F.expr(f"levenshtein(_l, _r, CAST(FLOOR({slack} * (length(_l) + length(_r))) AS INT)) >= 0"))
    return pairs.withColumn("similarity", matching_ratio("_l", "_r")).where(F.col("similarity") >= least)


def best_first(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Of pairs (left_id, right_id, similarity) the highest similarity first, no row used twice; ties go to
    the lower ids. Pairs that are each other's best are taken in rounds until none is left."""
    rest, taken = cut_lineage(pairs), None
    first = F.min(F.struct((-F.col("similarity")).alias("_o"), left_id, right_id)).alias("b")
    while not rest.isEmpty():
        of_left, of_right = (rest.groupBy(F.col(i).alias("_i")).agg(first).select(f"b.{left_id}", f"b.{right_id}") for i in (left_id, right_id))
        now = cut_lineage(rest.join(of_left, [left_id, right_id]).join(of_right, [left_id, right_id]))
        taken = now if taken is None else taken.unionByName(now)
        left_over = cut_lineage(rest.join(now, left_id, "left_anti").join(now, right_id, "left_anti"))
        drop_cut(rest)
        rest = left_over
    return rest if taken is None else taken


def exact_then_fuzzy(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, blocks: list[Column] | None = None, least: float = 0.92, aliases: DataFrame | None = None) -> DataFrame:
    """One-to-one matches (left_id, right_id, method, similarity): equal keys that are unique on the right,
    then aliases (left_id, right_id), then the best fuzzy pairs among rows still unmatched, the highest
    similarity first, no row used twice. Without `blocks` every pair that reaches `least` is found."""
    alone = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(right_id).alias(right_id)).where("_n = 1").drop("_n")
    exact = left.select(left_id, key).join(alone, key).groupBy(right_id).agg(F.min(left_id).alias(left_id)).select(left_id, right_id, F.lit("exact").alias("method"), F.lit(1.0).alias("similarity"))
    if aliases is not None:
        named = aliases.join(exact, left_id, "left_anti").join(exact, right_id, "left_anti").select(left_id, right_id, F.lit("alias").alias("method"), F.lit(1.0).alias("similarity"))
        exact = exact.unionByName(named)
    l, r = left.join(exact, left_id, "left_anti"), right.join(exact, right_id, "left_anti")
    pairs = similar_pairs(l, r, key, least) if blocks is None else blocked_pairs(l, r, key, blocks, least)
    ids = pairs.join(l.select(left_id, F.col(key).alias("_l")), "_l").join(r.select(right_id, F.col(key).alias("_r")), "_r").select(left_id, right_id, "similarity")
    return exact.unionByName(best_first(ids, left_id, right_id).select(left_id, right_id, F.lit("fuzzy").alias("method"), "similarity"))


def containment_match(texts: DataFrame, text_id: str, key: str, aliases: DataFrame, alias: str, entity: str) -> DataFrame:
    """The longest alias found as whole words in each text key (text_id, entity, alias). Aliases are found
    by their rarest word, an equi-join, and then checked whole."""
    words = texts.select(text_id, key, F.explode(F.array_distinct(F.split(key, " "))).alias("_w"))
    # of an alias's words the one that the fewest texts hold, so that no common word brings all texts together
    held = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    each = aliases.where(F.length(alias) > 0).select(alias, entity, F.explode(F.array_distinct(F.split(alias, " "))).alias("_w")).join(held, "_w", "left")
    firsts = each.groupBy(alias, entity).agg(F.min_by("_w", F.struct(F.coalesce("_n", F.lit(0)), "_w")).alias("_w"))
    inside = F.contains(F.concat(F.lit(" "), F.col(key), F.lit(" ")), F.concat(F.lit(" "), F.col(alias), F.lit(" ")))
    found = words.join(firsts, "_w").where(inside)
    return found.groupBy(text_id).agg(F.max_by(F.struct(entity, alias), F.struct(F.length(alias), alias, entity)).alias("b")).select(text_id, "b.*")


def unique_alias(names: DataFrame, name: str, aliases: DataFrame, alias: str, entity: str, least_words: int = 2) -> DataFrame:
    """Names that equal an alias of exactly one entity, with `least_words` words at least."""
    alone = aliases.groupBy(F.col(alias).alias(name)).agg(F.count_distinct(entity).alias("_k"), F.min(entity).alias(entity)).where("_k = 1").drop("_k")
    return names.where(F.size(F.split(name, " ")) >= least_words).join(alone, name)


def branch_affiliations(rows: DataFrame, registries: list[tuple[list[str], DataFrame]]) -> DataFrame:
    """Affiliations from several small registries, each joined on its own columns; repeats dropped."""
    found = None
    for keys, registry in registries:
        part = rows.join(registry, keys).select(*rows.columns, *[c for c in registry.columns if c not in rows.columns])
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def bridge(papers: DataFrame, link: str, people: DataFrame, person: str, names: str, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Papers over their people to resolved institutions, one row per `keys`."""
    each = papers.select("*", F.explode(link).alias(person)).join(people.select(person, F.explode(names).alias("institution_name")), person)
    return each.join(resolved, "institution_name").dropDuplicates(keys)


def registry_affiliation(record: Column) -> Column:
    """(institution_id, institution_name, country_code, institution_type) of a registry record with names
    (value, types), locations (country_code) and types: display name or first, first location, first type."""
    display = F.filter(record["names"], lambda n: F.array_contains(n["types"], "ror_display"))
    name = F.coalesce(F.get(display, F.lit(0))["value"], F.get(record["names"], F.lit(0))["value"])
    return F.struct(F.coalesce(record["id"], F.lit("")).alias("institution_id"), name.alias("institution_name"), F.get(record["locations"], F.lit(0))["country_code"].alias("country_code"), F.get(record["types"], F.lit(0)).alias("institution_type"))


def work_affiliations(works: DataFrame, key: str, authorships: str) -> DataFrame:
    """Distinct institutions of a work's authorships (institutions: id, display_name, country_code, type),
    by id or by name and country; the last value counts at the first place."""
    each = works.select(key, F.posexplode(F.flatten(F.transform(authorships, lambda a: F.coalesce(a["institutions"], F.array())))).alias("position", "i"))
    by = F.coalesce(F.nullif(F.col("i.id"), F.lit("")), F.concat_ws("|", F.coalesce("i.display_name", F.lit("")), F.coalesce("i.country_code", F.lit(""))))
    return each.groupBy(key, by.alias("institution_key")).agg(F.max_by("i", "position").alias("institution"), F.min("position").alias("position"))


def reconcile(papers: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The ladder DOI, then title of similarity 0.95, then fallback, as one ranking of the union of candidate
    rows (key, stage, openalex_id, similarity, affiliations), with the trail of stages tried."""
    place = F.when(F.col("stage") == "doi", 1).when((F.col("stage") == "title") & (F.col("similarity") >= 0.95), 2).when(F.col("stage") == "fallback", 3)
    usable = candidates.withColumn("_place", place)
    trail = usable.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.coalesce("_place", F.lit(9)).alias("at"), F.col("stage"), F.when(F.col("_place").isNull(), "below_threshold").otherwise("matched").alias("outcome")))).alias("diagnostics"))
    best = usable.where(F.col("_place").isNotNull()).groupBy(key).agg(F.min_by(F.struct("openalex_id", F.col("stage").alias("match_method"), "affiliations"), F.struct("_place", -F.coalesce("similarity", F.lit(0.0)), "openalex_id")).alias("b"))
    return papers.join(best, key, "left").join(trail, key, "left").select(papers["*"], "b.openalex_id", "b.match_method", "b.affiliations", F.coalesce("diagnostics", F.array()).alias("diagnostics"))


def decide_affiliation(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """A decision per key from evidence (country, host, first_party, year_gap, profile): two hosts that
    agree, one of them first-party within a year, assign; a single recent profile assigns with medium
    confidence; several countries defer; countries are weighed in order of code."""
    per = evidence.where(F.col("country").isNotNull()).groupBy(*keys, "country").agg(
        F.count_distinct("host").alias("hosts"), F.max(F.col("first_party") & (F.col("year_gap") <= 1)).alias("own"), F.max(F.col("profile") & (F.col("year_gap") <= 1)).alias("recent_profile"), F.count(F.lit(1)).alias("n")
    )
    strong = (F.col("hosts") >= 2) & F.coalesce("own", F.lit(False))
    per = per.withColumn("strong", strong)
    agg = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("countries"), F.sum(F.col("strong").cast("int")).alias("strong"), F.min(F.when(F.col("strong"), F.col("country"))).alias("best"), F.min("country").alias("only"), F.sum("n").alias("n"), F.max("recent_profile").alias("recent"))
    sole = (F.col("countries") == 1) & (F.col("n") == 1) & F.coalesce("recent", F.lit(False))
    decision = F.when((F.col("strong") == 1) & (F.col("countries") == 1), "auto_assign").when(sole, "auto_assign").when(F.col("countries") > 1, "defer").otherwise("defer")
    decided = agg.select(*keys, decision.alias("decision"), F.when(F.col("strong") >= 1, F.when(F.col("countries") == 1, F.col("best"))).when(sole, F.col("only")).alias("country"), F.when((F.col("strong") == 1) & (F.col("countries") == 1), "high").when(sole, "medium").otherwise("low").alias("confidence"))
    rest = evidence.select(*keys).distinct().join(decided.select(*keys), keys, "left_anti")
    return decided.unionByName(rest.select(*keys, F.lit("no_evidence").alias("decision"), F.lit(None).cast("string").alias("country"), F.lit("none").alias("confidence")))


def search_until_assigned(attempts: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(assignments, log) of attempts (decision) per key: the first automatic assignment wins, the log keeps
    the attempts up to it."""
    upto = F.max((F.col("decision") == "auto_assign").cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    log = attempts.withColumn("_done", F.coalesce(upto, F.lit(0))).where("_done = 0").drop("_done")
    return log.where(F.col("decision") == "auto_assign"), log


def cosine_top(left: DataFrame, right: DataFrame, id_: str, vector: str, group: str, k: int) -> DataFrame:
    """The `k` most similar other rows of the same group for each left row (query, neighbour, similarity)."""
    from corvelo.functions.text import cosine

    q, d = left.select(F.col(id_).alias("query"), group, F.col(vector).alias("_q")), right.select(F.col(id_).alias("neighbour"), group, F.col(vector).alias("_d"))
    pairs = q.join(d, group).where(F.col("query") != F.col("neighbour")).select("query", "neighbour", F.round(cosine(F.col("_q"), F.col("_d")), 6).alias("similarity"))
    return pairs.withColumn("rank_no", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank_no") <= k)


def cosine_search(left: DataFrame, right: DataFrame, id_: str, vector: str, k: int, size: int = 500) -> DataFrame:
    """The `k` most similar other rows of all of `right` for each left row (query, neighbour, similarity,
    rank_no); rows whose vector has no length are left out.

    Packs of some `size` queries meet packs of rows; of each pair of packs only the best `k` per query,
    with those that may tie after rounding, go on to the ranking.
    """
    width = T.cosine(F.col(vector), F.col(vector))

    def packs(rows: DataFrame, ids: str, vectors: str) -> DataFrame:
        rows = rows.where(width.isNotNull()).select(F.col(id_).alias("i"), F.col(vector).cast("array<double>").alias("v"))
        part = F.pmod(F.xxhash64("i"), F.lit(max(1, -(-rows.count() // size))))
        return rows.groupBy(part.alias("part")).agg(F.collect_list(F.struct("i", "v")).alias("p")).select(F.col("p.i").alias(ids), F.col("p.v").alias(vectors))

    def best(frames):
        unit = lambda v: (m := np.array([list(x) for x in v])) / np.sqrt((m * m).sum(axis=1, keepdims=True))
        for frame in frames:
            for qi, qv, di, dv in zip(frame["_qi"], frame["_qv"], frame["_di"], frame["_dv"]):
                qi, di = np.asarray(qi), np.asarray(di)
                likeness = unit(qv) @ unit(dv).T
                likeness[qi[:, None] == di[None, :]] = -np.inf
                least = np.partition(likeness, -k, axis=1)[:, -k] if len(di) > k else np.full(len(qi), -2.0)
                x, y = np.nonzero(likeness >= np.maximum(least, -2.0)[:, None] - 2e-6)
                yield pd.DataFrame({"query": qi[x], "neighbour": di[y], "similarity": likeness[x, y]})

    kind = left.schema[id_].dataType.simpleString()
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * left.sparkSession.sparkContext.defaultParallelism)
    pairs = packs(right, "_di", "_dv").repartition(tasks).crossJoin(packs(left, "_qi", "_qv")).mapInPandas(best, f"query {kind}, neighbour {kind}, similarity double")
    pairs = pairs.withColumn("similarity", F.round("similarity", 6))
    return pairs.withColumn("rank_no", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank_no") <= k)
