"""Stable samples in hash order, seeded samples, folds."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_key(*parts: Column | str, seed: str = "") -> Column:
    """SHA-256 over the parts joined with |; null counts as empty."""
    columns = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *([F.lit(seed)] if seed else []), *columns), 256)


def hash_top(frame: DataFrame, strata: list[str], n: int, key: Column) -> DataFrame:
    """The first `n` rows of each stratum in hash order. Spark keeps a window's top n per partition before
    it shuffles, so a stratum of any size moves n rows per task."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_h"))
    return frame.withColumn("_h", key).withColumn("_place", place).where(F.col("_place") <= n).drop("_h", "_place")


def near_threshold(frame: DataFrame, strata: list[str], by_hash: int, nearest: int, score: str, threshold: float, id_: str) -> DataFrame:
    """`by_hash` rows a stratum in hash order, then the `nearest` of the rest to a threshold, with `pick`."""
    first = hash_top(frame, strata, by_hash, stable_key(F.col(id_).cast("string"))).withColumn("pick", F.lit("hash"))
    rest = frame.join(first.select(id_), id_, "left_anti")
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(F.abs(F.col(score) - threshold), stable_key(F.col(id_).cast("string"))))
    close = rest.withColumn("_p", place).where(F.col("_p") <= nearest).drop("_p").withColumn("pick", F.lit("threshold"))
    return first.unionByName(close)


def stratified_validation(frame: DataFrame, dimension: str, ambiguous: Column, negative: Column, venue: str, id_: str, sizes: tuple[int, int, int] = (8, 4, 5)) -> DataFrame:
    """Ids chosen by three ranked selections: per dimension, ambiguous per venue, negative per venue."""
    h = stable_key(F.col(id_).cast("string"))
    per_dimension = hash_top(frame.where(F.col(dimension).isNotNull()), [dimension], sizes[0], h)
    unsure, none = hash_top(frame.where(ambiguous), [venue], sizes[1], h), hash_top(frame.where(negative), [venue], sizes[2], h)
    return per_dimension.select(id_).unionByName(unsure.select(id_)).unionByName(none.select(id_)).distinct()


def seeded_sample(frame: DataFrame, order: list[str], size: int, seed: int) -> DataFrame:
    """A sample without replacement by Python's generator, rows in their order. The driver draws `size`
    row numbers; raises where there are fewer rows. Rows are numbered by one ordered window, as the
    generator's contract demands a total order."""
    total = frame.count()
    if not 0 <= size <= total:
        raise ValueError(f"cannot draw {size} of {total}")
    chosen = sorted(random.Random(seed).sample(range(total), size))
    places = frame.sparkSession.createDataFrame([(k + 1,) for k in chosen], "_n int")
    counted = frame.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return counted.join(F.broadcast(places), "_n", "left_semi").drop("_n")


def folds(frame: DataFrame, stratum: list[str], id_: str, k: int) -> DataFrame:
    """Stratified folds 0..k-1 in hash order."""
    place = F.row_number().over(Window.partitionBy(*stratum).orderBy(stable_key(F.col(id_).cast("string")), id_))
    return frame.withColumn("fold", ((place - 1) % k).cast("int"))


def group_folds(frame: DataFrame, group: str) -> DataFrame:
    """One fold per group, in order of its name."""
    names = frame.select(group).distinct().withColumn("fold", F.row_number().over(Window.orderBy(group)) - 1)
    return frame.join(F.broadcast(names), group)


def blinded_swap(id_: Column) -> Column:
    """Whether to show candidates in reverse: the id's hash is an even number."""
    return F.conv(F.substring(F.sha2(id_, 256), 64, 1), 16, 10).cast("int") % 2 == 0


#: Strata in the order of picking.
STRATA = ("clear", "borderline", "disagreement")


def human_candidates(decisions: DataFrame, penalties: DataFrame, scores: DataFrame | None = None, near: float = 2) -> DataFrame:
    """Decisions (direction, segment_id, model_pair, preferred_model, stable) with left_model, right_model,
    penalty_gap and stratum: disagreement where unstable or where penalties (direction, segment_id, model, penalty) or
    scores (direction, segment_id, model, score) prefer another model, borderline where penalties are
    within `near`, else clear. Ties agree with everything; missing values count as 0 in the gap."""
    pair = F.transform(F.split("model_pair", r"\|\|"), lambda m: F.trim(m))
    rows = decisions.withColumns({"left_model": pair[0], "right_model": pair[1]})

    def both(rows: DataFrame, values: DataFrame, value: str) -> DataFrame:
        for side in ("left", "right"):
            named = values.select("direction", "segment_id", F.col("model").alias(f"{side}_model"), F.col(value).alias(f"_{side}_{value}"))
            rows = rows.join(named, ["direction", "segment_id", f"{side}_model"], "left")
        return rows

    rows = both(rows, penalties, "penalty")
    left, right = F.col("_left_penalty"), F.col("_right_penalty")
    other = lambda best: F.coalesce(~F.col("preferred_model").isin("tie") & (F.col("preferred_model") != best), F.lit(False))
    apart = ~F.col("stable") | other(F.when(left == right, "tie").when(left < right, F.col("left_model")).when(left > right, F.col("right_model")))
    if scores is not None:
        rows = both(rows, scores, "score")
        a, b = F.col("_left_score"), F.col("_right_score")
        apart = apart | other(F.when(F.abs(a - b) <= 1e-9, "tie").when(a > b, F.col("left_model")).when(a < b, F.col("right_model")))
    stratum = F.when(apart, "disagreement").when(F.abs(left - right) <= near, "borderline").otherwise("clear")
    gap = F.abs(F.coalesce(left, F.lit(0)) - F.coalesce(right, F.lit(0)))
    return rows.select(*decisions.columns, "left_model", "right_model", stratum.alias("stratum"), gap.alias("penalty_gap"))


def human_sample(candidates: DataFrame, cap: int = 18, each: int = 3, fallback: int = 9) -> DataFrame:
    """Blinded sample of rows as `human_candidates` gives them. Directions and model pairs in order of name;
    in each up to `each` rows of every stratum, the widest penalty gap first among the clear and the
    narrowest elsewhere, then, if under `fallback`, further rows with the narrowest gap; no segment twice;
    the first `cap` in all. Adds `sample_id` and `swap`.

    Each pick depends on the ones before. Only rows that can be picked, a fixed number for a direction and
    pair, are decided in one task."""
    group, reach = ["direction", "model_pair"], cap + max(each, fallback)
    signed = F.when(F.col("stratum") == "clear", -F.col("penalty_gap")).otherwise(F.col("penalty_gap"))
    first = F.row_number().over(Window.partitionBy(*group, "stratum").orderBy(signed, "segment_id"))
    rest = F.row_number().over(Window.partitionBy(*group).orderBy("penalty_gap", "segment_id"))
    thin = candidates.withColumn("_first", first).withColumn("_rest", rest).where((F.col("_first") <= reach) | (F.col("_rest") <= reach))
    schema = candidates.select("*", F.lit("").alias("sample_id"), blinded_swap(F.col("segment_id")).alias("swap")).schema

    def pick(pdf):
        taken, used = [], set()

        def take(rows, most: int) -> int:
            fresh = [(k, g) for k, g in zip(rows.index, rows["segment_id"]) if g not in used]
            chosen, seen = [], set()
            for k, g in fresh[:most]:
                chosen.append(k)
                seen.add(g)
            taken.extend(chosen)
            used.update(seen)
            return len(chosen)

        for _, pool in pdf.sort_values(group).groupby(group, sort=True):
            n = sum(take(pool[pool["stratum"] == s].sort_values("_first"), each) for s in STRATA)
            if n < fallback:
                take(pool.sort_values("_rest"), fallback - n)
            if len(taken) >= cap:
                break
        out = pdf.loc[taken[:cap]].drop(columns=["_first", "_rest"]).reset_index(drop=True)
        out["sample_id"] = [f"human-{k + 1:02d}" for k in range(len(out))]
        return out

    return thin.withColumn("swap", blinded_swap(F.col("segment_id"))).groupBy().applyInPandas(lambda pdf: pick(pdf)[[f.name for f in schema]], schema)
