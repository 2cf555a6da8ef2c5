"""Rule-based and counterfactual explanation of tabular models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def median_absolute_deviation(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, median, mad) with lower medians, in two passes for all features at once."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("x")).select("x.*").where("value IS NOT NULL")
    lower = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
    medians = long.groupBy("feature").agg(lower("value").alias("median"))
    off = long.join(F.broadcast(medians), "feature").withColumn("off", F.abs(F.col("value") - F.col("median")))  # a row a feature
    return off.groupBy("feature", "median").agg(lower("off").alias("mad"))


def rule_candidates(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, op, threshold): every distinct value of a feature with <= and >."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("threshold")) for f in features))).alias("x")).select("x.*").where("threshold IS NOT NULL").distinct()
    return long.select("feature", F.explode(F.array(F.lit("<="), F.lit(">"))).alias("op"), "threshold")


def rule_quality(rows: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """Coverage and precision of every single rule of `rule_candidates` for a boolean outcome.

    Values are counted once per feature; cumulative sums over the distinct values give the counts of all
    rules, so no row meets a rule twice.
    """
    from pyspark.sql import Window

    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("threshold")) for f in features))).alias("x"), F.col(outcome).cast("int").alias("y")).select("x.*", "y").where("threshold IS NOT NULL")
    counts = long.groupBy("feature", "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    upto = Window.partitionBy("feature").orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    whole = counts.groupBy("feature").agg(F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all"))
    sums = counts.withColumn("n_le", F.sum("n").over(upto)).withColumn("pos_le", F.sum("pos").over(upto)).join(F.broadcast(whole), "feature")
    both = sums.select("feature", "threshold", "n_all", F.explode(F.array(F.struct(F.lit("<=").alias("op"), F.col("n_le").alias("n"), F.col("pos_le").alias("pos")), F.struct(F.lit(">").alias("op"), (F.col("n_all") - F.col("n_le")).alias("n"), (F.col("pos_all") - F.col("pos_le")).alias("pos")))).alias("r"))
    return both.select("feature", "r.op", "threshold", F.col("r.n").alias("covered"), (F.col("r.n") / F.col("n_all")).alias("coverage"), F.when(F.col("r.n") > 0, F.col("r.pos") / F.col("r.n")).otherwise(0.0).alias("precision"))


def predicate(rule: tuple[str, str, float]) -> Column:
    feature, op, threshold = rule
    return F.col(feature) <= threshold if op == "<=" else F.col(feature) > threshold


def anchor_quality(rows: DataFrame, rules: list[tuple[str, str, float]], agrees: str) -> DataFrame:
    """One row: coverage of a conjunction and precision (mean agreement of the covered; 0 for under two)."""
    held = F.lit(True)
    for rule in rules:
        held = held & predicate(rule)
    return rows.agg(F.avg(held.cast("double")).alias("coverage"), F.when(F.sum(held.cast("int")) >= 2, F.avg(F.when(held, F.col(agrees).cast("double")))).otherwise(0.0).alias("precision"))


def beam_anchors(rows: DataFrame, features: list[str], agrees: str, row: dict[str, float], least: float = 0.95, beam: int = 4, depth: int = 3) -> list[tuple[list[tuple[str, str, float]], float, float]]:
    """The best anchors of an instance (rules, precision, coverage): beam search by exact precision instead
    of sampling. Each level evaluates the one-rule extensions of every beam by cumulative counts; the driver
    holds `beam` anchors."""
    anchors: list[tuple[list, float, float]] = [([], 0.0, 1.0)]
    total, found = rows.count(), []
    for _ in range(depth):
        grown = []
        for rules, _, _ in anchors:
            held = rows
            for rule in rules:
                held = held.where(predicate(rule))
            fits = F.lit(False)
            for f in features:
                fits = fits | ((F.col("feature") == f) & F.when(F.col("op") == "<=", F.lit(row[f]) <= F.col("threshold")).otherwise(F.lit(row[f]) > F.col("threshold")))
            quality = rule_quality(held, features, agrees).where(fits & (F.col("covered") >= 2))
            for r in quality.orderBy(F.desc("precision"), F.desc("covered"), "feature", "op", "threshold").limit(beam).collect():
                grown.append((rules + [(r["feature"], r["op"], r["threshold"])], r["precision"], r["covered"] / total))
        if not grown:
            break
        anchors = sorted(grown, key=lambda a: (-a[1], -a[2]))[:beam]
        found = [a for a in anchors if a[1] >= least]
        if found:
            break
    return found or anchors


def hinge_loss(z: Column, probability: Column) -> Column:
    """max(0, 1 - z * logit)."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), probability))
    return F.greatest(F.lit(0.0), 1 - z * F.log(p / (1 - p)))


def scaled_distance(a: Column, b: Column, mad: Column) -> Column:
    """Mean absolute difference of two arrays over the features' deviations (zero deviations count as 1)."""
    parts = F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), mad, lambda d, m: d / F.when(m == 0, 1.0).otherwise(m))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def sparsity(original: Column, changed: Column) -> Column:
    """1 - the share of changed entries."""
    differ = F.zip_with(original, changed, lambda x, y: (x != y).cast("int"))
    return 1 - F.aggregate(differ, F.lit(0), lambda s, x: s + x) / F.size(original)


def proximity(distances: Column) -> Column:
    return -F.aggregate(distances, F.lit(0.0), lambda s, x: s + x) / F.size(distances)


@pandas_udf(DoubleType())
def diversity(sets: pd.Series) -> pd.Series:
    """Determinant of 1 / (1 + L1 distance) over a set of vectors, a little added to the diagonal."""

    def one(vectors) -> float:
        x = np.array([list(v) for v in vectors], dtype=float)
        return float(np.linalg.det(1 / (1 + np.abs(x[:, None] - x[None, :]).sum(axis=2)) + 1e-4 * np.eye(len(x))))

    return sets.map(one)


def counterfactuals(rows: DataFrame, id_: str, features: str, weights: list[float], bias: float, mad: list[float], count: int = 3, steps: int = 400, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """`count` diverse counterfactuals of each row for a linear-logistic model, by gradient descent on hinge
    loss, distance and spread (id, place, counterfactual, probability), then small changes reverted while
    the class holds. Rows are independent; each is solved in the worker it lies in."""
    w, scale = np.array(weights), np.where(np.array(mad) == 0, 1.0, np.array(mad))

    def solve(frames):
        for frame in frames:
            out = []
            for key, x in zip(frame[id_], frame[features]):
                x = np.array(list(x), dtype=float)
                target = -1.0 if w @ x + bias > 0 else 1.0
                rng = np.random.default_rng(seed)
                c = x + rng.normal(0, 0.5, (count, len(x))) * scale
                for _ in range(steps):
                    pull = np.sign(c - x) / scale / len(x) * 0.5
                    push = np.where((target * (c @ w + bias) < 1)[:, None], -target * w, 0.0)
                    apart = np.zeros_like(c)
                    for i in range(count):
                        away = c[i] - np.delete(c, i, axis=0)
                        apart[i] = -(np.sign(away) / (1 + np.abs(away).sum(axis=1, keepdims=True)) ** 2).sum(axis=0)
                    c -= rate * (push + pull + 0.1 * apart) * scale
                for k in range(count):
                    for f in np.argsort(np.abs(c[k] - x)):
                        if abs(c[k][f] - x[f]) <= scale[f]:
                            held = c[k][f]
                            c[k][f] = x[f]
                            if target * (c[k] @ w + bias) <= 0:
                                c[k][f] = held
                    out.append((key, k, c[k].tolist(), float(1 / (1 + np.exp(-(c[k] @ w + bias))))))
            yield pd.DataFrame(out, columns=[id_, "place", "counterfactual", "probability"])

    return rows.select(id_, features).mapInPandas(solve, f"{id_} {rows.schema[id_].dataType.simpleString()}, place int, counterfactual array<double>, probability double")
