"""Problem 3: one global ranking from pairwise comparisons, by spring energy.

Each comparison is a spring of rest length one from loser to winner; a tie is half a win for either.
Strengths minimise the energy of all springs plus a small pull to zero, which is the solution of one
sparse symmetric linear system. It is solved by conjugate gradients with the Jacobi preconditioner, on
DataFrames: one join and one aggregation over the distinct pairs an iteration; the driver sees two
numbers an iteration, never strengths or pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvelo.functions.ranking import spread_row_number
from corvelo.session import cut_lineage, drop_cut


def spring_strengths(comparisons: DataFrame, group: str = "group", pull: float = 0.01, tolerance: float = 1e-9, most_iterations: int = 200) -> DataFrame:
    """Strengths (`group`, item, strength, compared) from rows (`group`, winner, loser, weight, tied).

    All groups are solved at once as one block-diagonal system. Rows with a null item or group or an item
    compared with itself are left out; repeated rows count each. Ends when the residual fell below `tolerance` of its
    start; raises if `most_iterations` do not suffice. Items of one group that no chain of comparisons
    connects have strengths relative to their own part only. Hot pairs are summed before any shuffle of
    rows. An empty input gives an empty result.
    """
    rows = comparisons.where((F.col("winner") != F.col("loser")) & F.col(group).isNotNull()).select(group, "winner", "loser", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("tied", F.lit(False)).alias("tied"))
    directed = rows.groupBy(group, "winner", "loser").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("tied"), 0.0).otherwise(F.col("weight"))).alias("net"))
    both = directed.select(group, F.col("winner").alias("item"), F.col("loser").alias("other"), "n", "net").unionByName(
        directed.select(group, F.col("loser").alias("item"), F.col("winner").alias("other"), "n", (-F.col("net")).alias("net"))
    )
    springs = cut_lineage(both.groupBy(group, "item", "other").agg(F.sum("n").alias("n"), F.sum("net").alias("net")))
    state = springs.groupBy(group, "item").agg(F.sum("n").alias("compared"), F.sum("net").alias("r")).withColumn("diag", F.col("compared") + F.lit(pull))
    state = moved = cut_lineage(state.select(group, "item", "compared", "diag", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("diag")).alias("p")))
    rho = state.agg(F.sum(F.col("r") * F.col("r") / F.col("diag"))).first()[0] or 0.0
    start, turn = rho, 0
    while rho > tolerance * tolerance * start and rho > 0:
        if turn == most_iterations:
            raise RuntimeError(f"no convergence after {turn} iterations")
        pulled = springs.join(state.select(group, F.col("item").alias("other"), "p"), [group, "other"]).groupBy(group, "item").agg(F.sum(F.col("n") * F.col("p")).alias("pulled"))
        last, moved = moved, cut_lineage(state.join(pulled, [group, "item"]).withColumn("q", F.col("diag") * F.col("p") - F.col("pulled")).drop("pulled"))
        drop_cut(last)
        step = rho / moved.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        now = moved.withColumn("x", F.col("x") + step * F.col("p")).withColumn("r", F.col("r") - step * F.col("q"))
        new = now.agg(F.sum(F.col("r") * F.col("r") / F.col("diag"))).first()[0]
        state = now.withColumn("p", F.col("r") / F.col("diag") + F.lit(new / rho) * F.col("p")).drop("q")
        rho, turn = new, turn + 1
    return state.select(group, "item", F.col("x").alias("strength"), "compared")


def decided_comparisons(decisions: DataFrame) -> DataFrame:
    """Comparisons (direction, winner, loser, weight, tied) of stable decisions.

    A pair is read whatever its order, case and spacing; a model is shown in its most frequent spelling.
    A decision delivered again counts once, the last judged. Unstable, unanswered and malformed decisions
    and those whose preferred model is no member of the pair are left out.
    """
    spelled = F.transform(F.split("model_pair", r"\|\|"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    read = decisions.where(F.col("stable")).select("direction", "segment_id", "seq", "judged_at", spelled.alias("m"), F.lower(F.trim(F.regexp_replace("preferred_model", r"\s+", " "))).alias("preferred"))
    read = read.where(F.size("m") == 2)
    names = read.select(F.explode("m").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).groupBy(F.lower("name").alias("key")).agg(F.max_by("name", F.struct("n", "name")).alias("name"))
    keys = F.array_sort(F.transform("m", lambda x: F.lower(x)))
    one = read.select("direction", "segment_id", keys[0].alias("a"), keys[1].alias("b"), "preferred", "judged_at", "seq")
    one = one.groupBy("direction", "segment_id", "a", "b").agg(F.max_by("preferred", F.struct("judged_at", "seq")).alias("preferred"))
    won = one.where((F.col("preferred") == "tie") | (F.col("preferred") == F.col("a")) | (F.col("preferred") == F.col("b")))
    sums = won.groupBy("direction", F.when(F.col("preferred") == F.col("b"), F.col("b")).otherwise(F.col("a")).alias("w"), F.when(F.col("preferred") == F.col("b"), F.col("a")).otherwise(F.col("b")).alias("l"), (F.col("preferred") == "tie").alias("tied")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    return (
        sums.join(names.select(F.col("key").alias("w"), F.col("name").alias("winner")), "w")
        .join(names.select(F.col("key").alias("l"), F.col("name").alias("loser")), "l")
        .select("direction", "winner", "loser", "weight", "tied")
    )


def rank_models(decisions: DataFrame, pull: float = 0.01) -> DataFrame:
    """One place per model and direction (direction, rank_no, model, strength, compared), 1 the strongest.
    Equal strengths are ordered by name."""
    strengths = spring_strengths(decided_comparisons(decisions), "direction", pull)
    return spread_row_number(strengths.withColumnRenamed("item", "model"), ["direction"], "strength", "model")
