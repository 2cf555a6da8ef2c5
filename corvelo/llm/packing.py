"""Problem 7: texts into containers of a fixed number of tokens.

Optimal length buckets: dynamic programming over the global histogram of lengths chooses the bucket
boundaries that minimise padding, and token-budget batches form inside each bucket. As batches of equal
buckets alone leave gaps (one text of 1,100 tokens in a container of 2,048), each batch's gap is given to
the next smaller buckets: the batches are composed on the bucket counts, largest bucket first, as a short
list of container patterns with multiplicities. Rows then find their container by their number within
the bucket, so nothing but the histogram (at most `capacity` rows) and the patterns reach the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corvelo.session import cut_lineage

#: Where the vocabulary files of public tokenizers are.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def token_counter(spark: SparkSession, vocabulary: str = f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken"):
    """A function from a text column to its number of tokens; 0 for null and empty. The rank file (about
    1 MB) is read by the driver and broadcast, so workers need no such folder."""
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    @pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(sent.value)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return lambda text: count(F.coalesce(text, F.lit("")))


def best_boundaries(lengths: list[int], counts: list[int], buckets: int, capacity: int) -> list[int]:
    """At most `buckets` boundaries, the last one `capacity`, that minimise the padding of all lengths
    when each is rounded up to the next boundary. Exact, by dynamic programming."""
    values = sorted({*lengths, capacity})
    at = {v: k for k, v in enumerate(values)}
    number = np.zeros(len(values))
    for v, n in zip(lengths, counts):
        number[at[v]] += n
    value = np.array(values, dtype=float)
    n, s = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(number * value)])
    cost, cuts = np.concatenate([[0.0], value * n[1:] - s[1:]]), []
    for _ in range(min(buckets, len(values)) - 1):
        new, cut = cost.copy(), np.zeros(len(values) + 1, dtype=int)
        for j in range(1, len(values) + 1):
            total = cost[:j] + value[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            cut[j] = int(total.argmin())
            new[j] = total[cut[j]]
        cost = new
        cuts.append(cut)
    bounds, j = [], len(values)
    for cut in reversed(cuts):
        bounds.append(values[j - 1])
        j = cut[j]
        if j == 0:
            break
    if j:
        bounds.append(values[j - 1])
    return sorted(bounds)


def container_patterns(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How many containers hold how many texts of each size (times, {place of size: texts}), largest sizes
    first, gaps given to the largest smaller size that fits. Each pattern uses up what it can of some size,
    so there are few."""
    left, patterns = list(counts), []
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    while any(left):
        room, pattern = capacity, {}
        for k in order:
            if left[k] and sizes[k] <= room:
                pattern[k] = min(left[k], room // sizes[k])
                room -= pattern[k] * sizes[k]
        times = min(left[k] // m for k, m in pattern.items())
        for k, m in pattern.items():
            left[k] -= times * m
        patterns.append((times, pattern))
    return patterns


def pack_texts(texts: DataFrame, tokens: Column, capacity: int = 2048, buckets: int = 64, rows_a_task: int = 500_000) -> DataFrame:
    """Containers of texts (doc_id, piece_no, first_token, n_tokens, bucket, container_id).

    A text longer than `capacity` is divided into full pieces and a rest; no other is. `bucket` is the
    boundary that the piece counts as. Texts without tokens (null, empty) take no space: piece 0 of 0
    tokens without bucket or container. Equal texts and repeated rows are each packed. The same input
    gives the same containers in any partitioning. Buckets of any size are numbered in parts of about
    `rows_a_task` rows, so a bucket with a third of all rows meets many tasks.
    """
    counted = cut_lineage(texts.select("doc_id", tokens.alias("tokens")))
    pieces = (
        counted.where(F.col("tokens") > 0)
        .select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))).alias("piece_no"))
        .select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * capacity).alias("n_tokens"))
    )
    histogram = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    spark = texts.sparkSession
    schema = "bucket int, low bigint, high bigint, each bigint, first bigint"
    ranges: list[tuple] = []
    bounds = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets, capacity) if histogram else [capacity]
    held = [sum(r[1] for r in histogram if low < r[0] <= high) for low, high in zip([0, *bounds], bounds)]
    used, container = [0] * len(bounds), 0
    for times, pattern in container_patterns(bounds, held, capacity):
        for k, each in pattern.items():
            ranges.append((bounds[k], used[k], used[k] + times * each, each, container))
            used[k] += times * each
        container += times
    parts = max(16, sum(held) // rows_a_task)
    bucket = F.element_at(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("n_tokens")), 1)
    placed = pieces.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")).select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "part").orderBy("doc_id", "piece_no", "n_tokens")
    numbered = placed.join(offsets, ["bucket", "part"]).withColumn("place", F.col("before") + F.row_number().over(inside) - 1)
    plan = F.broadcast(spark.createDataFrame(ranges, schema))  # as many rows as patterns times their buckets
    packed = numbered.join(plan, "bucket").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    packed = packed.select("doc_id", "piece_no", "first_token", "n_tokens", "bucket", (F.col("first") + F.floor((F.col("place") - F.col("low")) / F.col("each"))).cast("bigint").alias("container_id"))
    empty = counted.where(F.col("tokens") == 0).select("doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("first_token"), F.lit(0).alias("n_tokens"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("bigint").alias("container_id"))
    return packed.unionByName(empty)


def unused_space(packed: DataFrame, capacity: int) -> DataFrame:
    """One row (containers, tokens, unused_share) of a result of `pack_texts`."""
    sums = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return sums.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).select(
        "containers", "tokens", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0).alias("unused_share")
    )
