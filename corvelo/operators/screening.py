"""Screening of texts for degenerate repetition."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvelo.functions import text as T


def most_repeated(tokens: Column, n: int) -> Column:
    """(n, gram) of the most frequent run of n tokens, the first of ties; null for fewer than n tokens."""

    @F.pandas_udf("n bigint, gram string")
    def count(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for own in lists:
            own = [] if own is None else list(own)
            top = Counter(zip(*(own[k:] for k in range(n)))).most_common(1)
            rows.append((top[0][1], " ".join(top[0][0])) if top else (None, None))
        return pd.DataFrame({"n": pd.array([r[0] for r in rows], dtype="Int64"), "gram": pd.Series([r[1] for r in rows], dtype=object)})

    return count(tokens)


def repetition_screen_frame(frame: DataFrame, id_: str, text: str, n: int = 4, least: int = 4) -> DataFrame:
    """The most frequent n-gram of each text (the first of ties) and whether it occurs `least` times; texts
    shorter than n tokens are missing. Counted inside the row, without a shuffle."""
    best = frame.select(id_, most_repeated(T.plain_tokens(F.coalesce(text, F.lit(""))), n).alias("b")).where("b.n IS NOT NULL")
    return best.select(id_, (F.col("b.n") >= least).alias("flagged"), F.col("b.n").alias("max_occurrences"), F.col("b.gram").alias("repeated_ngram"))


def screen_gate(frame: DataFrame, text: str, by: list[str], whole: list[str], n: int = 4, least: int = 4, most: float = 0.05) -> DataFrame:
    """Share of flagged texts per `by`, and whether it is `most` at most in each group of `by` that belongs to the same
    `whole` (a model passes where all its directions do); short and null texts are not flagged."""
    held = F.coalesce(most_repeated(T.plain_tokens(F.coalesce(text, F.lit(""))), n)["n"] >= least, F.lit(False))
    parts = frame.select(*by, held.cast("double").alias("_f")).groupBy(*by).agg(F.count(F.lit(1)).alias("texts"), F.avg("_f").alias("flagged_share"))
    worst = parts.groupBy(*whole).agg((F.max("flagged_share") <= most).alias("passes"))
    return parts.join(worst, whole)
