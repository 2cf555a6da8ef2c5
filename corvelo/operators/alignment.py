"""Monotonic many-to-many alignment by a given similarity, and freezing of reviewed alignments."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvelo.functions.text import reviewed_text, split_list

#: Lines left and right of the moves, beside gaps.
MOVES = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))


def monotonic_steps(left: list[str], right: list[str], similarity: Callable[[str, str], float], gap: float = -0.45, merge: float = 0.08, length: float = 0.08) -> list[tuple[int, int, int, int, float | None, float]]:
    """Steps (left start, count, right start, count, similarity, score) of the best monotone alignment."""
    best = {(0, 0): (0.0, None)}
    for i in range(len(left) + 1):
        for j in range(len(right) + 1):
            if not i and not j:
                continue
            options = []
            if i:
                options.append((best[i - 1, j][0] + gap, (i - 1, 1, j, 0, None, gap)))
            if j:
                options.append((best[i, j - 1][0] + gap, (i, 0, j - 1, 1, None, gap)))
            for a, b in MOVES:
                if a <= i and b <= j:
                    x, y = " ".join(left[i - a : i]), " ".join(right[j - b : j])
                    like = similarity(x, y)
                    score = like - merge * (a + b - 2) - length * abs(math.log((len(x) + 1) / (len(y) + 1)))
                    options.append((best[i - a, j - b][0] + score, (i - a, a, j - b, b, like, score)))
            best[i, j] = max(options, key=lambda o: o[0])
    steps, at = [], (len(left), len(right))
    while at != (0, 0):
        step = best[at][1]
        steps.append(step)
        at = (step[0], step[2])
    return steps[::-1]


def align_by(passages: DataFrame, similarity: Callable[[str, str], float]) -> DataFrame:
    """Alignment steps of passages (pair_id, left, right as arrays of sentences) by a similarity of joined
    sentences. A passage is one unit of work."""

    def align(frames):
        for frame in frames:
            rows = []
            for key, left, right in zip(frame["pair_id"], frame["left"], frame["right"]):
                for n, (i, a, j, b, like, score) in enumerate(monotonic_steps(list(left), list(right), similarity), 1):
                    rows.append((key, f"p{key:02d}-a{n:02d}", "|".join(f"p{key:02d}-en{k + 1:02d}" for k in range(i, i + a)), "|".join(f"p{key:02d}-pt{k + 1:02d}" for k in range(j, j + b)), f"{a}:{b}", like, score))
            yield pd.DataFrame(rows, columns=["pair_id", "alignment_id", "english_sentence_ids", "portuguese_sentence_ids", "alignment_type", "similarity", "transition_score"])

    return passages.mapInPandas(align, "pair_id int, alignment_id string, english_sentence_ids string, portuguese_sentence_ids string, alignment_type string, similarity double, transition_score double")


def reused_sentences(alignments: DataFrame) -> DataFrame:
    """Sentence ids that more than one alignment uses."""
    ids = alignments.select(F.explode(F.concat(split_list(F.col("english_sentence_ids"), r"\|"), split_list(F.col("portuguese_sentence_ids"), r"\|"))).alias("sentence_id"))
    return ids.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def freeze_alignments(review: DataFrame) -> DataFrame:
    """Segments of accepted alignments with text on both sides, reviewed texts before originals, and whether
    a text was edited."""
    en, pt = reviewed_text(F.col("reviewed_english"), F.col("english")), reviewed_text(F.col("reviewed_portuguese"), F.col("portuguese"))
    edited = (en != F.trim("english")) | (pt != F.trim("portuguese"))
    kept = review.where((F.col("review_status") == "accept") & (F.length(en) > 0) & (F.length(pt) > 0))
    return kept.select(F.col("alignment_id").alias("segment_id"), "pair_id", "english_sentence_ids", "portuguese_sentence_ids", en.alias("english"), pt.alias("portuguese"), edited.alias("reference_was_edited"), "review_note")
