"""Translation evaluation: passages, models, judge payloads, overlap scores."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvelo.functions.text import strip_markdown


def parallel_passages(cells: DataFrame, pairs: list[tuple[int, int]], left: str, right: str) -> DataFrame:
    """Text pairs of two documents (document, cell, text) by a fixed list of cell numbers."""
    spark = cells.sparkSession
    numbered = spark.createDataFrame([(k + 1, a, b) for k, (a, b) in enumerate(pairs)], "pair_id int, english_cell int, portuguese_cell int")
    side = lambda name, cell, text: cells.where(F.col("document") == name).select(F.col("cell").alias(cell), strip_markdown(F.col("text")).alias(text))
    return F.broadcast(numbered).join(side(left, "english_cell", "english"), "english_cell").join(side(right, "portuguese_cell", "portuguese"), "portuguese_cell").select("pair_id", "english_cell", "portuguese_cell", "english", "portuguese")


def filter_models(predictions: DataFrame, shown: dict[str, str], wanted: list[str]) -> DataFrame:
    """Predictions of models chosen by key; unknown keys and models without predictions raise."""
    if unknown := [k for k in wanted if k not in shown]:
        raise ValueError(f"unknown models: {unknown}")
    names = predictions.sparkSession.createDataFrame([(shown[k],) for k in dict.fromkeys(wanted)], "model string")
    if absent := names.join(predictions.select("model").distinct(), "model", "left_anti").take(5):
        raise ValueError(f"no predictions of {[r[0] for r in absent]}")
    return predictions.join(F.broadcast(names), "model", "left_semi")


def translation_sources(changes: DataFrame, prefix: str, suffix: str, translated: str) -> DataFrame:
    """Changed files (path) to translate: under a prefix, with a suffix, no translation themselves, and
    without a changed translation beside them."""
    stem = F.expr(f"substring(path, 1, length(path) - {len(suffix)})")
    own = changes.where(F.col("path").startswith(prefix) & F.col("path").endswith(suffix) & ~F.col("path").endswith(translated)).withColumn("_partner", F.concat(stem, F.lit(translated)))
    return own.join(changes.select(F.col("path").alias("_partner")), "_partner", "left_anti").drop("_partner")


def judge_payload(direction: Column, **fields: Column) -> Column:
    """What a judge is given: the target locale by direction, and the candidate's fields."""
    locale = F.when(direction.endswith("pt-BR"), "Brazilian Portuguese").otherwise("English")
    return F.struct(locale.alias("target_locale"), *(c.alias(n) for n, c in fields.items()))


def chrf(reference: str, prediction: str, letters: int = 6, words: int = 2, beta: float = 2.0) -> list[float]:
    """Matches, predicted and reference counts of letter and word n-grams, one triple an order."""
    counts = []
    for order, tokens in [(n, lambda t: list(t.replace(" ", ""))) for n in range(1, letters + 1)] + [(n, str.split) for n in range(1, words + 1)]:
        grams = [Counter(tuple(x[k : k + order]) for k in range(len(x) - order + 1)) for x in (tokens(reference), tokens(prediction))]
        counts += [float(sum((grams[0] & grams[1]).values())), float(sum(grams[1].values())), float(sum(grams[0].values()))]
    return counts


def word_edits(reference: list[str], prediction: list[str]) -> int:
    row = list(range(len(prediction) + 1))
    for i, x in enumerate(reference, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(prediction, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def bleu_counts(reference: list[str], prediction: list[str], most: int = 4) -> list[float]:
    """Clipped matches and predicted n-grams for n of 1 to `most`, then both lengths."""
    found = []
    for n in range(1, most + 1):
        runs = lambda words: Counter(zip(*(words[k:] for k in range(n))))  # noqa: E731, B023
        found += [float(sum((runs(prediction) & runs(reference)).values())), float(max(0, len(prediction) - n + 1))]
    return [*found, float(len(prediction)), float(len(reference))]


def shift_edits(reference: list[str], prediction: list[str], longest: int = 10, furthest: int = 50) -> int:
    """Word edits with block shifts: while some run of the prediction that the reference holds elsewhere can be moved
    so that fewer edits remain, the best such move is made and counts as one edit."""
    words, moves = list(prediction), 0
    left = word_edits(reference, words)
    while left:
        best = None
        starts = {}
        for j in range(len(reference)):
            starts.setdefault(reference[j], []).append(j)
        for i in range(len(words)):
            for j in starts.get(words[i], ()):
                if i == j or abs(i - j) > furthest:
                    continue
                n = 0
                while n < longest and i + n < len(words) and j + n < len(reference) and words[i + n] == reference[j + n]:
                    n += 1
                    rest = words[:i] + words[i + n :]
                    at = min(j, len(rest))
                    moved = rest[:at] + words[i : i + n] + rest[at:]
                    if moved != words:
                        gain = left - word_edits(reference, moved)
                        if gain > 1 and (best is None or (gain, n) > best[:2]):
                            best = (gain, n, moved)
        if best is None:
            break
        moves, words = moves + 1, best[2]
        left = word_edits(reference, words)
    return left + moves


_MARKS = re.compile(r"(?<=[^\w\s])|(?=[^\w\s])")


def score_tokens(text: str) -> list[str]:
    """Words and single punctuation marks, case kept."""
    return _MARKS.sub(" ", text).split()


def overlap_scores(predictions: DataFrame, by: list[str], letters: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """Corpus BLEU (up to four words, brevity penalty, no smoothing but for orders without a match, which halve),
    chrF++, TER (edits with shifts over reference words) and word error rate (edits without shifts) per
    group of rows with reference and prediction. Counts are taken per row and summed, as corpus scores are."""
    orders = letters + words

    @F.pandas_udf("array<double>")
    def count(reference: pd.Series, prediction: pd.Series) -> pd.Series:
        return pd.Series([chrf(r or "", p or "", letters, words) + [float(word_edits((r or "").split(), (p or "").split())), float(len((r or "").split())), float(shift_edits((r or "").lower().split(), (p or "").lower().split()))] + bleu_counts(score_tokens(r or ""), score_tokens(p or "")) for r, p in zip(reference, prediction)])

    sums = predictions.select(*by, count("reference", "prediction").alias("c")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("c")[k]).alias(f"s{k}") for k in range(3 * orders + 13)))
    share = lambda a, b: F.when(b > 0, a / b)
    parts = []
    for k in range(orders):
        hit, out, ref = (F.col(f"s{3 * k + m}") for m in range(3))
        p, r = share(hit, out), share(hit, ref)
        parts.append(F.when((p + r) > 0, (1 + beta**2) * p * r / (beta**2 * p + r)).when(out.isNotNull() & (ref > 0) & (out > 0), 0.0))
    known = F.array_compact(F.array(*parts))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0)
    at = 3 * orders + 3
    hits, runs = [F.col(f"s{at + 2 * k}") for k in range(4)], [F.col(f"s{at + 2 * k + 1}") for k in range(4)]
    out, ref = F.col(f"s{at + 8}"), F.col(f"s{at + 9}")
    logs, halved = F.lit(0.0), F.lit(1.0)
    for h, r in zip(hits, runs):
        halved = F.when((h == 0) & (r > 0), halved * 2).otherwise(halved)
        logs = logs + F.when(h > 0, F.log(h / r)).when(r > 0, F.log(1 / (halved * r)))
    brevity = F.when(out >= ref, 1.0).when(out > 0, F.exp(1 - ref / out)).otherwise(0.0)
    bleu = F.when(hits[0] == 0, 0.0).otherwise(F.coalesce(brevity * F.exp(logs / 4), F.lit(0.0)))
    return sums.select(*by, "n", (100 * mean).alias("chrf"), (100 * share(F.col(f"s{3 * orders}"), F.col(f"s{3 * orders + 1}"))).alias("word_error_rate"), (100 * share(F.col(f"s{3 * orders + 2}"), F.col(f"s{3 * orders + 1}"))).alias("ter"), (100 * bleu).alias("bleu"))
