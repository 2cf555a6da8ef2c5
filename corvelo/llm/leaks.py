"""Problem 8: evaluation texts inside corpus documents.

Size-partitioned MinHash containment search. Items are partitioned by their number of shingles; for each
partition every document is cut into overlapping windows of a matching size, so that an item hidden in a
document thousands of words long still has a high similarity to some window. A window whose signature
agrees with an item's in as many places as the wanted containment implies is a candidate, which an exact
shingle check then confirms or not.

Documents stream through once per block of items and are never shuffled; items are broadcast in blocks of
at most `block` (a bound on what is sent, not on how many items may be searched). Only confirmed pairs
leave the workers.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvelo.llm.words import WordHashes, plain_words, scramble, shingle_hashes

#: Words a shingle; containment is asked from about half an item upwards after light changes, which five
#: words in a row would seldom survive.
WIDTH = 3


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    state = scramble(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return state[:count] | np.uint64(1), state[count:]


class Searcher:
    """The signatures and shingles of one block of items."""

    def __init__(self, items: list[tuple[int, str]], least: float, permutations: int, growth: float) -> None:
        self.least, self.count = least, permutations
        self.hashes = WordHashes()
        self.ids, self.sets, self.lengths = [], [], []
        for item, text in items:
            shingles = shingle_hashes(self.hashes(plain_words(text)), WIDTH)
            if len(shingles):
                self.ids.append(item)
                self.sets.append(shingles)
                self.lengths.append(len(shingles) + WIDTH - 1)
        self.a, self.b = _permutations(permutations)
        classes: dict[int, list[int]] = {}
        for k, shingles in enumerate(self.sets):
            classes.setdefault(int(math.log(len(shingles), growth)), []).append(k)
        self.classes = []
        for own in classes.values():
            largest, smallest = max(len(self.sets[k]) for k in own), min(len(self.sets[k]) for k in own)
            step = max(1, math.ceil(largest / 2))
            # the similarity that an item of the partition has to a window which just contains enough of it
            inside = 0.8 * least * smallest
            alike = inside / (smallest + 3 * step - inside)
            needed = max(1, math.floor(permutations * alike - 2.5 * math.sqrt(permutations * alike * (1 - alike))))
            signatures = np.stack([self._permute(self.sets[k]).min(axis=1) for k in own])
            order = np.argsort(signatures, axis=0, kind="stable")
            self.classes.append((step, needed, np.array(own), np.take_along_axis(signatures, order, axis=0), order))

    def _permute(self, shingles: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (shingles[None, :] * self.a[:, None] + self.b[:, None]) >> np.uint64(32)

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """Pairs (place of the document, place of the item) whose signatures agree well enough."""
        sizes = np.array([len(t) for t in texts])
        if not sizes.sum():
            return set()
        flat, starts = np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        plans = []
        for step, *_ in self.classes:
            blocks = -(-sizes // step)
            owner = np.repeat(np.arange(len(texts)), blocks)
            place = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            plans.append((starts[owner] + place * step, owner))
        hits: list[list[np.ndarray]] = [[] for _ in self.classes]
        for k in range(self.count):
            with np.errstate(over="ignore"):
                values = (flat * self.a[k] + self.b[k]) >> np.uint64(32)
            for c, (_, _, own, signatures, order) in enumerate(self.classes):
                cut, owner = plans[c]
                low = np.minimum.reduceat(values, cut)
                for shift in (1, 2):
                    same = np.flatnonzero(owner[shift:] == owner[:-shift])
                    if shift == 1:
                        window = low.copy()
                    window[same] = np.minimum(window[same], low[same + shift])
                left, right = np.searchsorted(signatures[:, k], window, "left"), np.searchsorted(signatures[:, k], window, "right")
                found = np.flatnonzero(right > left)
                if len(found):
                    many = right[found] - left[found]
                    at = np.repeat(left[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    hits[c].append(np.repeat(found, many) * len(own) + order[at, k])
        pairs: set[tuple[int, int]] = set()
        for c, (_, needed, own, _, _) in enumerate(self.classes):
            if hits[c]:
                keys, times = np.unique(np.concatenate(hits[c]), return_counts=True)
                keys = keys[times >= needed]
                pairs.update(zip(plans[c][1][keys // len(own)].tolist(), own[keys % len(own)].tolist()))
        return pairs

    def coverage(self, document: np.ndarray, item: int) -> float:
        """The largest share of the item's words that shingles of the document cover in running order,
        within a stretch of the document of one and a half times the item's length."""
        shingles, length = self.sets[item], self.lengths[item]
        order = np.argsort(shingles, kind="stable")
        ranked = shingles[order]
        left, right = np.searchsorted(ranked, document, "left"), np.searchsorted(ranked, document, "right")
        at = np.flatnonzero(right > left)
        if len(at) + WIDTH - 1 < self.least * length / WIDTH:
            return 0.0
        spots = [(int(p), sorted((int(order[q]) for q in range(left[p], right[p])), reverse=True)) for p in at]
        span, best, ends = int(1.5 * length) + 10, 0.0, 0
        for first in range(len(spots)):
            ends = max(ends, first)
            while ends < len(spots) and spots[ends][0] < spots[first][0] + span:
                ends += 1
            if (ends - first) * WIDTH <= best * length:
                continue
            tails: list[int] = []
            chain: list[tuple[int, int | None]] = []
            tops: list[int] = []
            for p in range(first, ends):
                for q in spots[p][1]:
                    k = bisect_left(tails, q)
                    chain.append((q, tops[k - 1] if k else None))
                    if k == len(tails):
                        tails.append(q)
                        tops.append(len(chain) - 1)
                    else:
                        tails[k], tops[k] = q, len(chain) - 1
            step: int | None = tops[-1]
            words, before = 0, length
            while step is not None:
                q, step = chain[step]
                words += min(WIDTH, before - q)
                before = q
            best = max(best, words / length)
        return best

    def search(self, frames: Iterator[pd.DataFrame], chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame["text"].notna()]
            total = frame["text"].str.len().cumsum() // chars
            for _, part in frame.groupby(total, sort=False):
                texts = [shingle_hashes(self.hashes(plain_words(t)), WIDTH) for t in part["text"]]
                ids = part["doc_id"].tolist()
                rows = [(ids[d], self.ids[i], share) for d, i in self.candidates(texts) if (share := self.coverage(texts[d], i)) >= self.least]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage"])


def find_leaks(documents: DataFrame, items: DataFrame, least: float = 0.48, permutations: int = 128, growth: float = 1.4, block: int = 20_000) -> DataFrame:
    """Pairs (doc_id, item_id, coverage): documents (doc_id, text) holding at least the share `least` of an
    item's (item_id, text) words in running order.

    Null and empty texts, null ids and items under three words match nothing; repeated documents and items give one
    row a pair of ids; very long texts are searched whole. Blocks of `block` items are searched one after
    the other, each against all documents. Empty tables give an empty result.
    """
    spark, schema = documents.sparkSession, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, coverage double"
    wanted = items.where((F.length("text") > 0) & F.col("item_id").isNotNull()).select("item_id", "text")
    blocks = max(1, -(-wanted.count() // block))
    found = None
    for k in range(blocks):
        part = [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toLocalIterator()]
        sent = spark.sparkContext.broadcast(part)

        def search(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            yield from Searcher(sent.value, least, permutations, growth).search(frames)

        pairs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(search, schema)
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))
