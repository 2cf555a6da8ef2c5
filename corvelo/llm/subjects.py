"""Problem 9: the subject areas of documents.

Labelling functions look at a document and a subject: seed words of the subject's description, a lexicon
learnt from the corpus, how many sentences it marks, which sections it leads, the title, and the source's
address. Each votes yes, no or not at all. A latent-variable model learns from the agreement of the votes
alone how accurate every function is, and a document gets the subjects of posterior one half or more.

The lexicon comes from counts over all documents: hand labels where there are some, elsewhere what the
seed words say, then once more with the first lexicon in their place. A text is read once, into hashes of
its words; counting and looking up go on arrays of these in the workers. The lexicon is a table: scoring
takes it in blocks of some `block` terms, of which the driver holds one at a time. The model sees the
table of vote patterns, which has at most 3^6 rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvelo.llm.words import WordHashes, plain_words, scramble, shingle_hashes
from corvelo.session import cut_lineage, drop_cut

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_END = re.compile(r"[.!?][\"')\]]*\s*$")
_FUNCTIONS = ("seed", "share", "count", "section", "title", "address")


def sentences(text: str | None) -> list[tuple[int, str]]:
    """(paragraph, plain words) of the sentences of a text: four words at least and a closing mark, so
    that navigation, headings and code do not count. None for null."""
    found = []
    for k, part in enumerate(_PARAGRAPH.split(_FENCE.sub("\n\n", text or ""))):
        for piece in _SENTENCE.split(part):
            if _END.search(piece) and len(words := plain_words(piece)) >= 4:
                found.append((k, " ".join(words)))
    return found


def word_hashes(words: list[str], known: WordHashes) -> np.ndarray:
    """Hashes of words; the last bit tells whether a word has three letters at least and counts by itself."""
    return known(words) & ~np.uint64(1) | np.fromiter((len(w) > 2 for w in words), dtype=np.uint64, count=len(words))


def terms(words: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words and of neighbouring words of a sentence, and the sentence of each."""
    alone = (words & np.uint64(1)).astype(bool)
    together = sentence[:-1] == sentence[1:]
    with np.errstate(over="ignore"):
        pairs = scramble(scramble(words[:-1] + np.uint64(1)) + words[1:])[together]
    return np.concatenate([words[alone], pairs]), np.concatenate([sentence[alone], sentence[:-1][together]])


def seed_terms(subjects: DataFrame) -> dict[str, str]:
    """The listed words of the closed list's descriptions, by term (subject areas are few). Words at the edge
    of an entry that most descriptions hold are not part of it."""
    found: dict[str, str] = {}
    rows = subjects.collect()
    for column in ("description_en", "description_pt"):
        texts = [(row["subject"], row[column] or "") for row in rows]
        held = Counter(w for _, text in texts for w in set(plain_words(text)))
        usual = {w for w, n in held.items() if n > len(texts) / 2 and len(texts) > 2}
        for subject, text in texts:
            for entry in text.split(","):
                words = plain_words(entry)
                while words and words[0] in usual:
                    words = words[1:]
                while words and words[-1] in usual:
                    words = words[:-1]
                if words:
                    found[" ".join(words)] = subject
    return found


def _read(documents: DataFrame, seeds: dict[str, str], names: list[str]) -> DataFrame:
    """Documents as hashes: `words` with the sentence `at` of each, the paragraph `place` and the hash `mark` of each
    sentence, the words of the `title`, and the seeds found (`seed_at` sentence, `seed_of` subject). A sentence
    that a text repeats counts once."""
    place = {n: k for k, n in enumerate(names)}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sought = WordHashes(), {}
        for term, subject in seeds.items():
            words = word_hashes(term.split(" "), known)
            sought.setdefault(len(words), {})[int(shingle_hashes(words, len(words))[0])] = place[subject]
        for frame in frames:
            rows = []
            for text, title in zip(frame["text"], frame["title"]):
                words, at, paragraphs, marks, seen = [], [], [], [], set()
                for paragraph, sentence in sentences(text):
                    if sentence not in seen:
                        seen.add(sentence)
                        own = sentence.split(" ")
                        words += own
                        at += [len(paragraphs)] * len(own)
                        paragraphs.append(paragraph)
                        marks.append(xxhash.xxh64_intdigest(sentence))
                hashes, at = word_hashes(words, known), np.array(at, dtype=np.int32)
                hits = []
                for size, by in sought.items():
                    runs = shingle_hashes(hashes, size)
                    for k in np.nonzero(np.isin(runs, np.fromiter(by, dtype=np.uint64, count=len(by))))[0]:
                        if at[k] == at[k + size - 1]:
                            hits.append((at[k], by[int(runs[k])]))
                rows.append((hashes.view(np.int64), at, np.array(paragraphs, dtype=np.int32), np.array(marks, dtype=np.uint64).view(np.int64), word_hashes(plain_words(title), known).view(np.int64), [h[0] for h in hits], [h[1] for h in hits]))
            out = pd.DataFrame(rows, columns=["words", "at", "place", "mark", "title", "seed_at", "seed_of"], dtype=object)
            yield pd.concat([frame[["doc_id", "source"]].reset_index(drop=True), out], axis=1)

    kind = documents.schema["doc_id"].dataType.simpleString()
    held = documents.where("doc_id IS NOT NULL").select("doc_id", F.col("source").cast("string"), "title", "text")
    return held.mapInPandas(read, f"doc_id {kind}, source string, words array<bigint>, at array<int>, place array<int>, mark array<bigint>, title array<bigint>, seed_at array<int>, seed_of array<int>")


def _flat(frame: pd.DataFrame, words: str, at: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all rows of a frame, the row of each, and its sentence."""
    sizes = [len(w) for w in frame[words]]
    if not sum(sizes):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    row = np.repeat(np.arange(len(frame), dtype=np.int64), sizes)
    sentence = np.concatenate(frame[at].tolist()).astype(np.int64) if at else np.zeros(len(row), dtype=np.int64)
    found, both = terms(np.concatenate(frame[words].tolist()).astype(np.int64).view(np.uint64), row << 32 | sentence)
    return found, both >> 32, both & 0xFFFFFFFF


def _hits(rows: DataFrame, lexicon: DataFrame, names: list[str], block: int, words: str = "words", at: str | None = "at") -> DataFrame:
    """(doc_id, mark, place, subject, hits) for each sentence and subject of which a lexicon (term, k) finds `hits` terms in
    it, read from `rows` by blocks of the lexicon."""
    spark, found = rows.sparkSession, None
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = max(1, -(-lexicon.count() // min(block, 2**19)))  # hashed, a block stays below 2^20
    used = rows.select("doc_id", words, *([at, "place", "mark"] if at else []))
    for n in range(blocks):
        held = lexicon.where(F.pmod("term", F.lit(blocks)) == n).toPandas().sort_values("term", key=lambda t: t.to_numpy().view(np.uint64))
        sent = spark.sparkContext.broadcast((held["term"].to_numpy(dtype=np.int64).view(np.uint64), held["k"].to_numpy(dtype=np.int64)))

        def look(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            sought, of = sent.value
            for frame in frames:
                term, row, sentence = _flat(frame, words, at)
                spot = np.minimum(np.searchsorted(sought, term), max(len(sought) - 1, 0))
                same = sought[spot] == term if len(sought) else np.zeros(len(term), dtype=bool)
                # each term of a sentence once, in one number of row, sentence and term; then of row, sentence and subject
                key = np.unique(row[same] << 44 | sentence[same] << 20 | spot[same])
                key, n = np.unique(key >> 20 << 20 | (of[key & 0xFFFFF] if len(sought) else 0), return_counts=True)
                row, sentence = key >> 44, key >> 20 & 0xFFFFFF
                out = {"doc_id": frame["doc_id"].to_numpy()[row], "k": (key & 0xFFFFF).astype(np.int32), "hits": n.astype(np.int32)}
                for c in ("mark", "place"):
                    if at:
                        first = np.concatenate([[0], np.cumsum([len(x) for x in frame[c]])])[:-1]
                        out[c] = np.concatenate([*frame[c], np.empty(0, dtype=np.int64)]).astype(np.int64)[first[row] + sentence]
                    else:
                        out[c] = np.zeros(len(key), dtype=np.int64)
                yield pd.DataFrame(out)[["doc_id", "mark", "place", "k", "hits"]]

        part = used.mapInPandas(look, f"doc_id {kind}, mark bigint, place bigint, k int, hits int")
        if blocks > 1:  # the broadcast block goes before the next one comes
            part = cut_lineage(part)
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("doc_id", "mark", "k").agg(F.min("place").alias("place"), F.sum("hits").alias("hits"))
    return found.select("doc_id", "mark", "place", _named("k", names).alias("subject"), "hits")


def _named(k: str, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col(k) + 1)


def _labels(hits: DataFrame, least: int = 2, share: float = 0.25) -> DataFrame:
    """Subjects (doc_id, subject) with enough of a document's marked sentences."""
    counts = hits.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(counts.groupBy("doc_id").agg(F.sum("k").alias("m")), "doc_id").where((F.col("k") >= least) & (F.col("k") >= share * F.col("m"))).select("doc_id", "subject")


def learn_terms(rows: DataFrame, labels: DataFrame, names: list[str], least: int = 3, share: float = 0.6, score: float = 5.0, words: str = "words", at: str | None = "at") -> DataFrame:
    """Terms (term, k: the place of their subject) that go with one subject: in `least` labelled documents at
    least, the share `share` of them of that subject, `score` standard deviations above chance."""
    held = rows.select("doc_id", words, *([at] if at else [])).join(labels.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")), "doc_id")
    place = {s: k for k, s in enumerate(names)}
    width = len(names) + 1

    def summed(term: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(term, kind="stable")
        term, counts = term[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, dtype=int)
        return term[starts], np.add.reduceat(counts, starts, axis=0) if len(starts) else counts

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = [], 0

        def flush() -> pd.DataFrame:
            term, counts = summed(np.concatenate([t for t, _ in kept]), np.concatenate([c for _, c in kept]))
            return pd.DataFrame({"term": term.view(np.int64)} | {f"n{k}": counts[:, k] for k in range(width)})

        for frame in frames:
            marks = np.zeros((len(frame), width), dtype=np.int32)
            marks[:, -1] = 1
            for r, own in enumerate(frame["subjects"]):
                marks[r, [place[s] for s in own if s in place]] = 1
            term, row, _ = _flat(frame, words, at)
            order = np.lexsort((row, term))
            term, row = term[order], row[order]
            fresh = np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])]) if len(term) else np.empty(0, dtype=bool)
            # the documents themselves count under term 0
            kept += [summed(term[fresh], marks[row[fresh]]), summed(np.zeros(len(frame), dtype=np.uint64), marks)]
            size += sum(len(t) for t, _ in kept[-2:])
            if size > 1_000_000:
                yield flush()
                kept, size = [], 0
        if kept:
            yield flush()

    counted = held.mapInPandas(count, ", ".join(["term bigint", *(f"n{k} int" for k in range(width))]))
    n = F.col(f"n{width - 1}")
    counted = cut_lineage(counted.groupBy("term").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(width))).where((n >= least) | (F.col("term") == 0)))
    base = counted.where("term = 0").first()
    if base is None:
        return counted.select("term", F.lit(0).alias("k"))
    total = base[f"n{width - 1}"]
    best = F.greatest(*(F.struct(F.col(f"n{k}").alias("v"), F.lit(k).alias("k"), F.lit(max(0.02, min(0.98, base[f"n{k}"] / total))).alias("p")) for k in range(len(names))))
    kept = counted.where((F.col("term") != 0) & (n >= least)).withColumn("b", best).where(F.col("b.v") >= share * n)
    kept = kept.where(F.col("b.v") - n * F.col("b.p") >= score * F.sqrt(n * F.col("b.p") * (1 - F.col("b.p"))))
    found = cut_lineage(kept.select("term", "b.k"))
    drop_cut(counted)
    return found


def learn_votes(patterns: pd.DataFrame, turns: int = 100, prior: float = 0.4) -> np.ndarray:
    """Posteriors of vote patterns (columns of votes -1, 0, 1 and `n`) under a model in which each function
    has its own rates of yes, no and silence for true and for false pairs, learnt by expectation and
    maximisation from the votes alone."""
    votes, n = patterns[list(_FUNCTIONS)].to_numpy() + 1, patterns["n"].to_numpy(dtype=float)
    yes, no = (votes == 2).sum(axis=1), (votes == 0).sum(axis=1)
    truth = np.clip((yes + 0.5) / (yes + no + 1), 0.05, 0.95)
    for _ in range(turns):
        weight = np.stack([n * (1 - truth), n * truth])
        logs = np.zeros((2, len(n)))
        for c in range(2):
            for f in range(votes.shape[1]):
                rates = np.bincount(votes[:, f], weights=weight[c], minlength=3) + 1.0
                logs[c] += np.log(rates / rates.sum())[votes[:, f]]
        share = (weight[1].sum() + prior * 10) / (n.sum() + 10)
        new = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - share) - logs[1] - np.log(share), -50, 50)))
        if np.abs(new - truth).max() < 1e-6:
            break
        truth = new
    return new


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def assign_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, block: int = 500_000) -> DataFrame:
    """Subjects of documents (doc_id, subject, posterior), all of posterior one half or more, for every
    document (doc_id, text, title, source), given hand labels (doc_id, subject).

    Texts without sentences (null, empty, navigation only) and rows without id get none, and no document gets a subject that
    no sentence of it shows. Repeated rows of a document count once. Any number of subjects may be given
    to one document. Empty tables give an empty result.
    """
    names = sorted(r[0] for r in subjects.where("subject IS NOT NULL").select("subject").distinct().collect())  # the closed list
    seeds = {t: s for t, s in seed_terms(subjects).items() if s is not None}
    rows = cut_lineage(_read(documents, seeds, names))
    by_hand = labels.where(F.col("subject").isin(names)).select("doc_id", "subject").distinct()
    found = rows.select("doc_id", F.explode(F.arrays_zip("seed_at", "seed_of")).alias("s"), "mark", "place")
    at = F.col("s.seed_at") + 1
    seed_hits = found.select("doc_id", F.element_at("mark", at).alias("mark"), F.element_at("place", at).alias("place"), F.col("s.seed_of").alias("k")).distinct()
    seed_hits = cut_lineage(seed_hits.select("doc_id", "mark", "place", _named("k", names).alias("subject")))

    def together(hits: DataFrame) -> DataFrame:
        return by_hand.unionByName(_labels(hits).join(by_hand, "doc_id", "left_anti"))

    first = learn_terms(rows, together(seed_hits), names)
    settled = cut_lineage(together(_hits(rows, first, names, block)))
    lexicon = learn_terms(rows, settled, names)
    drop_cut(first, settled)
    hits = cut_lineage(_hits(rows, lexicon, names, block))
    settled = cut_lineage(together(hits))
    of_title = learn_terms(rows, settled, names, words="title", at=None)
    counts = hits.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("k"))
    marked = counts.groupBy("doc_id").agg(F.sum("k").alias("m"))
    seeded = seed_hits.groupBy("doc_id", "subject").agg(F.count_distinct("mark").alias("seeds"))
    any_seed = seeded.groupBy("doc_id").agg(F.sum("seeds").alias("all_seeds"))
    sections = hits.groupBy("doc_id", "place", "subject").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id", "place").agg(F.max_by("subject", F.struct("k", "subject")).alias("subject"))
    led = sections.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("led"))
    all_sections = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))
    size = rows.groupBy("doc_id").agg(F.max(F.size("place")).alias("n"), F.max("source").alias("source"))
    titled = _hits(rows.where(F.size("title") > 0), of_title, names, block, "title", None).groupBy("doc_id", "subject").agg(F.sum("hits").alias("titled"))
    any_title = titled.groupBy("doc_id").agg(F.sum("titled").alias("all_titled"))
    # a source's address speaks for a subject that most of its settled documents have
    hosts = size.where(F.length("source") > 0).join(settled.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    at_host = size.where(F.length("source") > 0).join(settled, "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("own")).join(hosts, "source").where("docs >= 5").select("source", "subject", (F.col("own") / F.col("docs")).alias("lean"))
    table = counts.join(marked, "doc_id").join(size, "doc_id")
    for other, key in ((seeded, ["doc_id", "subject"]), (any_seed, ["doc_id"]), (led, ["doc_id", "subject"]), (all_sections, ["doc_id"]), (titled, ["doc_id", "subject"]), (any_title, ["doc_id"]), (at_host, ["source", "subject"])):
        table = table.join(other, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.col("k") / F.col("m")
    votes = table.select(
        "doc_id",
        "subject",
        _vote((zero("seeds") >= 2) & (zero("seeds") >= 0.3 * zero("all_seeds")), (zero("all_seeds") >= 2) & (zero("seeds") < 0.2 * zero("all_seeds"))).alias("seed"),
        _vote(share >= 0.3, share <= 0.22).alias("share"),
        _vote((F.col("k") >= 2) & (F.col("k") >= 0.2 * F.col("n")) | (F.col("k") >= 0.3 * F.col("n")), (F.col("k") == 1) & (F.col("n") > 5) | (F.col("k") < 0.12 * F.col("n"))).alias("count"),
        _vote(zero("led") >= 0.3 * zero("sections"), zero("led") == 0).alias("section"),
        _vote(zero("titled") > 0, (zero("titled") == 0) & (zero("all_titled") > 0)).alias("title"),
        _vote(F.coalesce("lean", F.lit(0.1)) >= 0.6, F.coalesce("lean", F.lit(0.1)) < 0.02).alias("address"),
    )
    votes = cut_lineage(votes)
    drop_cut(rows, hits, seed_hits, settled, lexicon, of_title)
    patterns = votes.groupBy(*_FUNCTIONS).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if patterns.empty:
        return votes.select("doc_id", "subject", F.lit(0.0).alias("posterior"))
    patterns["posterior"] = learn_votes(patterns)
    answer = documents.sparkSession.createDataFrame(patterns[[*_FUNCTIONS, "posterior"]])  # at most 3^6 rows
    return votes.join(F.broadcast(answer), list(_FUNCTIONS)).where("posterior >= 0.5").select("doc_id", "subject", "posterior")
