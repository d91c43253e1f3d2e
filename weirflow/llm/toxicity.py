"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words of a text and the first ``BEGINNING`` letters of its longer words, all of them: the vocabulary is
that of the examples, without a choice or a bound. A term weighs (1 + log of its count) times its inverse document
frequency over *all* documents, times its relevance: the absolute correlation of its presence with the label over the
examples (a supervised TF-IDF; without it, words of one topic outweigh those that labels follow).

Fitting, on a bounded sample of labelled rows (of either label at most ``PER_CLASS`` rows and ``SAMPLE_CHARS``
characters, those whose hash of the id comes first; copies among them fold): examples become unit vectors in an
inverted index in blocks of ``WIDTH`` examples. Terms of few examples have sparse postings; those of more than one in
``FREQUENT`` have theirs as impacts by block, and the largest impact of every block. A query adds up the postings of its
rare terms, bounds each block by its best sum plus the largest impacts of the frequent terms, and adds their impacts from
the block with the highest bound on, until no bound reaches the ``K``-th best cosine found; so the K nearest are exact.

A score is the distance-weighted share of label 1 among the K nearest, each example weighed by what its
class's sample stands for, shrunk to the prior, and calibrated by isotonic regression of the labels on
the examples' own leave-one-out scores; 2 % of the score before calibration is mixed in, so that scores on one step of
the regression keep their order. The nearest examples are returned as evidence.

Inputs of a score are the words of the whole text only. Ids, languages, sources and labels of the row
that is scored do not enter.

Defined results: null and empty texts, and texts without any term of an example, get the calibrated score of a
text without neighbours; very long texts are read whole; repeated rows get equal scores; labels that are null are not
used, and of an id that is labelled twice the larger label counts; where the labels lack a class, every score is the share
of label 1 (0 without labels); an empty table gives an empty result; other columns do not enter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

PER_CLASS = 4000
SAMPLE_CHARS = 64_000_000
BEGINNING = 4
K, WIDTH, FREQUENT, SHRINK = 25, 256, 16, 0.5
#: Blocks of a text that are scored first, and texts that are scored together.
STEP, TOGETHER = 4, 256
THRESHOLD = 0.7
#: Words whose terms a worker remembers; beyond that it starts anew.
MEMORY = 200_000
_TERM = re.compile(r"\w+")


#: What a byte of a Latin-1 text is in its words: lower case, or a space between them.
_LATIN = bytes(ord(chr(b).lower()) if _TERM.match(chr(b)) else 32 for b in range(256))


def split(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    try:  # as the pattern has it, faster
        return (text or "").encode("latin-1").translate(_LATIN).decode("latin-1").split(" ")
    except UnicodeEncodeError:
        return _TERM.findall(text.lower())


def words(text: str | None) -> Counter[str]:
    found = Counter(split(text))
    found.pop("", None)
    return found


def terms_of(word: str) -> tuple[str, ...]:
    return (word, word[:BEGINNING] + "*") if len(word) > BEGINNING else (word,)


def terms(text: str | None) -> Counter[str]:
    """Every term of a text and how often it occurs."""
    out: Counter[str] = Counter()
    for word, n in words(text).items():
        for t in terms_of(word):
            out[t] += n
    return out


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def relevance(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Absolute correlation of a term's presence with the label, from the numbers of examples of either label that have it."""
    n, c, d = n1 + n0, n1 - with_1, n0 - with_0
    return np.abs(with_1 * d - with_0 * c) / np.sqrt(np.maximum((with_1 + with_0) * (c + d) * float(n1) * n0, 1e-9)) if n else np.zeros(len(with_1))


class Numbers(dict):
    """Word to the numbers of its two terms in one integer: the word's and, in the lower 32 bits, its beginning's, each plus one, 0 for none."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        get = self.vocabulary.get
        both = self[word] = get(word, -1) + 1 << 32 | (get(word[:BEGINNING] + "*", -1) + 1 if len(word) > BEGINNING else 0)
        return both

    def _both(self, found: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms of given words, -1 for none."""
        if len(self) > MEMORY:
            self.clear()
        both = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return (both >> 32) - 1, (both & 0xFFFFFFFF) - 1

    def terms(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(known terms, their counts) of one text."""
        found = words(text)
        at, begin = self._both(found)
        n = np.fromiter(found.values(), np.int64, len(found))
        whole, some = at >= 0, begin >= 0
        start, where = np.unique(begin[some], return_inverse=True)
        return np.concatenate([at[whole], start]), np.concatenate([n[whole], np.bincount(where, n[some], len(start)).astype(np.int64)])

    def present(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of both terms of every distinct word, -1 for none."""
        return self._both(set(split(text)))


@dataclass
class Index:
    """Examples in slots, ``width`` to a block: postings of rare terms, impacts and their largest of frequent ones."""

    vocabulary: dict[str, int]
    weight: np.ndarray  # of each term
    labels: np.ndarray  # of each slot
    weights: np.ndarray  # what an example stands for
    ids: np.ndarray
    prior: float
    steps: tuple[np.ndarray, np.ndarray]  # calibration: raw score, probability
    term_start: np.ndarray  # of rare terms; frequent ones have no postings
    term_slot: np.ndarray
    term_value: np.ndarray
    frequent: np.ndarray  # of each term, its row in the next two, or -1
    impacts: np.ndarray  # block, row, slot in the block
    most: np.ndarray  # row, block
    numbers: Numbers | None = None

    def __post_init__(self) -> None:
        self.term_size = np.diff(self.term_start)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, unit weights) of one text."""
        if self.numbers is None:
            self.numbers = Numbers(self.vocabulary)
        return _unit(*self.numbers.terms(text), self.weight)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(slots, cosines) of the k nearest examples with a positive cosine, best first, ties by slot, of each of a few texts."""
        blocks, frequent, width = self.impacts.shape
        few, n = len(vectors), blocks * width
        wide, rare_sums = np.zeros((few, frequent), np.float32), np.empty((few, n))
        for q, (at, w) in enumerate(vectors):
            row = self.frequent[at]
            rare = row < 0
            wide[q, row[~rare]] = w[~rare]
            start, size = self.term_start[at[rare]], self.term_size[at[rare]]
            places = np.repeat(start - np.cumsum(size) + size, size)
            places += np.arange(len(places))
            rare_sums[q] = np.bincount(np.take(self.term_slot, places), np.repeat(w[rare].astype(np.float32), size) * np.take(self.term_value, places), n)
            if skip:
                rare_sums[q, skip[q]] = -np.inf
        sums = rare_sums.astype(np.float32).reshape(few, blocks, width)
        bound = sums.max(axis=2) + wide @ self.most
        # the blocks of the highest bounds tell how far down to go
        first = np.argsort(-bound, axis=1)[:, :STEP]
        need = np.zeros((few, blocks), bool)
        np.put_along_axis(need, first, True, axis=1)
        self._add(sums, wide, need)
        floor = np.zeros(few, np.float32)
        if first.shape[1] * width > k:
            reached = np.take_along_axis(sums, first[:, :, None], axis=1).reshape(few, -1)
            floor = np.partition(reached, reached.shape[1] - k, axis=1)[:, reached.shape[1] - k]
        floor = np.maximum(floor - 1e-5, 0)
        more = (bound > floor[:, None]) & ~need
        self._add(sums, wide, more)
        out, need = [], need | more
        for q, (at, w) in enumerate(vectors):
            slots = np.flatnonzero((sums[q] > floor[q]) & need[q][:, None])
            if len(slots) > k:
                reached = sums[q].ravel()[slots]
                slots = slots[reached > np.partition(reached, len(slots) - k)[len(slots) - k] - 1e-5]
            slots = slots[slots < len(self.labels)]
            # those that may be among the nearest, added up in an order that no other text has a part in
            row = self.frequent[at]
            own = self.impacts[(slots // width)[:, None], row[row >= 0][None, :], (slots % width)[:, None]]
            cosines = rare_sums[q, slots] + (own * w[row >= 0]).sum(axis=1)
            slots, cosines = slots[cosines > 0], cosines[cosines > 0]
            best = np.lexsort((slots, -cosines))[:k]
            out.append((slots[best], cosines[best]))
        return out

    def _add(self, sums: np.ndarray, wide: np.ndarray, need: np.ndarray) -> None:
        """Impacts of the frequent terms, in the blocks that texts need."""
        for b in np.flatnonzero(need.any(axis=0)):
            some = np.flatnonzero(need[:, b])
            if len(some) == len(need):
                sums[:, b] += wide @ self.impacts[b]
            else:
                sums[some, b] += wide[some] @ self.impacts[b]

    def vote(self, slots: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1, an example at distance d weighing (1 - d)^2 times what it stands for."""
        w = cosines**2 * self.weights[slots]
        return float(((w * self.labels[slots]).sum() + SHRINK * self.prior) / (w.sum() + SHRINK))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        x, y = self.steps
        return np.clip(0.98 * np.interp(raw, x, y) + 0.02 * raw, 0, 1) if len(x) else np.asarray(raw, float)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means of y that do not fall as x grows, given at the ends of their pools."""
    at, tie = np.unique(x, return_inverse=True)  # equal scores are one point
    pools: list[list[float]] = []  # sum of wy, sum of w, first x, last x
    for a, s, n in zip(at, np.bincount(tie, y * w), np.bincount(tie, w)):
        pools.append([s, n, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    return xs, np.repeat([p[0] / p[1] for p in pools], 2)


def _unit(at: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(n)) * weight[at]
    norm = np.sqrt((w * w).sum())
    return (at, w / norm) if norm else (at[:0], w[:0])


def _sparse(rows: np.ndarray, n: int) -> np.ndarray:
    """Starts of ``n`` sorted rows."""
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def build(examples: list[tuple[object, str | None, int]], vocabulary: list[str], df: np.ndarray, n_docs: int, stands: tuple[float, float] = (1.0, 1.0), width: int = WIDTH) -> Index:
    """Index of (id, text, label) with the document frequencies of all their terms over the corpus."""
    labels = np.array([y for _, _, y in examples])
    number = {t: i for i, t in enumerate(vocabulary)}
    numbers = Numbers(number)
    vectors = [numbers.terms(t) for _, t, _ in examples]
    seen = np.zeros((2, len(number)))
    for (at, _), y in zip(vectors, labels):
        seen[y, at] += 1
    idf = np.log((1 + n_docs) / (1 + df)) + 0.05
    weight = idf * relevance(seen[1], seen[0], int(labels.sum()), int((1 - labels).sum()))
    vectors = [_unit(at, n, weight) for at, n in vectors]
    # examples whose weightiest term is the same stand together, which makes the bounds of blocks tight
    lead = [(int(at[np.argmax(w)]), -float(w.max())) if len(at) else (len(number), 0.0) for at, w in vectors]
    order = sorted(range(len(examples)), key=lambda i: (lead[i], i))
    blocks = -(-len(order) // width)
    slot_start = np.concatenate([[0], np.cumsum([len(vectors[i][0]) for i in order])])
    term = np.concatenate([vectors[i][0] for i in order]).astype(np.int32)
    value = np.concatenate([vectors[i][1] for i in order]).astype(np.float32)
    slot = np.repeat(np.arange(len(order), dtype=np.int32), np.diff(slot_start))
    count = np.bincount(term, minlength=len(number))
    frequent = np.full(len(number), -1, np.int32)
    often = np.flatnonzero(count * FREQUENT > len(order))
    frequent[often] = np.arange(len(often))
    impacts = np.zeros((blocks, len(often), width), np.float32)
    own = frequent[term] >= 0
    impacts[slot[own] // width, frequent[term[own]], slot[own] % width] = value[own]
    term, slot, value = term[~own], slot[~own], value[~own]
    by_term = np.argsort(term, kind="stable")
    term_start, slot, value = _sparse(term, len(number)), slot[by_term], value[by_term]
    del term, by_term, own
    prior = float((labels * stands[1]).sum() / max((labels * stands[1] + (1 - labels) * stands[0]).sum(), 1e-9))
    weights = np.array([stands[labels[i]] for i in order], float)
    index = Index(
        number, weight, labels[order], weights / max(weights.max(initial=0), 1e-9), np.array([examples[i][0] for i in order], object), prior, (np.empty(0), np.empty(0)),
        term_start, slot, value, frequent, impacts, np.ascontiguousarray(impacts.max(axis=2, initial=0).T),
    )
    raw = []
    for at in range(0, len(order), 64):  # fewer at once than on executors: the driver has less room
        some = order[at : at + 64]
        raw += [index.vote(*x) for x in index.nearest([vectors[i] for i in some], skip=list(range(at, at + len(some))))]
    raw = np.array(raw)
    index.steps = isotonic(raw, index.labels.astype(float), index.weights)
    return index


def _count(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """Document frequencies of the examples' terms, and the number of documents, over all rows."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers({t: i for i, t in enumerate(known.value)})
        n, rows = np.zeros(len(numbers.vocabulary) + 1, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for t in b.column(0):
                for own in numbers.present(t.as_py()):
                    n[own] += 1  # a place that is named twice goes up once; the last one is that of terms not known
        n[-1] = rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term of the examples
    known.unpersist()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _within(rows: list[tuple[int, int, int]], most: int) -> list[int]:
    """Ids of (id, label, characters), in order, that a label's share of characters has room for."""
    out, held = [], Counter()
    for i, y, n in rows:
        if held[y] + n <= most:
            held[y] += n
            out.append(i)
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, chars: int = SAMPLE_CHARS) -> Index | float:
    """The index, or the share of label 1 where the labels lack a class. ``labels``: doc_id and toxic, the rows to learn from."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = cut(known)
    sizes = dict(known.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return float(next(iter(sizes), 0))
    first = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = first(0).union(first(1)).select(F.col("doc_id").alias("__id"), "toxic")  # at most 2 * per_class rows
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    texts = cut(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))  # rows that repeat an id
    lengths = texts.select("doc_id", "toxic", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    chosen = _within([(r["doc_id"], r["toxic"], r["n"]) for r in sorted(lengths, key=lambda r: (r["h"], r["doc_id"]))], chars)
    if len(chosen) < len(lengths):
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "__id long")), F.col("doc_id") == F.col("__id"), "left_semi")
    examples, seen = [], set()
    for r in sorted(texts.collect(), key=lambda r: r["doc_id"]):  # at most 2 * chars characters
        if (key := (r["text"], r["toxic"])) not in seen:
            seen.add(key)
            examples.append((r["doc_id"], r["text"], int(r["toxic"])))
    if len({y for _, _, y in examples}) < 2:
        return sizes.get(1, 0) / sum(sizes.values())
    every: set[str] = set()
    for _, text, _ in examples:
        every.update(words(text))
    vocabulary = sorted({t for w in every for t in terms_of(w)})
    df, n = _count(docs, vocabulary)
    got = Counter(y for _, _, y in examples)
    return build(examples, vocabulary, df, n, (sizes[0] / got[0], sizes[1] / got[1]))


def score(docs: DataFrame, index: Index | float) -> DataFrame:
    """doc_id, score, n_neighbours and evidence (the three nearest examples: id, label, cosine)."""
    schema = docs.select("doc_id").withColumns({"score": F.lit(0.0), "n_neighbours": F.lit(0).cast("long"), "evidence": F.lit("")}).schema
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by what the examples hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            raw, count, proof = np.full(b.num_rows, ix if isinstance(ix, float) else ix.prior), np.zeros(b.num_rows, np.int64), [""] * b.num_rows
            if not isinstance(ix, float):
                for first in range(0, b.num_rows, TOGETHER):
                    some = b.column(1).slice(first, TOGETHER)
                    for i, (slots, cosines) in enumerate(ix.nearest([ix.vector(t.as_py()) for t in some]), first):
                        raw[i], count[i] = ix.vote(slots, cosines), len(slots)
                        proof[i] = ",".join(f"{ix.ids[s]}:{ix.labels[s]}:{c:.3f}" for s, c in zip(slots[:3], cosines[:3]))
                raw = ix.calibrated(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw), pa.array(count), pa.array(proof)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op2: score of every document, learnt from the labels that are not held out."""
    index = fit(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    return score(docs, index).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_neighbours", "evidence")
