"""Benchmark decontamination by spaced-seed hashing.

A mask of fixed offsets reads some of the words in a window and ignores the others, so that a hash of the
read words still agrees where ignored words were substituted. Hashes of the benchmark items under every
mask are joined with those of the documents; each hit names a diagonal (document position less item
position), the whole of which is compared word by word. A document is contaminated where a window of a
diagonal that begins and ends in an equal word has at least ``MIN_WORDS`` words and ``MIN_AGREE`` of them equal, or
where the whole item, of at least ``MIN_ITEM`` words, stands there with ``MIN_AGREE`` of its words equal.

The masks hit every such window. One of n words with at most n / 5 others has a run of four equal ones from 16 words
on; below, what has no such run has three equal words, another and an equal one.

The benchmark is the bounded side: it is read in blocks of items of at most ``BLOCK_CHARS`` characters, and
only one block's index is broadcast at a time, whatever the benchmark's size. In a document, a word
that occurs in no item of the block is 0 and cannot be read by a matching mask, so most positions are
dropped before any hash is made; the hash join is a search in the block's sorted hashes, next to the text.

Words are runs of non-space, lower-cased (A-Z), with ASCII punctuation at their ends removed; in scripts without
spaces each character is a word.

Defined results: null and empty texts are clean; repeated rows are judged each on their own; items that
are null, or shorter than a mask (four words), match nothing, those of fewer than ``MIN_ITEM`` words only as exact copies; repeated items are reported each; empty tables
give empty results (documents) or none contaminated (benchmark); :func:`clean_documents` carries all
columns whatever their names are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Offsets that a mask reads.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4))
MIN_WORDS, MIN_AGREE = 13, 0.8
#: Words from which an item may differ in some.
MIN_ITEM = 8
#: Words that are compared at once.
AT_ONCE = 1 << 18
BLOCK_CHARS = 16_000_000
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Characters of scripts without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han): each is a word; and the punctuation between them.
_UNSPACED = re.compile("([\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_WIDE = re.compile("[\u3000-\u3004\u3008-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def tokens(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", _WIDE.sub(" ", text))
    words = (w.strip(_STRIP) for w in text.encode("utf-8", "surrogatepass").lower().split())
    return [w for w in words if w]


@dataclass
class Index:
    """One block of the benchmark: word numbers from 1, items laid end to end with gaps of 0."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # int32, all items, each followed by 0
    item: np.ndarray  # item number of every position
    bounds: np.ndarray  # first position of every item, and the end
    ids: list
    hashes: list[np.ndarray]  # for each mask, sorted
    places: list[np.ndarray]  # the positions in the same order
    factors: list[np.ndarray]


def _factors(mask: tuple[int, ...]) -> np.ndarray:
    x = np.array([(i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for i in mask], np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(27) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(33)


def masked(words: np.ndarray, mask: tuple[int, ...], factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows all of whose read words are numbered."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = words != 0
    ok = known[mask[0] : mask[0] + n].copy()
    for o in mask[1:]:
        ok &= known[o : o + n]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for o, f in zip(mask, factors):
        h = _mix(h ^ words[at + o].astype(np.uint64) * f)
    return at, h


def build(items: list[tuple[object, str | None]], masks: tuple[tuple[int, ...], ...] = MASKS) -> Index:
    vocabulary: dict[bytes, int] = {}
    parts, bounds = [], [0]
    for _, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(text)]
        parts.append(np.array([*own, *[0] * (masks[-1][-1] + 1)], np.int32))  # no window reaches into the next item
        bounds.append(bounds[-1] + len(parts[-1]))
    words = np.concatenate(parts) if parts else np.empty(0, np.int32)
    item = np.repeat(np.arange(len(parts)), np.diff(bounds)) if parts else np.empty(0, np.int64)
    factors = [_factors(m) for m in masks]
    hashes, places = [], []
    for m, f in zip(masks, factors):
        at, h = masked(words, m, f)
        order = np.argsort(h, kind="stable")
        hashes.append(h[order])
        places.append(at[order])
    return Index(vocabulary, words, item, np.array(bounds), [i for i, _ in items], hashes, places, factors)


def _windows(equal: np.ndarray, least: int, agree: float) -> list[tuple[int, int]]:
    """Windows of ``least`` words or more with their share of equal ones, an equal one at either end: the longest, then those beside it."""
    share = Fraction(agree).limit_denominator(1000)
    out, rest = [], [(0, len(equal))]
    while rest:
        lo, hi = rest.pop()
        at = np.flatnonzero(equal[lo:hi])
        if hi - lo < least or not len(at):
            continue
        gain = np.arange(len(at)) * share.denominator
        # a window from the i-th equal word to the j-th qualifies where after[j] >= before[i]
        before, after = gain - share.numerator * at, gain + share.denominator - share.numerator * (at + 1)
        most = np.maximum.accumulate(after[::-1])[::-1]
        j = np.searchsorted(-most, -before, side="right") - 1
        length = np.where(j >= np.arange(len(at)), at[j] + 1 - at, 0)
        i = int(length.argmax())
        if length[i] >= least:
            s = lo + int(at[i])
            e = s + int(length[i])
            out.append((s, e))
            rest += [(lo, s), (e, hi)]
    return out


def _diagonals(words: np.ndarray, index: Index, masks: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(item number, document position less item position) of every diagonal that a mask hits, once each."""
    found = []
    for m, f, hashes, places in zip(masks, index.factors, index.hashes, index.places):
        at, h = masked(words, m, f)
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        n = hi - lo
        if n.any():
            p = places[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found.append(index.item[p] << 40 | np.repeat(at, n) - p + (1 << 39))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.unique(np.concatenate(found))
    return key >> 40, (key & (1 << 40) - 1) - (1 << 39)


def overlaps(text: str | None, index: Index, masks: tuple[tuple[int, ...], ...] = MASKS, min_words: int = MIN_WORDS, agree: float = MIN_AGREE) -> list[tuple[object, int, int, int]]:
    """(item id, first word, end word, words equal) of every verified overlap of one text with the block's items."""
    own = tokens(text)
    words = np.fromiter((index.vocabulary.get(w, 0) for w in own), np.int32, len(own))
    items, shift = _diagonals(words, index, masks)
    first, last = index.bounds[items], index.bounds[items + 1] - masks[-1][-1] - 1
    size = last - first
    need = np.where(size < MIN_ITEM, size, np.ceil(agree * np.minimum(size, min_words) - 1e-9)).astype(np.int64)
    lo, hi = np.maximum(first, -shift), np.minimum(last, len(words) - shift)
    out = []
    edges = [0, *np.flatnonzero(np.diff(np.cumsum(hi - lo) // AT_ONCE)) + 1, len(items)] if len(items) else []
    for a, b in zip(edges, edges[1:]):
        n = (hi - lo)[a:b]
        start = np.cumsum(n) - n
        p = np.repeat(lo[a:b] - start, n) + np.arange(n.sum())
        equal = words[p + np.repeat(shift[a:b], n)] == index.words[p]
        for k in np.flatnonzero(np.add.reduceat(equal, start, dtype=np.int64) >= need[a:b]):
            eq, w = equal[start[k] : start[k] + n[k]], size[a + k]
            runs = _windows(eq, min_words, agree) if w >= min_words else []
            if not runs and n[k] == w and eq.sum() >= (agree * w - 1e-9 if w >= MIN_ITEM else w):
                runs = [(0, int(w))]
            at = int(lo[a + k] + shift[a + k])
            out += [(index.ids[items[a + k]], at + s, at + e, int(eq[s:e].sum())) for s, e in runs]
    return sorted(out, key=lambda x: (x[1], x[2], str(x[0])))


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most ``chars`` characters (or one item), streamed to the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(f"`{item}`"), F.col(f"`{text}`")).orderBy(F.col(f"`{item}`"), F.col(f"`{text}`")).toLocalIterator():
        if block and size + len(r[1] or "") > chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1] or "")
    if block:
        yield block


SPANS = "array<struct<item:string,first:long,end:long,equal:long>>"


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` plus ``__hits``: the verified overlaps (item, first word, end word, equal words), over all blocks."""
    out = docs.withColumn("__hits", F.array().cast(SPANS))
    kind = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("equal", pa.int64())]))
    for items in blocks(benchmark, chars=chars):
        shared = docs.sparkSession.sparkContext.broadcast(build(items))
        at, schema = out.columns.index(text), out.schema

        def run(batches: Iterator[pa.RecordBatch], at: int = at, shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                new = [[dict(zip(("item", "first", "end", "equal"), (str(x[0]), *x[1:]))) for x in overlaps(t.as_py(), index)] for t in b.column(at)]
                hits = pa.array([(old.as_py() or []) + n for old, n in zip(b.column(b.num_columns - 1), new)], kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], hits], names=b.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark item overlaps, all columns as they came."""
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__text"))
    return find(a, benchmark, "__text").filter(F.size("__hits") == 0).select("__doc.*")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op5: every document with whether it is contaminated, by which items, and where (first:end in words)."""
    a = find(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.array_distinct(F.transform("__hits", lambda x: x["item"].cast("long"))))
    spans = F.array_join(F.transform("__hits", lambda x: F.concat_ws(":", x["item"], x["first"].cast("string"), x["end"].cast("string"))), ",")
    return a.select("doc_id", (F.size("__hits") > 0).alias("contaminated"), items.alias("item_ids"), spans.alias("spans"))
