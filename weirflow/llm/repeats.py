"""Removal of long repeated byte strings by bucket-pointer refinement.

A byte goes where a string of ``length`` bytes that covers it also starts elsewhere, in another text or in
the same one. Suffixes are put into buckets by their first bytes; a bucket is then refined by the bucket
identifiers of its suffixes at later offsets, a refined bucket is what the next round refines, and what is alone in
its bucket goes out. Identifiers of h bytes give those of 2 h bytes the same way, as pairs (bucket, bucket at
offset + h), from q-grams of 8 bytes up (:class:`Pointers`).

1. Copies of whole texts fold (each such text of at least ``length`` bytes is covered wholly); only distinct
   texts go on.
2. Initial buckets, of q = 128 bytes: of every window of ``length`` bytes the suffix whose bucket identifier is least is
   its anchor, so equal windows have equal anchors at equal offsets, and a text has one anchor for about each
   (length - q) / 2 bytes. Stretches of a short period, where every place would be an anchor, are settled inside their text: their
   windows repeat there, and the first of equal ones stands for all. Anchors alone in their buckets are done.
3. First refinement, to 2 q bytes: by the bucket at offset + q for windows that reach so far behind the anchor,
   else by that at offset - q.
4. Second refinement, to nearly ``length`` bytes: an anchor's windows are cut into runs of ``RUN`` offsets; a run's
   bucket is that of the first refinement, refined by the buckets of 256 bytes at the start and the end of what all
   windows of the run share (``core``). Where no other run has it, no window of the run has a partner. Runs that agree on
   all bytes of all their windows (``whole``) are repeats at once, and one of each such class goes on for the others.
5. Third refinement, to ``length`` bytes: in buckets that hold runs not equal as a whole, each window is refined by the
   buckets of 256 bytes at its start and its end.

Every refinement is a count over (bucket, bucket at the later offset) that combines before it shuffles; no bucket is
ever gathered, and no text but one's own is compared with. Texts move once: made distinct, they are written to a table
in buckets of their key, and what is joined to them later goes to where they are. A text is read in parts of ``PART``
windows, so that memory has a bound whatever its length.

Defined results: null is empty; texts shorter than ``length`` bytes lose nothing; repeated rows (also of one
id) are copies of each other; overlaps within a text count; an empty table gives an empty result; very long texts are
read whole, in parts; other columns do not enter. Nothing is skipped for being frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, cut, text_of

LENGTH, RUN = 400, 32
#: Window starts of a text that are worked on at once.
PART = 1 << 20


def q_of(length: int) -> int:
    """Bytes of the initial buckets, the largest power of two that goes three times into ``length``: 128 for 400."""
    if length < 5 * RUN:
        raise ValueError(f"a length of {5 * RUN} bytes or more is asked for")
    return 1 << (length // 3).bit_length() - 1


def wide_of(length: int) -> int:
    """Bytes of the buckets that name nearly whole windows: 256 for 400."""
    return 1 << (length - RUN + 1).bit_length() - 1



_U = np.uint64
#: Odd numbers of the two families of identifiers: for the first and the second half of a pair.
_PAIR = ((_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)))


def _pair(first: np.ndarray, later: np.ndarray, k: int = 0) -> np.ndarray:
    """Identifier of the bucket of a bucket and the one at a later offset."""
    x = first * _PAIR[k][0] + later * _PAIR[k][1]
    x ^= x >> _U(32)
    x *= _U(0x7FB5D329728EA185)
    return x ^ x >> _U(29)


class Pointers:
    """Bucket identifiers of a text's suffixes by their first 8, 16, 32 ... bytes, each level made from the one before."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self._levels: dict[tuple[int, int], np.ndarray] = {}

    def of(self, h: int, k: int = 0) -> np.ndarray:
        """Identifiers by ``h`` bytes (8 times a power of two) of all suffixes that have so many."""
        if (h, k) not in self._levels:
            if h == 8:
                n = max(len(self.data) - 7, 0)
                grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, 8)).view("<u8").ravel() if n else np.empty(0, np.uint64)
                self._levels[h, k] = _pair(grams, grams >> _U(32), k)
            else:
                b = self.of(h // 2, k)
                self._levels[h, k] = _pair(b[: max(len(b) - h // 2, 0)], b[h // 2 :], k)
                if h > 16:
                    del self._levels[h // 2, k]
        return self._levels[h, k]

    def spanned(self, start: np.ndarray, end: np.ndarray, h: int, k: int = 0) -> np.ndarray:
        """Identifiers of [start, end), of h to 3 h bytes: the buckets of h bytes at either end, and of what is between."""
        b = self.of(h, k)
        ends = _pair(b[start], b[end - h], k)
        between = np.minimum(start + h, end - h)
        return ends if (end - start <= 2 * h).all() else np.where(end - start <= 2 * h, ends, _pair(ends, b[between], k))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(31)) * _U(0x7FB5D329728EA185)
    x = (x ^ x >> _U(27)) * _U(0x81DADEF4BC2DD44D)
    return x ^ x >> _U(33)


#: Bits of a position where hash and position fit one number.
_AT = 24


def _least(h: np.ndarray, width: int, last: bool = False) -> np.ndarray:
    """Position of the least in each window of ``width`` hashes (by their upper bits), the leftmost of equals, or the ``last``."""
    if len(h) < 1 << _AT:
        mask = _U((1 << _AT) - 1)
        at = np.arange(len(h), dtype=np.uint64)
        best = h & ~mask | (mask - at if last else at)
        have = 1
        while have < width:
            step = min(have, width - have)
            best = np.minimum(best[: len(best) - step], best[step:])
            have += step
        best = best & mask
        return (mask - best if last else best).astype(np.int64)
    # a very long text in overlapping parts
    part = (1 << _AT) - width
    return np.concatenate([_least(h[i : i + part + width - 1], width, last) + i for i in range(0, len(h) - width + 1, part)])


def _chosen(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least in each window; of equals the first or the last, whichever is farther from its end of the window.

    That depends on the window alone, and where a stretch of equals comes into a window or leaves it, the choice stays.
    """
    first, last = _least(h, width), _least(h, width, last=True)
    two = np.flatnonzero(first != last)
    if len(two):
        a, b = first[two], last[two]
        first[two] = np.where(a - two >= two + width - 1 - b, a, b)
    return first


#: A part of a text with more than one anchor for so many windows is looked through for windows that repeat in it.
DENSE = 16


def _repeated(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of a part: which occur in it more than once, and which are there for the first time."""
    at = np.arange(len(data) - length + 1)
    ids = np.rec.fromarrays([_spans(data, at, at + length, length, k) for k in (0, 1)], names="x,y")
    _, first, of, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
    fresh = np.zeros(len(at), bool)
    fresh[first] = True
    return count[of] > 1, fresh


def _stretches(mask: np.ndarray) -> np.ndarray:
    """(first, last) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2) - [0, 1]


def anchors(data: np.ndarray, length: int = LENGTH, local: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, ...]:
    """(bucket, bucket q bytes on, bucket q bytes before, place, first window, last window) of every anchor of one text.

    Windows are given by their starts. What lies outside the text has bucket 0. With ``local``, windows that repeat inside a part of
    the text that is dense with anchors (long runs of a short period) are put there, and only the first of equal ones goes on.
    """
    q, found = q_of(length), []
    for at in range(0, len(data) - length + 1, PART):
        part = data[max(at - q, 0) : at + PART + length - 1]
        skip = min(at, q)  # bytes before, for the buckets of anchors at the start of the part
        b = Pointers(part).of(q)
        own = _chosen(b[skip:], length - q + 1) + skip
        new = np.concatenate([[True], own[1:] != own[:-1]])
        if local is not None and np.count_nonzero(new) > 64 + len(own) // DENSE:
            twice, fresh = _repeated(part[skip:], length)
            local += [(int(x) + at, int(y) + at) for x, y in _stretches(twice)]
            kept = np.flatnonzero(fresh)
            own = own[kept]
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(kept) > 1)])
        else:
            kept = np.arange(len(own))
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(own) - 1]])
        place = own[first]
        later, before = place + q, place - q
        ends = [np.where((x >= 0) & (x < len(b)), b[np.clip(x, 0, len(b) - 1)], _U(0)) for x in (later, before)]
        found.append((b[place], *ends, place - skip + at, kept[first] + at, kept[last] + at))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x).view(np.int64) for x in zip(*found))


def runs(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, ...]:
    """(core, whole, first window, last window, anchor) of the runs of given anchors.

    A run holds the windows whose anchor is at offsets [i run, (i + 1) run) in them; ``anchor`` is its number.
    """
    lo, hi = (place - last) // run, (place - first) // run
    n = hi - lo + 1
    each = np.repeat(np.arange(len(place)), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[each]
    p = place[each]
    near, far = i * run, (i + 1) * run - 1
    a, b = np.maximum(first[each], p - far), np.minimum(last[each], p - near)
    # shared by every window of the run, whether or not the text has them all
    core = _spans(data, p - near, p - np.minimum(far, length - q_of(length)) + length, length, 0) ^ _mix(i.astype(np.uint64) + _U(1))
    offsets = (p - a).astype(np.uint64) << _U(20) | (p - b).astype(np.uint64)
    whole = _spans(data, a, b + length, length, 1) ^ _mix(offsets)
    return core, whole, a, b, each


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, k: int) -> np.ndarray:
    """:meth:`Pointers.spanned` of a text that is read in parts."""
    h, out = wide_of(length), np.empty(len(start), np.uint64)
    of = start // PART
    for part in np.unique(of):
        i, at = np.flatnonzero(of == part), int(part) * PART
        out[i] = Pointers(data[at : at + PART + 3 * h]).spanned(start[i] - at, end[i] - at, h, k)
    return out


def _identity(k1: int, k2: int, at: np.ndarray) -> np.ndarray:
    """One number for a place in a text."""
    key = (k1 * 0x9E3779B97F4A7C15 ^ k2) % (1 << 64)
    return _mix(at.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(key)).view(np.int64)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _each(make, names: str):
    """An Arrow function that gives rows (k1, k2, *made from the text and what is joined to it*) for each text."""
    columns = [x.split()[0] for x in names.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):  # few texts at a time, for what is made is larger
                found = []
                c = b.slice(at, 64)
                for k1, k2, *rest in zip(c.column(0).to_pylist(), c.column(1).to_pylist(), *c.columns[2:]):
                    rows = make(k1, k2, *rest)
                    if len(rows[0]):
                        found.append((np.full(len(rows[0]), k1), np.full(len(rows[0]), k2), *rows))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=columns)

    return run


def _to_anchors(length: int):
    def make(k1: int, k2: int, text: pa.Scalar) -> tuple[np.ndarray, ...]:
        local: list[tuple[int, int]] = []
        *buckets, place, first, last = anchors(_bytes(text.as_py()), length, local)
        me = _identity(k1, k2, place)
        if not local:
            return *buckets, place, first, last, me
        # what repeats inside the text: two rows of a bucket of their own, so that they count as partners
        a, b = (np.repeat(np.array(x, np.int64), 2) for x in zip(*local))
        bucket, none = _mix(_identity(k1, k2, a).view(np.uint64)).view(np.int64), np.zeros(len(a), np.int64)
        side = np.where(np.arange(len(a)) % 2, -1, -2)
        rows = ((bucket, none, none, side, a, b, bucket ^ side), (*buckets, place, first, last, me))
        return tuple(np.concatenate(x) for x in zip(*rows))

    return make


def _to_runs(length: int):
    def make(k1: int, k2: int, text: pa.Scalar, of: pa.Scalar) -> tuple[np.ndarray, ...]:
        place, first, last, bucket = (np.asarray(of.values.field(i)) for i in range(4))
        core, whole, a, b, anchor = runs(_bytes(text.as_py()), place, first, last, length)
        return bucket[anchor], core.view(np.int64), whole.view(np.int64), a, b, _identity(k1, k2, a)

    return make


def _to_windows(length: int):
    def make(k1: int, k2: int, text: pa.Scalar, of: pa.Scalar) -> tuple[np.ndarray, ...]:
        a, b, bucket = (np.asarray(of.values.field(i)) for i in range(3))
        n = b - a + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        data = _bytes(text.as_py())
        return np.repeat(bucket, n), _spans(data, at, at + length, length, 0).view(np.int64), _spans(data, at, at + length, length, 1).view(np.int64), at, _identity(k1, k2, at)

    return make


KEY = ["k1", "k2"]


def _with_text(texts: DataFrame, rows: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Texts joined with what ``rows`` have of each, gathered: at most as many as the text has bytes."""
    of = rows.groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias("of"))
    of = of.select(F.col("k1").alias("__1"), F.col("k2").alias("__2"), "of")
    return texts.join(of, (F.col("k1") == F.col("__1")) & (F.col("k2") == F.col("__2")), how).drop("__1", "__2")


def _partnered(rows: DataFrame, *by: str) -> DataFrame:
    """The rows whose values of ``by`` some other row has as well; ``me`` tells rows apart."""
    twice = rows.groupBy(*by).agg(F.min("me").alias("x"), F.max("me").alias("y")).filter("x <> y")
    twice = cut(twice.select(*[F.col(c).alias(f"__{c}") for c in by]))  # apart from the join, whose skew can then be split
    on = F.lit(True)
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return rows.join(twice, on, "left_semi")


def find(texts: DataFrame, length: int = LENGTH, write: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """k1, k2, a, b: runs [a, b] of window starts that have a partner. ``texts``: k1, k2 and text, distinct.

    ``write`` makes a frame a table that is read again.
    """
    q = q_of(length)
    names = "k1 long, k2 long, bucket long, later long, before long, place long, first long, last long, me long"
    # written, for they are counted and then joined: made twice they cost more than their reading
    found = write(texts.select(*KEY, "text").mapInArrow(_each(_to_anchors(length), names), names))
    # written: buckets by (bucket, next) would else be counted where those by bucket are, a frequent one in one task
    live = write(_partnered(found, "bucket"))
    local = live.filter("place = -1").select(*KEY, F.col("first").alias("a"), F.col("last").alias("b"))
    live = live.filter("place >= 0")
    # windows that hold the 2 q bytes from the anchor on, and those that hold the q before it; anchors with both go on twice
    half = (length - q) // 2
    o1, o2 = F.col("place") - F.col("last"), F.col("place") - F.col("first")
    behind = F.struct(F.lit(1).alias("side"), F.col("later").alias("next"), F.greatest("first", F.col("place") - half + 1).alias("first"), F.col("last").alias("last"))
    ahead = F.struct(F.lit(2).alias("side"), F.col("before").alias("next"), F.col("first").alias("first"), F.least("last", F.col("place") - half).alias("last"))
    sides = F.filter(F.array(F.when(o1 < half, behind), F.when(o2 >= half, ahead)), lambda x: x.isNotNull())
    halves = live.select(*KEY, "bucket", "place", "me", F.explode(sides).alias("s")).select(*KEY, "bucket", "place", "me", "s.*")
    halves = _partnered(halves, "bucket", "side", "next").withColumn("bucket", F.xxhash64("bucket", "side", "next"))

    names = "k1 long, k2 long, bucket long, core long, whole long, a long, b long, me long"
    cut_runs = write(_with_text(texts, halves, "place", "first", "last", "bucket").select(*KEY, "text", "of").mapInArrow(_each(_to_runs(length), names), names))
    cut_runs = cut_runs.withColumn("core", F.xxhash64("bucket", "core")).drop("bucket")
    # a bucket's runs are lone, all equal as a whole, or mixed: told from the least and largest of both numbers
    core = cut_runs.groupBy("core").agg(F.min("me").alias("x"), F.max("me").alias("y"), F.min("whole").alias("u"), F.max("whole").alias("v")).filter("x <> y")
    core = cut(core.select(F.col("core").alias("__core"), (F.col("u") != F.col("v")).alias("mixed")))
    judged = write(cut_runs.join(core, F.col("core") == F.col("__core")).select(*KEY, "core", "whole", "a", "b", "me", "mixed"))
    pure = judged.filter("not mixed").select(*KEY, "a", "b")
    # of a mixed bucket, each class of equal runs has a speaker, whose windows go on for all
    mixed = judged.filter("mixed")
    classes = mixed.groupBy("core", "whole").agg(F.min("me").alias("x"), F.max("me").alias("y"))
    classes = cut(classes.select(F.col("core").alias("__c"), F.col("whole").alias("__w"), (F.col("x") != F.col("y")).alias("repeat"), F.col("x").alias("speaker")))
    mixed = mixed.join(classes, (F.col("core") == F.col("__c")) & (F.col("whole") == F.col("__w")))
    mixed = write(mixed.select(*KEY, "core", "a", "b", "repeat", (F.col("me") == F.col("speaker")).alias("open")).filter("repeat or open"))

    names = "k1 long, k2 long, core long, w1 long, w2 long, a long, me long"
    windows = _with_text(texts, mixed.filter("open"), "a", "b", "core").select(*KEY, "text", "of").mapInArrow(_each(_to_windows(length), names), names)
    single = _partnered(windows, "core", "w1", "w2").select(*KEY, "a", F.col("a").alias("b"))
    return pure.union(mixed.filter("repeat").select(*KEY, "a", "b")).union(single).union(local)


def covered(n: int, starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte ranges [from, to) that the windows starting in the given ranges cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        end = min(b + length, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


RESULT = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long,to:long>>"


def _judge(length: int):
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k1, k2, text, copies, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                gone = [(0, len(data))] if copies > 1 else covered(len(data), [(x["a"], x["b"]) for x in of or ()], length)
                kept, at = hashlib.sha256(), 0
                for x, y in gone:
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                out.append((k1, k2, sum(y - x for x, y in gone), len(gone), kept.hexdigest(), [{"from": x, "to": y} for x, y in gone]))
            if out:
                *plain, spans = zip(*out)
                yield pa.RecordBatch.from_arrays([*map(pa.array, plain), pa.array(spans, kind)], names=[x.split()[0] for x in "k1,k2,n_removed,n_spans,kept_sha256,spans".split(",")])

    return run


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans, the removed byte ranges (from, to), of every row."""
    t = text_of(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), t.alias("text"))
    size = F.octet_length("text").cast("long")
    short = size < length
    # copies fold before the texts move; each text stands once, with the number of its rows
    distinct = rows.filter(~short).groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    shelves = [Shelf(distinct, KEY)]

    def write(df: DataFrame) -> DataFrame:
        shelves.append(Shelf(df))
        return shelves[-1].df

    try:
        repeats = find(shelves[0].df, length, write)
        judged = _with_text(shelves[0].df, repeats, "a", "b", how="left").select(*KEY, "text", "copies", "of")
        result = cut(judged.mapInArrow(_judge(length), RESULT))
    finally:
        for s in shelves:
            s.drop()
    result = result.withColumnsRenamed({"k1": "__1", "k2": "__2"})
    zero = F.lit(0).cast("long")
    return (
        rows.select("id", *KEY, size.alias("n_bytes"), F.when(short, F.sha2("text", 256)).alias("__own"))
        .join(result, (F.col("k1") == F.col("__1")) & (F.col("k2") == F.col("__2")), "left")
        .select(
            F.col("id").alias(id_col),
            "n_bytes",
            F.coalesce("n_removed", zero).alias("n_removed"),
            F.coalesce("n_spans", zero).alias("n_spans"),
            F.coalesce("kept_sha256", "__own").alias("kept_sha256"),
            F.coalesce("spans", F.array().cast("array<struct<from:long,to:long>>")).alias("spans"),
        )
    )


def query(docs: DataFrame) -> DataFrame:
    """op7: what is removed of every document."""
    return remove(docs.select("doc_id", "text")).drop("spans")
