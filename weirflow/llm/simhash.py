"""SimHash near-duplicates: tiled exact comparison of fingerprints.

1. Fingerprint of each text: shingles of words, XXH64 with seed 42, majority of bits.
2. Copies fold first: only distinct fingerprints are compared, each with its smallest document id.
3. Two fingerprints within ``radius`` bits agree wholly on at least two of ``radius + 2`` bit blocks, so
   those that share two blocks meet under one key and no link is lost. A key with more than ``TILE`` fingerprints has
   them ordered by population count and cut into tiles there, from a histogram; two tiles make one unit of work, and a
   fingerprint goes only to units with tiles that hold population counts within ``radius`` of its own, so that pairs of
   tiles beyond it are skipped before anything moves. Units are spread over all tasks.
4. A unit sorts its fingerprints by population count and compares blocks of ``BLOCK`` with exclusive-or
   and bit counts, skipping pairs of blocks whose population counts differ beyond the radius. It gives a
   forest that spans its links (at most one row a fingerprint), not the links themselves.
5. Components of the forest by alternating large-star and small-star steps on DataFrames; every step is
   cut through the shared checkpoint folder.

``EXACT`` links at 2 bits of 3-word shingles. ``NEAR`` is for removing near copies: texts link where the Jaccard
similarity of their sets of 5-word shingles, counted exactly, is 0.8 or more. Steps 1 to 5 propose: fingerprints of the
sets of ``pair``-word shingles within ``radius`` bits make groups. No radius that blocks of bits can search
finds all such pairs, so for the rest least hashes (minhash) propose what fingerprints leave apart: ``bands`` keys of
``rows`` least hashes each, of which a pair at 0.8 shares none with a chance of 1e-9, and less above. The texts of a
group are then compared in tiles as above, every pair that is not yet connected by its whole sets; only
confirmed links make components.

Defined results: null and empty texts have fingerprint 0 and link like any other; repeated rows and ties
fall into one component; component_id is null only where all ids of a component are;
an empty table gives an empty result; other columns are carried by :func:`keep_one` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, freed, partitions, text_of

SEED = 42
TILE, BLOCK = 4096, 512
#: Rows up to which the table of keys with more than a tile is broadcast.
HOT_ROWS = 200_000


@dataclass(frozen=True)
class Linking:
    """Shingle length, bits within which fingerprints link, and bits within which both fingerprints together do (None: one is made)."""

    shingle: int
    radius: int
    both: int | None = None


@dataclass(frozen=True)
class Similar:
    """Shingle length, least similarity as a fraction, and what proposes pairs: ``bands`` keys of ``rows`` least hashes, after
    fingerprints of ``pair``-word shingles within ``radius`` bits."""

    shingle: int = 5
    share: tuple[int, int] = (4, 5)
    rows: int = 7
    bands: int = 88
    pair: int = 2
    radius: int = 6


EXACT, NEAR = Linking(3, 2), Similar()
#: Texts, and words of texts, of one tile of an exact comparison.
TEXT_TILE, WORD_TILE = 2048, 1_000_000


def fingerprint(text: str | None, shingle: int = EXACT.shingle) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    return int(_majority(_shingle_hashes(text, shingle)))


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is lowered and only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1)


def _majority(h: np.ndarray) -> np.uint64:
    if not len(h):
        return np.uint64(0)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def _remixed(h: np.ndarray) -> np.ndarray:
    """Hashes as good as independent of ``h``, one to one."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), how: Linking = EXACT) -> DataFrame:
    """The ``keep`` columns, ``fp`` and ``fp2``: fingerprints as signed longs, the second 0 where one is made."""
    kept = docs.select(*keep, F.col(f"`{text}`").alias("__text"))
    schema = kept.drop("__text").withColumns({c: F.lit(0).cast("long") for c in ("fp", "fp2")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.zeros((2, b.num_rows), np.uint64)
            for i, t in enumerate(b.column(b.num_columns - 1)):
                h = _shingle_hashes(t.as_py(), how.shingle)
                fps[0, i] = _majority(h)
                if how.both is not None:
                    fps[1, i] = _majority(_remixed(h))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x.view(np.int64)) for x in fps)], names=schema.names)

    return kept.mapInArrow(run, schema)


def _node(grams: np.ndarray) -> int:
    """Identifier of a set of shingles, as a signed long."""
    return int(np.array([xxhash.xxh3_64_intdigest(grams.tobytes())], np.uint64).view(np.int64)[0])


def _bands(grams: np.ndarray, how: Similar) -> np.ndarray:
    """The keys of a set of shingles: one for each band, none for the empty set."""
    if not len(grams):
        return np.empty(0, np.int64)
    n = how.rows * how.bands
    odd = _remixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(n, ~np.uint64(0))
    for at in range(0, len(grams), 1024):  # bounded memory for very long texts
        np.minimum(least, (odd[:, None] * grams[None, at : at + 1024]).min(axis=1), out=least)
    least = least.reshape(how.bands, how.rows)
    key = np.arange(how.bands, dtype=np.uint64)
    for r in range(how.rows):
        key = _remixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
    return key.view(np.int64)


def _similar_forest(sets: list[np.ndarray], side: np.ndarray, how: Similar) -> tuple[np.ndarray, np.ndarray]:
    """(position, root's position) of a forest spanning the pairs of one unit that are similar enough; ``side`` as in :func:`_forest`."""
    num, den = how.share
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    parts = np.split(token, np.cumsum([len(x) for x in sets])[:-1])
    parts = [parts[k][count[parts[k]] > 1] for k in order]  # what one text alone has is in no intersection
    flat, start = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    last = np.searchsorted(size * num, size * den, side="right")  # longer ones cannot be similar
    label, mark = np.arange(len(sets)), np.zeros(len(count), bool)
    for i in range(len(sets)):
        js = np.arange(i + 1, last[i])
        js = js[label[js] != label[i]]
        if side.any():
            js = js[side[js] != side[i]]
        if not len(js) or not len(parts[i]):
            continue
        mark[parts[i]] = True
        if len(js) * 8 < last[i] - i:
            both = np.array([np.count_nonzero(mark[parts[j]]) for j in js])
        else:
            lo = start[i + 1]
            sums = np.concatenate([[0], np.cumsum(mark[flat[lo : start[last[i]]]], dtype=np.int64)])
            both = sums[start[js + 1] - lo] - sums[start[js] - lo]
        mark[parts[i]] = False
        js = js[both * (num + den) >= num * (size[i] + size[js])]
        if len(js):
            labels = np.unique(np.append(label[js], label[i]))
            label[np.isin(label, labels)] = labels[0]
    tied = np.flatnonzero(label != np.arange(len(sets)))
    return order[tied], order[label[tied]]


def _keys(fp: Column, radius: int) -> Column:
    """One key for each two of radius + 2 bit blocks: the blocks' bits, hashed with which blocks they are."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(masks[x] | masks[y])).cast("long"))) for i, (x, y) in enumerate(combinations(range(n), 2))])


def _forest(fps: np.ndarray, more: np.ndarray, side: np.ndarray, how: Linking, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(position, root's position) of a forest spanning the links of one unit.

    ``more``: the second fingerprints. ``side``: 0 for both, or 1 and 2 for the two tiles, of which only
    links across are looked for.
    """
    pop = np.bitwise_count(fps).astype(np.int16)
    order = np.lexsort((fps, pop))
    fps, more, pop, side = fps[order], more[order], pop[order], side[order]
    label = np.arange(len(fps))
    starts = range(0, len(fps), block)
    for i in starts:
        a = fps[i : i + block]
        for j in starts:
            if j < i or pop[j] - pop[min(i + block, len(fps)) - 1] > how.radius:
                continue
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + block]) <= how.radius
            if side.any():
                near &= side[i : i + block, None] != side[None, j : j + block]
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            x, y = x[x < y], y[x < y]
            if how.both is not None and len(x):
                ok = np.bitwise_count(fps[x] ^ fps[y]).astype(int) + np.bitwise_count(more[x] ^ more[y]) <= how.both
                x, y = x[ok], y[ok]
            while len(x):  # hook larger labels onto smaller ones, then follow them to the root
                lx, ly = label[x], label[y]
                open_ = lx != ly
                if not open_.any():
                    break
                x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
                np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
    tied = np.flatnonzero(label != np.arange(len(fps)))
    return order[tied], order[label[tied]]


def _units(distinct: DataFrame, how: Linking, tile: int) -> DataFrame:
    """(node, fp, fp2, unit, side): the units of work, one for every two tiles of a key that may hold something near."""
    keyed = distinct.select("node", "fp", "fp2", F.explode(_keys(F.col("fp"), how.radius)).alias("key"))
    pop = F.bit_count("fp")
    # of all keys only those with more than a tile: at most one for each ``tile`` rows
    many = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select(F.col("key").alias("__key")))
    few = many.count() <= HOT_ROWS
    classes = keyed.join(F.broadcast(many) if few else many, F.col("key") == F.col("__key")).groupBy("__key", pop.alias("pop")).agg(F.count("*").alias("n"))  # at most 65 rows a key
    # before[p]: fingerprints of the key with fewer than p bits
    before = F.transform(F.sequence(F.lit(0), F.lit(65)), lambda p: F.aggregate(F.filter("of", lambda x: x["pop"] < p), F.lit(0).cast("long"), lambda n, x: n + x["n"]))
    hot = cut(classes.groupBy("__key").agg(F.collect_list(F.struct("pop", "n")).alias("of")).select("__key", before.alias("before")))
    met = keyed.join(F.broadcast(hot) if few else hot, F.col("key") == F.col("__key"), "left")
    own, next_ = F.get("before", pop), F.get("before", pop + 1)
    place = own + F.floor(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) * (next_ - own) / F.lit(1 << 20))
    tile_of = lambda x: F.coalesce(F.floor(x / tile), F.lit(0)).cast("int")
    # one row for each unit that the node's tile is in: with itself, and with each tile that may hold something near
    others = F.sequence(tile_of(F.get("before", F.greatest(pop - how.radius, F.lit(0)))), tile_of(F.get("before", F.least(pop + how.radius + 1, F.lit(65))) - 1))
    return met.select("node", "fp", "fp2", "key", tile_of(place).alias("me"), F.explode(others).alias("other")).select(
        "node",
        "fp",
        "fp2",
        F.xxhash64("key", F.least("me", "other"), F.greatest("me", "other")).alias("unit"),
        F.when(F.col("me") == F.col("other"), 0).when(F.col("me") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
    )


def links(distinct: DataFrame, how: Linking = EXACT, tile: int = TILE) -> DataFrame:
    """Forest rows (a, b) over the nodes of ``distinct`` (node, fp, fp2) whose components are those of all links."""
    units = _units(distinct, how, tile).repartition(partitions(distinct.sparkSession), "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(cols: list[np.ndarray], edges: list[int]) -> Iterator[pa.RecordBatch]:
            nodes, fps, more, side = cols[1], cols[2].view(np.uint64), cols[3].view(np.uint64), cols[4]
            found = []
            for s, e in zip(edges, edges[1:]):
                if e - s > 1:
                    x, y = _forest(fps[s:e], more[s:e], side[s:e], how)
                    if len(x):
                        found.append((nodes[s + x], nodes[s + y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

        rest: list[np.ndarray] = []  # the unit that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("unit", "node", "fp", "fp2", "side")]
            cols = [np.concatenate(x) for x in zip(rest, cols)] if rest else cols
            edges = [0, *(np.flatnonzero(np.diff(cols[0])) + 1)]
            yield from linked(cols, edges)
            rest = [c[edges[-1] :] for c in cols]
        if rest:
            yield from linked(rest, [0, len(rest[0])])

    return units.mapInArrow(run, "a long, b long").distinct()


def _similar_rows(rows: DataFrame, how: Similar) -> DataFrame:
    """__id, __th, fp, node (of the set of shingles), n_grams and bands of every row; equal sets have equal fingerprints."""
    schema = rows.drop("text").withColumns({"fp": F.lit(0).cast("long"), "node": F.lit(0).cast("long"), "n_grams": F.lit(0).cast("long"), "bands": F.array().cast("array<long>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes, sizes, bands = [], [], [], []
            for t in b.column(b.num_columns - 1):
                text = t.as_py()
                grams = np.unique(_shingle_hashes(text, how.shingle))
                fps.append(_majority(np.unique(_shingle_hashes(text, how.pair))))
                nodes.append(_node(grams))
                sizes.append(len(grams))
                bands.append(_bands(grams, how))
            own = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], names=schema.names)

    return rows.mapInArrow(run, schema)


def similar_links(rows: DataFrame, distinct: DataFrame, how: Similar = NEAR, tile: int = TEXT_TILE, words: int = WORD_TILE) -> DataFrame:
    """Forest rows (a, b) over nodes whose components are those of all pairs similar enough.

    ``rows``: __id, __th and text; ``distinct``: node, fp, n_grams, bands and ``least`` (a row that has the node).
    """
    spark = rows.sparkSession
    near = links(distinct.select("node", "fp", F.lit(0).cast("long").alias("fp2")), Linking(how.pair, how.radius))
    # least hashes: for what fingerprints leave apart
    keyed = distinct.select("node", F.explode("bands").alias("key"))
    met = cut(keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("__key"), "head"))
    loose = components(near.union(keyed.join(met, F.col("key") == F.col("__key")).select(F.col("node").alias("a"), F.col("head").alias("b"))))
    group = loose.select(F.col("node").alias("__of"), F.col("root").alias("group"))
    held = cut(distinct.select("node", "n_grams", "least").join(group, F.col("node") == F.col("__of")).drop("__of"))
    freed(spark)
    tiles = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n_grams") / words)).cast("int")
    t = cut(held.groupBy("group").agg(tiles.alias("t")).withColumnRenamed("group", "__group"))
    held = held.join(t, F.col("group") == F.col("__group")).select("node", "group", "t", F.col("least.id").alias("__hid"), F.col("least.th").alias("__hth"))
    texts = rows.join(held, F.col("__id").eqNullSafe(F.col("__hid")) & (F.col("__th") == F.col("__hth")))
    one = texts.groupBy("node", "group", "t").agg(F.first("text").alias("text"))  # rows may repeat both
    me = F.pmod(F.xxhash64("node", F.lit(1)), F.col("t")).cast("int").alias("me")
    units = one.select("node", "text", "group", me, F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("other")).select(
        F.xxhash64("group", F.least("me", "other"), F.greatest("me", "other")).alias("unit"),
        "node",
        F.when(F.col("me") == F.col("other"), 0).when(F.col("me") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
        "text",
    )
    units = units.repartition(partitions(spark), "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(nodes: list[int], sides: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                x, y = _similar_forest(sets, np.array(sides), how)
                if len(x):
                    n = np.array(nodes, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(n[x]), pa.array(n[y])], names=["a", "b"])

        unit, nodes, sides, sets = None, [], [], []
        for b in batches:
            for u, n, s, text in zip(*(c.to_pylist() for c in b.columns)):
                if u != unit:
                    yield from linked(nodes, sides, sets)
                    unit, nodes, sides, sets = u, [], [], []
                nodes.append(n)
                sides.append(s)
                sets.append(np.unique(_shingle_hashes(text, how.shingle)))
        yield from linked(nodes, sides, sets)

    return units.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least of its component, in the order of longs.

    Large-star: each node ties its larger neighbours to the least of its neighbourhood; small-star: the
    node ties its smaller ones, and itself, to the least of them. Both keep components and end in stars.
    A hub's neighbours are never gathered: the least neighbour is an aggregate, joined back by node.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.filter("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = cut(small)
        # in stars, no node is both a root and a leaf, and each leaf has one root
        roots = new.select(F.col("b").alias("n")).distinct()
        if new.join(roots, new.a == roots.n, "left_semi").limit(1).count() == 0 and new.groupBy("a").count().filter("count > 1").limit(1).count() == 0:
            break
        e = new
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _by_text(docs: DataFrame, id_col: str, text: str, how: Linking | Similar) -> tuple[DataFrame, DataFrame]:
    """(__id, __th, fp, node) of every row, and (__node, least) of every distinct fingerprint or set of shingles.

    ``least`` is the component's least (id is null, id, hash of the text).
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("__th"), F.col(f"`{text}`").alias("text"))
    own = F.struct(F.isnull("__id").alias("none"), F.col("__id").alias("id"), F.col("__th").alias("th"))
    if isinstance(how, Similar):
        fps = cut(_similar_rows(rows, how))
        distinct = cut(fps.groupBy("node").agg(F.min(own).alias("least"), *[F.first(c).alias(c) for c in ("fp", "n_grams", "bands")]))
        found = cut(similar_links(rows, distinct, how))
        freed(docs.sparkSession)
    else:
        node = F.col("fp") if how.both is None else F.xxhash64("fp", "fp2")
        fps = cut(fingerprints(rows, keep=("__id", "__th"), how=how).withColumn("node", node))
        distinct = cut(fps.groupBy("node", "fp", "fp2").agg(F.min(own).alias("least")))
        found = links(distinct, how)
    linked = components(found).withColumnRenamed("node", "__of")
    of = distinct.join(linked, distinct.node == F.col("__of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = cut(of.groupBy("root").agg(F.min("least").alias("least")))  # apart from the join, whose skew can then be split
    return fps, cut(of.select("node", "root").join(least, "root").select(F.col("node").alias("__node"), "least"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Linking | Similar = EXACT) -> DataFrame:
    """(id, fp, component_id): component_id is the least id of the documents reachable over links."""
    fps, by_node = _by_text(docs, id_col, text, how)
    return fps.join(by_node, F.col("node") == F.col("__node")).select(F.col("__id").alias(id_col), "fp", F.col("least.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Linking | Similar = NEAR) -> DataFrame:
    """The rows of ``docs`` with one of each component left, all columns as they came.

    That is the row with the least id (null last), then the least hash of the text. Of rows that repeat both,
    the first by all other columns stays.
    """
    fps, by_node = _by_text(docs, id_col, text, how)
    first = F.col("__id").eqNullSafe(F.col("least.id")) & (F.col("__th") == F.col("least.th"))
    heads = fps.join(by_node, F.col("node") == F.col("__node")).filter(first).groupBy(F.col("__id").alias("__hid"), F.col("__th").alias("__hth")).agg(F.count("*").alias("__n"))
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("__th"))
    kept = a.join(heads, F.col("__id").eqNullSafe(F.col("__hid")) & (F.col("__th") == F.col("__hth")))
    # nearly all heads are single rows; only the rest is aggregated with its texts
    one = kept.filter("__n > 1").groupBy("__id", "__th").agg(F.min_by("__doc", F.to_json("__doc")).alias("__doc"))
    return kept.filter("__n = 1").select("__doc").union(one.select("__doc")).select("__doc.*")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def query(docs: DataFrame) -> DataFrame:
    """op6: fingerprint and component of every document."""
    return classes(docs).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
