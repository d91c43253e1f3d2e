"""Mixing sources to target weights.

1. Targets: sources share a number of tokens by weight; a target stops at ``epochs`` times its source's
   size and what is over is shared again by weight among the others, until none is above.
2. Packing: the tokens of a source, document after document, are one stream that is cut into blocks of
   ``block`` tokens (the last may be shorter). A document's place in its stream is a two-level prefix sum:
   over buckets of documents by hash, then inside each bucket, so no task ever holds a whole source.
3. Drawing: output shards of ``shard_slots`` slots each draw how many slots each source gets from a
   multinomial over what the sources have left; what a draw takes beyond a source's rest is drawn again,
   so all shards together use each source's slots exactly. The driver draws for groups of shards, at most ``DRAWN``
   counts, and the executors for the shards of each group, whatever their number.
4. Choosing: slot k of a source reads block ``perm(k)``, a keyed pseudorandom permutation of the block
   numbers (a Feistel network walked until inside the range), anew in every epoch; blocks never repeat
   within an epoch. The last slot of a source is cut so that its words come to the rounded target.
5. Joining: slots join the packed pieces of documents by (source, block).

Tokens are runs of non-space; a shard's or source's share depends only on the table and the seed.

Defined results: null and empty texts have size 0, are part of no block and are taken 0 times; repeated rows
(also of one id) are packed each, and each has its row in :func:`taken`; very long texts are read whole and take as
many blocks as they fill; a null source is a source, ordered last; the order of a stream is by
bucket, id (null first), hash of the text; an empty table gives empty results; other columns do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, partitions, text_of, words_of

WEIGHTS, SHARE, EPOCHS = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK, SHARD_SLOTS, SEED = 512, 4096, 11
#: Documents a bucket holds at about, and sources whose table is broadcast; beyond it is joined.
BUCKET_ROWS, BROADCAST_SOURCES = 5_000, 100_000
#: Counts that the driver draws, for groups of shards.
DRAWN = 1_000_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, epochs: float = EPOCHS) -> list[float]:
    """Shares of ``total`` by weight, none above ``epochs`` times its size; the excess goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes)], float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > epochs * sizes[i]] if w else []
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w if w else 0.0
            break
        for i in over:
            out[i] = epochs * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass(frozen=True)
class Source:
    """One source's part of the plan; ``slots`` slots, the last of which reads ``last`` words."""

    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last: int


def permuted(k: int, n: int, key: int) -> int:
    """Image of k under the keyed permutation of 0..n-1; the driver's twin of :func:`permuted_col`."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = k >> half, k & mask
        for r in range(4):
            a, b = b, a ^ _round(b, key + r) & mask
        k = a << half | b
        if k < n:
            return k


def _round(x: int, key: int) -> int:
    """XXH64 of two longs, as Spark's xxhash64 has it."""
    pack = lambda v: v.to_bytes(8, "little", signed=True)
    return xxhash.xxh64_intdigest(pack(key), xxhash.xxh64_intdigest(pack(x), 42))


def _key(seed: int, source: int, epoch: int) -> int:
    return (seed * 1_000_003 + source * 8_191 + epoch * 131) % 1_000_000_007


def permuted_col(df: DataFrame, k: str, n: str, key: str, out: str) -> DataFrame:
    """``df`` plus ``out``: the permutation of 0..n-1 at ``k``. All columns are longs.

    The network's domain is less than 4 n, so each step of a walk is inside with a chance over 1/4. All rows
    walk up to 16 steps; the hundredth that is still outside then goes on, up to 512 more.
    """
    bits = F.length(F.bin(F.greatest(F.col(n) - 1, F.lit(1))))
    width = F.pow(F.lit(2.0), F.greatest(F.lit(1), F.floor((bits + 1) / 2))).cast("long")

    def step(x: Column) -> Column:
        w = F.col("__w")
        low = F.pmod(x, w)
        halves = F.struct(((x - low) / w).cast("long").alias("a"), low.alias("b"))
        mixed = lambda s, r: F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(F.pmod(F.xxhash64(s["b"], F.col(key) + r), w)).alias("b"))
        x = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), halves, mixed, lambda s: s["a"] * w + s["b"])
        return F.transform(F.array(x), lambda v: F.struct(v.alias("x"), (v < F.col(n)).alias("done")))[0]

    def walk(start: Column, steps: int) -> Column:
        first = F.struct(start.alias("x"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda acc, _: F.when(acc["done"], acc).otherwise(step(acc["x"])))

    df = df.withColumn("__w", width).withColumn("__16", walk(F.col(k), 16))
    rest = walk(F.col("__16.x"), 512)
    return df.withColumn(out, F.when(F.col("__16.done"), F.col("__16.x")).otherwise(rest["x"])).drop("__w", "__16")


def plan(measured: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, block: int = BLOCK, seed: int = SEED) -> list[Source]:
    """The sources by code point, null last, with targets and slots. ``measured``: source and size.

    Targets depend on one another, so the driver holds one small row a source.
    """
    rows = measured.groupBy("source").agg(F.sum("size").alias("size")).collect()
    # UTF-8 order is code point order
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["size"]) for r in rows]
    out = []
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), epochs)
    for i, (r, size, target) in enumerate(zip(rows, sizes, wanted)):
        n, goal = -(-size // block), min(round(target), int(epochs * size))
        whole, rest = divmod(goal, size) if size else (0, 0)
        slots, last = whole * n, block
        if rest:
            # where in the partial epoch the short block stands
            short = size - (n - 1) * block
            at = _inverse(n, _key(seed, i, whole))
            if rest <= at * block:
                used = -(-rest // block)
                last = rest - (used - 1) * block
            elif rest <= at * block + short:
                used, last = at + 1, rest - at * block
            else:
                used = -(-(rest + block - short) // block)
                last = rest + block - short - (used - 1) * block
            slots += used
        out.append(Source(i, r["source"], size, target, n, slots, last))
    return out


def _inverse(n: int, key: int) -> int:
    """The k that the permutation sends to n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    k = n - 1
    while True:
        a, b = k >> half, k & mask
        for r in reversed(range(4)):
            a, b = b ^ _round(a, key + r) & mask, a
        k = a << half | b
        if k < n:
            return k


def _multinomials(left: np.ndarray, sizes: list[int], rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Counts of each source for shards of the given sizes, drawn one after the other from what is left."""
    left = left.copy()
    for size in sizes:
        counts = np.zeros(len(left), np.int64)
        while (open_ := min(size, int(left.sum())) - int(counts.sum())) > 0:
            rest = left - counts
            counts = np.minimum(counts + rng.multinomial(open_, rest / rest.sum()), left)
        left -= counts
        yield counts


def draw_groups(sources: list[Source], shard_slots: int = SHARD_SLOTS, seed: int = SEED, drawn: int = DRAWN) -> list[tuple[int, list[int], list[int]]]:
    """(first shard, first slots of the sources, slots of the sources) of groups of whole shards, the last of which may be shorter."""
    slots = np.array([s.slots for s in sources], np.int64)
    total = int(slots.sum())
    shards = -(-total // shard_slots)
    each = max(1, -(-shards * len(sources) // drawn))  # shards of a group
    sizes = [min(each * shard_slots, total - i * shard_slots) for i in range(0, shards, each)]
    done, out = np.zeros(len(sources), np.int64), []
    for i, counts in enumerate(_multinomials(slots, sizes, np.random.Generator(np.random.PCG64([seed, 0])))):
        out.append((i * each, done.tolist(), counts.tolist()))
        done += counts
    return out


def draw_shards(shard: int, first: list[int], slots: list[int], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Iterator[tuple[int, int, int, int, int]]:
    """(shard, source, first slot of the source, slots, first position in the shard): multinomial counts per shard of one group."""
    done, left = np.array(first, np.int64), np.array(slots, np.int64)
    total = int(left.sum())
    sizes = [min(shard_slots, total - at) for at in range(0, total, shard_slots)]
    for k, counts in enumerate(_multinomials(left, sizes, np.random.Generator(np.random.PCG64([seed, 1, shard])))):
        at = 0
        for i in np.flatnonzero(counts):
            yield shard + k, int(i), int(done[i]), int(counts[i]), at
            at += int(counts[i])
        done += counts


def measure(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, source, size, and the hash that orders texts of equal ids; the text where asked for."""
    cols = [F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), F.xxhash64(text_of("text")).alias("hash")]
    return docs.select(*cols, *[F.col("text")] * with_text)


def place(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """``rows`` plus ``start``: the first word's place in the source's stream. ``measured`` has all rows without texts."""
    n = partitions(rows.sparkSession)
    buckets = max(n, -(-measured.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(buckets)).cast("int").alias("bucket")
    whole = measured.select("source", bucket, "size").groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    # a source has at most as many rows here as there are buckets
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # what stands before a bucket goes into it as the first row of its source, so rows move once and nothing is joined
    heads = whole.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("size"), F.lit(True).alias("head"))
    all_ = rows.select("*", bucket, F.lit(False).alias("head")).unionByName(heads, allowMissingColumns=True)
    inside = Window.partitionBy("bucket", "source").orderBy(F.desc("head"), "doc_id", "hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = all_.repartition(n, "bucket").withColumn("start", F.sum("size").over(inside))
    return placed.filter(~F.col("head")).drop("bucket", "hash", "head")


def _literal_table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def with_source(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """``rows`` plus number, source_size and target of their sources."""
    about = _literal_table(rows, [(s.name, s.number, s.size, s.target) for s in sources], "name string, number long, source_size long, target double")
    about = F.broadcast(about) if len(sources) <= BROADCAST_SOURCES else about
    return rows.join(about, F.col("source").eqNullSafe(F.col("name"))).drop("name")


def pieces(placed: DataFrame, sources: list[Source], block: int = BLOCK) -> DataFrame:
    """A row for each block that a document has words in: its number, how many words and where in it (``at``), and these where there are texts.

    A document without words has one row without a block.
    """
    d = with_source(placed, sources)
    texts = "text" in placed.columns
    if texts:
        d = d.withColumn("__w", words_of(text_of("text"))).drop("text")

    def piece(b: Column) -> Column:
        lo = F.greatest(F.col("start"), b * block)
        n = F.least(F.col("start") + F.col("size"), (b + 1) * block) - lo
        words = [F.array_join(F.slice("__w", (lo - F.col("start") + 1).cast("int"), n.cast("int")), " ").alias("piece")] if texts else []
        return F.struct(b.alias("block"), (lo - b * block).alias("at"), n.alias("n"), *words)

    numbers = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    d = d.withColumn("__p", F.explode_outer(F.when(F.col("size") > 0, F.transform(numbers, piece))))
    return d.select("*", "__p.*").drop("__p", "__w")


def slots(spark_df: DataFrame, sources: list[Source], block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Every slot of the mix: shard, position, number (of the source), epoch, block, and words read (``length``)."""
    n, schema = partitions(spark_df.sparkSession), "shard long, number long, first long, n long, position long"
    groups = _literal_table(spark_df, draw_groups(sources, shard_slots, seed), "shard long, first array<long>, slots array<long>").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in zip(*(c.to_pylist() for c in b.columns)):
                shards = draw_shards(*group, shard_slots, seed)
                while rows := list(islice(shards, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["shard", "number", "first", "n", "position"])

    drawn = groups.mapInArrow(run, schema).repartition(n, "shard", "number")
    keys = [(s.number, s.blocks, s.slots, s.last, s.size) for s in sources]
    about = _literal_table(spark_df, keys, "number long, blocks long, slots long, last long, size long")
    about = F.broadcast(about) if len(sources) <= BROADCAST_SOURCES else about
    s = drawn.join(about, "number").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    slot = F.col("first") + F.col("i")
    s = s.withColumns({"slot": slot, "epoch": F.floor(slot / F.col("blocks"))}).withColumn("k", F.col("slot") - F.col("epoch") * F.col("blocks"))
    key = F.pmod(F.lit(seed).cast("long") * 1_000_003 + F.col("number") * 8_191 + F.col("epoch") * 131, F.lit(1_000_000_007))
    s = permuted_col(s.withColumn("key", key), "k", "blocks", "key", "block")
    full = F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block)
    length = F.when(F.col("slot") == F.col("slots") - 1, F.least(full, F.col("last"))).otherwise(full)
    return s.select("shard", (F.col("position") + F.col("i")).alias("position"), "number", "epoch", "block", length.alias("length"))


def taken(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words of every row that the mix reads."""
    measured = cut(measure(docs))
    sources = plan(measured, block=block, seed=seed, **options)
    # a block is read at most once an epoch
    uses = slots(docs, sources, block, shard_slots, seed).select(F.col("number").alias("__n"), F.col("block").alias("__b"), "length")
    # rows without words are in no block; repeated rows with words differ by their starts
    p = pieces(place(measured.filter("size > 0"), measured), sources, block).join(uses, (F.col("number") == F.col("__n")) & (F.col("block") == F.col("__b")), "left")
    read = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("length", F.lit(0)) - F.col("at")))
    keys = ["doc_id", "source", "size", "source_size", "target"]
    full = p.groupBy("start", *keys).agg(F.sum(read).cast("long").alias("taken")).drop("start")
    return full.union(with_source(measured.filter("size = 0"), sources).select(*keys, F.lit(0).cast("long").alias("taken")))


def blocks(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, **options) -> DataFrame:
    """The mix: shard, position, source, epoch, block, n_words, doc_ids (in the block's order) and text of every slot."""
    measured = cut(measure(docs))
    sources = plan(measured, block=block, seed=seed, **options)
    p = pieces(place(measure(docs, with_text=True), measured), sources, block).filter("size > 0")
    one = F.struct("at", "doc_id", "piece")
    packed = p.groupBy("number", "block").agg(F.first("source").alias("source"), F.sort_array(F.collect_list(one)).alias("__p"))  # at most ``block`` pieces
    s = slots(docs, sources, block, shard_slots, seed).join(packed, ["number", "block"])
    whole = F.array_join(F.transform("__p", lambda x: x["piece"]), " ")
    first = F.array_join(F.slice(F.split(whole, " "), 1, F.col("length").cast("int")), " ")
    n = F.aggregate("__p", F.lit(0).cast("long"), lambda a, x: a + F.size(F.split(x["piece"], " ")))
    ids = F.transform(F.filter("__p", lambda x: x["at"] < F.col("length")), lambda x: x["doc_id"])
    return s.select("shard", "position", "source", "epoch", "block", F.col("length").alias("n_words"), ids.alias("doc_ids"), F.when(F.col("length") < n, first).otherwise(whole).alias("text"))


def query(docs: DataFrame) -> DataFrame:
    """op1: what the mix takes of every document."""
    return taken(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source")
