"""Replay buffers on streams: every row is written to a buffer of bounded size, and rows are read from it.

What is written where, and what is read, follows from a row's index and keyed draws (as in
:class:`~weirflow.operators.sampling.FifoBuffer`), so it is computed before any state is touched. What needs state is the content of the
slots alone, and of that only what crosses tasks. A task of the stream's own partitions takes its rows by blocks and finds runs of a group's
rows without a gap: a read whose slot was written earlier in its run is done there, on as many cores as the stream has partitions. What is left, the
reads before a slot's first write in a run and the last write of each slot, goes to the key (group, slot modulo ``splits``), where it is done
in the order of the index. A hot group, or a stream without groups, is so dealt over ``splits`` keys, and a key's state is at most
capacity / splits rows, read and written once a micro-batch. Rows that come dealt anyhow make short runs: then all goes to the keys, which is slower, and the same
result. A task holds what is left of a micro-batch for a key as numbers, and the values of its writes: the memory follows the size
of micro-batches, which the stream should bound (``ahead`` of record streams).

Rows of a group must arrive in the order of their index (0, 1, 2 ... in each group), in micro-batches cut anywhere; a row that comes late,
or again, is an error rather than another result. First and last row of each run go to a key of the group's own, where this is seen. The state store must be one that holds column families (RocksDB): :func:`replayed` sets it for
queries started after it.

``write`` "fifo": a ring of the last ``capacity`` rows; "reservoir": a uniform sample of all rows so far. ``read`` "in_turn" or
"at_random". Until ``prefill`` rows have been written, a row passes through as its own only read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from weirflow.functions import keyed
from weirflow.operators.base import IDX
from weirflow.operators.sampling import reservoir_slot

#: Rows of a frame that leaves a task, and of a block whose runs are looked at, which ends at so many bytes too.
ROWS, BYTES = 1 << 16, 1 << 26
#: Reads of a row that are written out one by one, where Spark compiles them.
UNROLLED = 16
#: ``k`` of a write, and of a run's first row (then ``slot`` is its last).
WRITE, RUN = -1, -2
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Replay:
    capacity: int
    prefill: int = 1
    size: int = 1
    write: str = "fifo"
    read: str = "in_turn"
    seed: int = 0

    def __post_init__(self) -> None:
        if not (self.capacity >= self.prefill >= 1 and self.capacity >= self.size >= 1):
            raise ValueError("prefill and size lie between 1 and the capacity")
        if self.prefill < self.size:
            raise ValueError("prefill must be at least size")
        if self.write not in ("fifo", "reservoir") or self.read not in ("in_turn", "at_random"):
            raise ValueError(f"unknown mode: {self.write}, {self.read}")

    def written(self, t: Column) -> Column:
        """The slot that row t is written to, null for none."""
        return F.pmod(t, F.lit(self.capacity)) if self.write == "fifo" else reservoir_slot(t, self.capacity, self.seed)

    def read_at(self, t: Column, k: Column) -> Column:
        """The slot of the k-th read after write t."""
        held = F.least(t + 1, F.lit(self.capacity))
        if self.read == "in_turn":
            return F.pmod((t - self.prefill) * self.size + k, held)
        return keyed.integer(keyed.uniform(t, F.concat(F.lit("buffer/read/"), k.cast("string")), self.seed), held)


def _codes(columns: list[pa.ChunkedArray], n: int) -> np.ndarray:
    """A number for each row; rows of different groups have different ones."""
    codes = np.zeros(n, np.int64)
    for c in columns:
        try:
            own = c.combine_chunks().dictionary_encode("encode")
        except pa.ArrowNotImplementedError:  # nested values
            own = pa.array([repr(x) for x in c.to_pylist()], pa.string()).dictionary_encode()
        codes = np.unique(codes * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    return codes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= ROWS or size >= BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


class _Block:
    """Rows t, w (the slot written, or null), r (the slots read, or null before ``prefill``), g0 ... and v0 ...: which reads are of writes in the same run."""

    def __init__(self, table: pa.Table) -> None:
        t = table["t"].to_numpy()
        codes = _codes([table[c] for c in table.column_names if c[0] == "g"], len(t))
        order = np.lexsort((t, codes))
        self.rows, self.t = order, t[order]
        starts = np.ones(len(t), bool)
        starts[1:] = (np.diff(codes[order]) != 0) | (np.diff(self.t) != 1)
        run = np.cumsum(starts) - 1
        self.firsts, self.lasts = np.flatnonzero(starts), np.r_[np.flatnonzero(starts)[1:], len(t)] - 1
        at = np.empty(len(t), np.int64)
        at[order] = np.arange(len(t))
        # writes and reads: place in the order above, slot, and for reads which of their row
        wrote = table["w"].is_valid().to_numpy()
        slot = pc.fill_null(table["w"], 0).to_numpy()[order]
        writes = np.flatnonzero(wrote[order])
        ready = table["r"].is_valid().to_numpy()
        size = np.where(ready, pc.fill_null(pc.list_value_length(table["r"]), 0).to_numpy(), 0)
        self.read_slot = pc.list_flatten(table["r"]).to_numpy()
        self.read_at = np.repeat(at, size)
        self.k = np.arange(len(self.read_at)) - np.repeat(np.cumsum(size) - size, size)
        self.unready = at[~ready]
        # the newest write of the slot in the run, as a number: (run, slot, place)
        slots, rank = np.unique(slot[writes], return_inverse=True)
        n, m = max(1, len(t)), max(1, len(slots))
        wrote_at = np.sort((run[writes] * m + rank) * n + writes)
        read_rank = np.minimum(np.searchsorted(slots, self.read_slot), m - 1)
        known = slots[read_rank] == self.read_slot if len(slots) else np.zeros(len(self.read_slot), bool)
        sought = (run[self.read_at] * m + read_rank) * n + self.read_at
        newest = np.searchsorted(wrote_at, sought, "right") - 1
        got = wrote_at[np.maximum(newest, 0)] if len(wrote_at) else np.zeros(len(sought), np.int64)
        self.found = known & (newest >= 0) & (got // n == sought // n)
        self.source = got % n
        ends = np.r_[np.diff(wrote_at // n) != 0, True] if len(wrote_at) else np.zeros(0, bool)
        self.finals = wrote_at[ends] % n
        self.final_slots = slot[self.finals]


def _done(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Reads of writes in the same run, and rows that pass through."""
    for table in _blocks(batches):
        b = _Block(table)
        to = np.r_[b.read_at[b.found], b.unready]
        source = np.r_[b.source[b.found], b.unready]
        k = np.r_[b.k[b.found], np.zeros(len(b.unready), np.int64)]
        values = table.select([f"v{i}" for i in range(len(names))])
        for a in range(0, len(to), table.num_rows):
            to_a, source_a, k_a = (x[a : a + table.num_rows] for x in (to, source, k))
            got = values.take(pa.array(b.rows[source_a])) if names else values
            columns = [pa.array(b.t[to_a]), pa.array(k_a), pa.array(b.t[source_a]), *got.columns]
            yield from pa.table(columns, names=["__t", "__k", IDX, *names]).combine_chunks().to_batches()


def _left(batches: Iterator[pa.RecordBatch], splits: int) -> Iterator[pa.RecordBatch]:
    """All other reads, the last write of each slot in each run, and the runs."""
    for table in _blocks(batches):
        b = _Block(table)
        read = ~b.found
        at = np.r_[b.read_at[read], b.finals, b.firsts]
        k = np.r_[b.k[read], np.full(len(b.finals), WRITE), np.full(len(b.firsts), RUN)]
        slot = np.r_[b.read_slot[read], b.final_slots, b.t[b.lasts]]
        split = np.where(k == RUN, splits, slot % splits)
        others = table.drop_columns(["t", "w", "r"])
        for a in range(0, len(at), table.num_rows):
            at_a, k_a, slot_a, split_a = (x[a : a + table.num_rows] for x in (at, k, slot, split))
            columns = [pa.array(b.t[at_a]), pa.array(k_a), pa.array(slot_a), pa.array(split_a), *(others.take(pa.array(b.rows[at_a])).columns if others.num_columns else [])]
            yield from pa.table(columns, names=["t", "k", "slot", "split", *others.column_names]).combine_chunks().to_batches()


class _Slots(StatefulProcessor):
    """Content of the slots of one key. Rows: t, k (-1: a write), slot and the columns v0, v1 ... that a write leaves there.

    The key of a group's runs (k -2: the first row, and the last as slot) has no slots.
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "ring binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, slots = pickle.loads(self.ring.get()[0]) if self.ring.exists() else (-1, {})
        own = [f"v{i}" for i in range(len(self.names))]
        # numbers of all rows, values of writes alone: what the slots held comes first, as writes of long ago
        held = pd.DataFrame({v: [slots[s][1][i] for s in slots] for i, v in enumerate(own)}, index=range(len(slots)))
        numbers, values = [np.array([(slots[s][0], -1, s) for s in slots], np.int64).reshape(-1, 3)], [held] if slots else []
        for chunk in rows:
            numbers.append(chunk[["t", "k", "slot"]].to_numpy(np.int64))
            values.append(chunk.loc[chunk["k"] < 0, own])
        t, k, slot = np.concatenate(numbers).T
        del numbers
        if (k == RUN).any():
            by_start = np.argsort(t, kind="stable")
            before = np.maximum.accumulate(np.r_[last, slot[by_start]])
            if (late := np.flatnonzero(t[by_start] <= before[:-1])).size:
                raise ValueError(f"row {t[by_start][late[0]]} of {key} comes after row {before[late[0]]}")
            self.ring.update((pickle.dumps((int(before[-1]), {})),))
            return
        values = pd.concat(values, ignore_index=True)
        if len(t) > len(slots) and (first := t[len(slots) :].min()) <= last:
            raise ValueError(f"row {first} of {key} comes after row {last}")
        number = np.where(k < 0, np.cumsum(k < 0) - 1, -1)
        # in each slot in order of time: the write before every read is the newest so far, unless that is another slot's
        order = np.lexsort((k, t, slot))
        starts = np.r_[True, np.diff(slot[order]) != 0]
        at = np.arange(len(order))
        newest = np.maximum.accumulate(np.where(k[order] < 0, at, -1))
        found = newest >= np.maximum.accumulate(np.where(starts, at, 0))
        ends = np.flatnonzero(np.r_[starts[1:], True])
        finals = order[newest[ends[found[ends]]]]
        kept = zip(*(values[v].iloc[number[finals]] for v in own)) if own else [()] * len(finals)
        slots = {int(s): (int(n), tuple(v)) for s, n, v in zip(slot[finals], t[finals], kept)}
        self.ring.update((pickle.dumps((max(last, int(t.max())), slots)),))
        reads = found & (k[order] >= 0)
        to, source = order[reads], order[newest[reads]]
        turn = np.lexsort((k[to], t[to]))
        for a in range(0, len(turn), ROWS):
            to_a, source_a = to[turn[a : a + ROWS]], source[turn[a : a + ROWS]]
            got = values.iloc[number[source_a]].set_axis(self.names, axis=1).reset_index(drop=True)
            yield got.assign(__t=t[to_a], __k=k[to_a], **{IDX: t[source_a]})[["__t", "__k", IDX, *self.names]]

    def close(self) -> None:
        pass


def replayed(stream: DataFrame, buffer: Replay, index: str = IDX, by: list[str] | None = None, splits: int = 16) -> DataFrame:
    """``__t`` (the row just written), ``__k`` (which read after it), ``__idx`` and the columns of the row that is read."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    by = by or []
    t = F.col(index).cast("long")
    names = [c for c in stream.columns if c != index]
    ready = F.col("t") >= buffer.prefill
    at = lambda k: buffer.read_at(F.col("t"), k).cast("long")
    if buffer.size <= UNROLLED:
        reads = F.array(*[at(F.lit(k).cast("long")) for k in range(buffer.size)])
    else:
        reads = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(buffer.size - 1).cast("long")), at)
    # names that hold in a frame of the processor, whatever the stream's are
    keys = {f"g{i}": F.col(f"`{c}`") for i, c in enumerate(by)}
    values = {f"v{i}": F.col(f"`{c}`") for i, c in enumerate(names)}
    base = stream.select(t.alias("t"), *[c.alias(k) for k, c in (keys | values).items()]).where("t IS NOT NULL")
    base = base.select("t", buffer.written(F.col("t")).cast("long").alias("w"), F.when(ready, reads).alias("r"), *keys, *values)
    schema = StructType().add("__t", "long").add("__k", "long").add(IDX, "long")
    for f in stream.select(*names).schema:
        schema = schema.add(f)
    rest = StructType().add("t", "long").add("k", "long").add("slot", "long").add("split", "long")
    for f in base.select(*keys, *values).schema:
        rest = rest.add(f)
    done = base.mapInArrow(lambda batches: _done(batches, names), schema)
    left = base.mapInArrow(lambda batches: _left(batches, splits), rest)
    got = left.groupBy(*keys, "split").transformWithStateInPandas(_Slots(names), schema, "append", "none")
    return got.unionByName(done)


@contextmanager
def state_partitions(spark: SparkSession, most: int) -> Iterator[None]:
    """Queries started inside deal their keys over ``most`` partitions at most.

    Every partition's state is loaded and committed in every micro-batch, with rows or without, so there should be no more of them than keys.
    A query's number is fixed when it is first started.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)
