"""Samplers as DataFrames of indices, and windows over positions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions import keyed

from .base import IDX


def sequential(spark: SparkSession, n: int, epochs: int = 1) -> DataFrame:
    """__epoch, __pos (over all epochs) and __idx: 0..n-1 in every epoch."""
    if n < 1 or epochs < 1:
        raise ValueError("n and epochs must be at least 1")
    return spark.range(n * epochs).select(F.floor(F.col("id") / n).alias("__epoch"), F.col("id").alias("__pos"), F.pmod("id", F.lit(n)).alias(IDX))


def range_length(start: int, stop: int, step: int, truncate: bool = False) -> int:
    """Length of an arithmetic progression; ``truncate`` leaves out a last item that does not fill a step."""
    if step == 0:
        raise ValueError("step must not be 0")
    n = int((stop - start) / step) if truncate else -(-(stop - start) // step)
    return max(0, n)


def arithmetic(spark: SparkSession, start: int, stop: int, step: int = 1, truncate: bool = False) -> DataFrame:
    return spark.range(range_length(start, stop, step, truncate)).select(F.col("id").alias("__pos"), (F.lit(start) + F.col("id") * step).cast("long").alias(IDX))


def shuffled(spark: SparkSession, n: int, seed: int = 0, epoch: int = 0, method: str = "feistel") -> DataFrame:
    """__pos and __idx of a seeded permutation.

    ``feistel`` computes each position from its index alone, ``feistel_exact`` by rounds that SQL engines can repeat;
    ``rank`` orders by keyed draws, which sorts.
    """
    if method.startswith("feistel"):
        return spark.range(n).select(F.col("id").alias(IDX), keyed.permuted(F.col("id"), n, seed + epoch, exact=method == "feistel_exact").alias("__pos"))
    d = spark.range(n).select(F.col("id").alias(IDX), keyed.uniform(F.col("id"), f"perm|{epoch}", seed).alias("__u"))
    return rank_by(d, ["__u", IDX], "__pos").drop("__u")


def rank_by(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """``df`` plus the 0-based rank by a total order, in two passes over range partitions."""
    from weirflow.sources.indexed import with_index

    keep = IDX in df.columns
    d = df.withColumnRenamed(IDX, "__own") if keep else df
    d = with_index(d, ["__own" if c == IDX else c for c in by]).withColumnRenamed(IDX, out)
    return d.withColumnRenamed("__own", IDX) if keep else d


def epoch_shuffled(spark: SparkSession, n: int, epochs: int, seed: int = 0, first: int = 0, exact: bool = False) -> DataFrame:
    """A new permutation in each of ``epochs`` epochs from ``first`` on; the plan is the same for any number of them."""
    epoch = F.floor(F.col("id") / n)
    d = spark.range(n * first, n * (first + epochs)).select(epoch.alias("__epoch"), F.pmod("id", F.lit(n)).alias(IDX))
    return d.withColumn("__pos", F.col("__epoch") * n + keyed.permuted(F.col(IDX), n, (F.col("__epoch") + seed), exact=exact))


@dataclass(frozen=True)
class EpochCursor:
    """An endless sampler with state: positions go on over epochs, each a permutation of its own.

    ``take`` gives the next rows and the cursor behind them; ``on_epoch`` is called with each epoch that is completed.
    """

    n: int
    seed: int | None = 0
    position: int = 0
    on_epoch: Callable[[int], None] | None = None

    def state(self) -> dict[str, int]:
        return {"n": self.n, "position": self.position, "epoch": self.position // self.n, "offset": self.position % self.n}

    def restored(self, state: dict[str, int]) -> EpochCursor:
        if state["n"] != self.n:
            raise ValueError(f"a state of {state['n']} rows for a sampler of {self.n}")
        return replace(self, position=state["position"])

    def progress(self) -> float:
        """Share of the running epoch that is behind."""
        return self.position % self.n / self.n

    def take(self, spark: SparkSession, count: int) -> tuple[DataFrame, EpochCursor]:
        """(__epoch, __pos, __idx of the next ``count`` positions, the cursor behind them)."""
        end = self.position + count
        first, last = self.position // self.n, -(-end // self.n)
        d = epoch_shuffled(spark, self.n, last - first, self.seed, first) if self.seed is not None else sequential(spark, self.n, last).filter(F.col("__epoch") >= first)
        for e in range(first, end // self.n):
            if self.on_epoch is not None:
                self.on_epoch(e)
        return d.filter((F.col("__pos") >= self.position) & (F.col("__pos") < end)), replace(self, position=end)


@dataclass(frozen=True)
class SlidingWindow:
    """Windows of ``window`` consecutive indices, ``stride`` apart; an incomplete last one is dropped or padded with the last index."""

    window: int
    stride: int = 1
    drop_incomplete: bool = True

    def __post_init__(self) -> None:
        if self.window < 1 or self.stride < 1:
            raise ValueError("window and stride must be at least 1")

    def count(self, n: int) -> int:
        if self.drop_incomplete:
            return max(0, (n - self.window) // self.stride + 1)
        return (n - 1) // self.stride + 1 if n else 0

    def indices(self, spark: SparkSession, n: int) -> DataFrame:
        """__window, __offset, __idx."""
        w = spark.range(self.count(n)).select(F.col("id").alias("__window"), F.explode(F.sequence(F.lit(0), F.lit(self.window - 1))).alias("__offset"))
        return w.withColumn(IDX, F.least(F.col("__window") * self.stride + F.col("__offset"), F.lit(n - 1)))

    def over(self, df: DataFrame, n: int) -> DataFrame:
        """Rows of ``df`` (indexed) in every window they are in: rows are copied to their windows, nothing is joined."""
        last = F.floor(F.col(IDX) / self.stride)
        first = F.greatest(F.lit(0), F.floor((F.col(IDX) - self.window) / self.stride) + 1)
        last = F.least(last, F.lit(self.count(n) - 1))
        d = df.withColumn("__window", F.explode(F.when(first <= last, F.sequence(first, last))))
        d = d.withColumn("__offset", (F.col(IDX) - F.col("__window") * self.stride).cast("int"))
        if self.drop_incomplete:
            return d
        more = F.when((F.col(IDX) == n - 1) & (F.col("__offset") < self.window - 1), F.sequence(F.col("__offset"), F.lit(self.window - 1))).otherwise(F.array("__offset"))
        return d.withColumn("__offset", F.explode(more))


@dataclass(frozen=True)
class FifoBuffer:
    """A ring of the last ``capacity`` rows; until ``prefill`` rows have been written, rows pass through."""

    capacity: int
    prefill: int = 1

    def slots(self, df: DataFrame) -> DataFrame:
        """Where each row is written, and whether the buffer was ready before that."""
        return df.withColumns({"__slot": F.pmod(F.col(IDX), F.lit(self.capacity)), "__ready": F.col(IDX) >= self.prefill})

    def contents(self, df: DataFrame, value: str) -> DataFrame:
        """``df`` plus ``__buffer``: what the ring holds after each write, oldest first.

        Rows go to blocks of positions of a few capacities, the last of each block also to the next as its halo; inside a
        block the buffer is a frame of rows. So a row moves once or twice, whatever the capacity.
        """
        size = 4 * self.capacity
        block = F.floor(F.col(IDX) / size)
        to = F.when(F.pmod(F.col(IDX), F.lit(size)) > size - self.capacity, F.array(block, block + 1)).otherwise(F.array(block))
        frame = Window.partitionBy("__block").orderBy(IDX).rowsBetween(-(self.capacity - 1), Window.currentRow)
        held = df.withColumn("__block", F.explode(to)).withColumn("__buffer", F.collect_list(value).over(frame))
        return held.filter(F.col("__block") == block).drop("__block")

    def held_at(self, t: Column, slot: Column) -> Column:
        """Index of the row that a slot holds after write t."""
        return F.when(t < self.capacity, slot).otherwise(t - F.pmod(t - slot, F.lit(self.capacity)))

    def reads(self, df: DataFrame, size: int, seed: int | None = None) -> DataFrame:
        """__t, __k, __idx: the rows read after each write, once the buffer was ready before it.

        With a seed, slots are drawn at random (keyed by write and read); else they are read in turn.
        A row written before the buffer is ready is passed through as its own only read.
        """
        t, k = F.col(IDX), F.col("__k")
        held = F.least(t + 1, F.lit(self.capacity))
        turn = F.pmod((t - self.prefill) * size + k, held)
        slot = turn if seed is None else keyed.integer(keyed.uniform(t, F.concat(F.lit("buffer/read/"), k.cast("string")), seed), held)
        ks = F.when(t >= self.prefill, F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        d = df.select(IDX, F.explode(ks).alias("__k"))
        return d.select(t.alias("__t"), "__k", F.when(t >= self.prefill, self.held_at(t, slot)).otherwise(t).alias(IDX))


def buffer_shuffled(df: DataFrame, buffer: int, seed: int = 0) -> DataFrame:
    """``df`` plus ``__pos``: rows mixed within consecutive blocks of ``buffer`` indices, as a stream can be.

    A block's rows meet in one task, at most ``buffer``.
    """
    d = df.withColumns({"__block": F.floor(F.col(IDX) / buffer), "__u": keyed.uniform(F.col(IDX), "buffer", seed)})
    rank = F.row_number().over(Window.partitionBy("__block").orderBy("__u", IDX)) - 1
    return d.withColumn("__pos", F.col("__block") * buffer + rank).drop("__block", "__u")


def reservoir(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows without replacement: those with the k least keyed draws."""
    return df.withColumn("__u", keyed.uniform(F.col(IDX), "reservoir", seed)).orderBy("__u", IDX).limit(k).drop("__u")


def reservoir_slot(idx: Column, capacity: int, seed: int = 0) -> Column:
    """Where the sequential reservoir writes row ``idx``: its own slot while filling, then slot j of [0, idx] if j < capacity, else none."""
    j = keyed.integer(keyed.uniform(idx, "reservoir/slot", seed), idx + 1)
    return F.when(idx < capacity, idx).when(j < capacity, j)


def reservoir_state(df: DataFrame, capacity: int, seed: int = 0) -> DataFrame:
    """What the sequential reservoir holds at the end: of each slot the last row written."""
    w = df.withColumn("__slot", reservoir_slot(F.col(IDX), capacity, seed)).filter("__slot is not null")
    last = w.groupBy("__slot").agg(F.max(IDX).alias("__last"))
    return w.join(last.withColumnRenamed("__slot", "__s"), (F.col("__slot") == F.col("__s")) & (F.col(IDX) == F.col("__last"))).drop("__s", "__last")
