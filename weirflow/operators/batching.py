"""Batches: consecutive groups of rows by position, and regrouping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import IDX

LAST = ("keep", "drop", "pad", "wrap")


@dataclass(frozen=True)
class Batcher:
    """Rows to batches of ``size``. The last, short one is kept, dropped, padded (``valid`` false) or filled from the start."""

    size: int
    last: str = "keep"

    def __post_init__(self) -> None:
        if self.size < 1 or self.last not in LAST:
            raise ValueError(f"size must be at least 1 and last one of {LAST}")

    def count(self, n: int) -> int:
        return n // self.size if self.last == "drop" else -(-n // self.size)

    def assign(self, df: DataFrame, n: int) -> DataFrame:
        """``df`` plus batch_id, slot and valid; no shuffle."""
        d = df.withColumns({"batch_id": F.floor(F.col(IDX) / self.size), "slot": F.pmod(F.col(IDX), F.lit(self.size)), "valid": F.lit(True)})
        short = -n % self.size
        if self.last == "drop":
            return d.filter(F.col(IDX) < n - n % self.size)
        if not short or self.last == "keep":
            return d
        final = n // self.size
        if self.last == "wrap":  # rows again, as often as a batch longer than the table needs
            again = F.explode(F.sequence(F.col(IDX), F.lit(short - 1).cast("long"), F.lit(n).cast("long")))
            more = df.filter(F.col(IDX) < short).withColumn("__fill", again)
            valid = True
        else:  # copies of the last row that do not count
            more = df.filter(F.col(IDX) == n - 1).withColumn("__fill", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(short - 1).cast("long"))))
            valid = False
        more = more.withColumns({"batch_id": F.lit(final).cast("long"), "slot": F.col("__fill") + n % self.size, "valid": F.lit(valid)}).drop("__fill")
        return d.unionByName(more)

    def collate(self, df: DataFrame, n: int, fn: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
        """One row a batch: each field an array in slot order, or what ``fn`` makes of these arrays.

        Rows of a batch meet in one task, at most ``size``.
        """
        d = self.assign(df, n)
        names = [c for c in d.columns if c not in ("batch_id", "slot", IDX)]
        rows = F.sort_array(F.collect_list(F.struct("slot", *names)))
        fields = {c: F.col(f"r.{c}") for c in names}
        return d.groupBy("batch_id").agg(rows.alias("r")).select("batch_id", *[v.alias(k) for k, v in (fn(fields) if fn else fields).items()])


def rebatch(df: DataFrame, group: int, n: int) -> DataFrame:
    """Groups of ``group`` rows as arrays, by index; n must be a multiple."""
    if n % group:
        raise ValueError(f"{n} rows are not a multiple of {group}")
    return Batcher(group).collate(df, n).drop("valid")


def unbatch(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows again from arrays of equal length, with their slot."""
    names = [c for c in df.columns if c != batch]
    zipped = F.arrays_zip(*[F.col(c) for c in names])
    return df.select(batch, F.posexplode(zipped).alias("slot", "r")).select(batch, "slot", *[F.col(f"r.{c}").alias(c) for c in names])


def slice_rows(df: DataFrame, start: int, stop: int) -> DataFrame:
    return df.filter((F.col(IDX) >= start) & (F.col(IDX) < stop))


def split_equal(df: DataFrame, parts: int, n: int) -> DataFrame:
    """``df`` plus ``part``: equal contiguous parts; n must be a multiple."""
    if n % parts:
        raise ValueError(f"{n} rows do not split into {parts} equal parts")
    return df.withColumn("part", F.floor(F.col(IDX) / (n // parts)))


def concatenate(frames: list[DataFrame], lengths: list[int]) -> DataFrame:
    """Frames one after the other, indices going on."""
    out, base = None, 0
    for f, n in zip(frames, lengths):
        one = f.withColumn(IDX, F.col(IDX) + base)
        out = one if out is None else out.unionByName(one)
        base += n
    return out


def add_batch_dimension(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.array(c) for c in names})


def remove_batch_dimension(df: DataFrame, names: list[str]) -> DataFrame:
    """Out of arrays of one entry; any other length is an error when read."""
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1)).otherwise(F.raise_error(F.concat(F.lit(f"{c}: not one entry but "), F.size(c).cast("string"))))
    return df.withColumns({c: one(c) for c in names})


def upsample(x: Column, factor: int) -> Column:
    """Each entry ``factor`` times."""
    if not isinstance(factor, int) or factor < 1:
        raise ValueError("factors are integers of at least 1")
    return x if factor == 1 else F.flatten(F.transform(x, lambda v: F.array_repeat(v, factor)))


def align(df: DataFrame, factors: dict[str, int]) -> DataFrame:
    """Channels of different rates brought to one length by repeating entries."""
    return df.withColumns({c: upsample(F.col(c), k) for c, k in factors.items()})


def contiguous_bounds(n: int, shards: int, drop_remainder: bool = True) -> list[tuple[int, int]]:
    """Bounds of an even contiguous split; what is left over is dropped, or given one each to the first shards."""
    q, r = divmod(n, shards)
    if drop_remainder:
        return [(i * q, (i + 1) * q) for i in range(shards)]
    starts = [i * q + min(i, r) for i in range(shards + 1)]
    return list(zip(starts, starts[1:]))


def shard(df: DataFrame, n: int, shard_id: int, shards: int, how: str = "contiguous", drop_remainder: bool = True) -> DataFrame:
    """One shard's rows: a contiguous range, or each ``shards``-th position."""
    if not 0 <= shard_id < shards:
        raise ValueError("shard_id must be in [0, shards)")
    if how == "strided":
        return df.filter(F.pmod(F.col(IDX), F.lit(shards)) == shard_id)
    return slice_rows(df, *contiguous_bounds(n, shards, drop_remainder)[shard_id])
