"""Bounded sources with a dense index, and what can be read of them by position.

The index is ``__idx``, 0 to N-1. A natural key that is dense is taken as it is (no shuffle); else rows are
range-partitioned by key, written down, and numbered in two passes (counts per partition, then offsets), so
no task ever holds the whole table.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions import keyed
from weirflow.lineage import cut
from weirflow.operators.base import IDX


#: Shuffled positions of a batch that are looked up one by one.
LISTED = 4096


def with_index(df: DataFrame, by: list[str | Column] | None = None, dense: str | None = None) -> DataFrame:
    """``df`` plus its index: a column that is dense already, or the rank by ``by`` (a total order)."""
    if dense is not None:
        return df.withColumn(IDX, F.col(dense).cast("long"))
    if not by:
        raise ValueError("an index needs a dense column or a total order")
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down, for the bounds of the ranges come from a sample and would differ from one run of the plan to the next
    ranged = cut(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row a partition
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("__part").alias("__p"), "__base")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return ranged.withColumn("__in", inside).join(F.broadcast(base), F.col("__part") == F.col("__p")).withColumn(IDX, F.col("__base") + F.col("__in")).drop("__part", "__p", "__base", "__in")


def dense_length(df: DataFrame, index: str = IDX) -> int:
    """The number of rows, if ``index`` holds each of 0 to N-1 once; else ValueError.

    One scan of that column: counts, bounds and bitmaps of 32,768 places each, combined before they are shuffled.
    """
    i = F.col(index)
    bits = df.groupBy(F.bitmap_bucket_number(i).alias("b")).agg(F.count("*").alias("n"), F.count(i).alias("k"), F.min(i).alias("low"), F.max(i).alias("high"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(i))).alias("d"))
    n, k, low, high, different = bits.agg(F.sum("n"), F.sum("k"), F.min("low"), F.max("high"), F.sum("d")).first()
    if n and not (n == k == different and low == 0 and high == n - 1):
        raise ValueError(f"{index!r} is no dense index: {n} rows, {n - k} nulls, {different} different values from {low} to {high}")
    return n or 0


def among(column: Column, values: list[int]) -> Column:
    """Whether the column is one of the values, as a balanced tree of short lists: a longer one reaches a scan as a mere range."""
    values = sorted(set(values))
    parts = [column.isin(values[k : k + 8]) for k in range(0, len(values), 8)] or [F.lit(False)]
    while len(parts) > 1:
        parts = [parts[k] | parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


@dataclass(frozen=True)
class Source:
    """A bounded, indexed source. ``shuffle_seed`` orders each epoch by a keyed permutation of the index.

    ``exact`` takes the permutation that SQL engines can repeat, which costs more. ``lookup`` reads the rows of a range or a list of
    indices, where that is better done by the format than by a filter.
    """

    df: DataFrame
    length: int
    shuffle_seed: int | None = None
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    exact: bool = False
    lookup: Callable[[range | list[int]], DataFrame] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if IDX not in self.df.columns:
            raise ValueError(f"no index column {IDX!r}: use with_index")
        if self.include is not None and self.exclude is not None:
            raise ValueError("include and exclude exclude each other")

    def __len__(self) -> int:
        return self.length

    def _fields(self, df: DataFrame | None = None) -> DataFrame:
        df = self.df if df is None else df
        if self.include is not None:
            return df.select(IDX, *[c for c in self.include if c != IDX])
        return df.drop(*(self.exclude or ()))

    def _among(self, wanted: list[range] | list[int]) -> DataFrame:
        """The rows of some ranges, or of a list, of indices."""
        if isinstance(wanted[0], range):
            if self.lookup is not None:
                parts = [self._fields(self.lookup(r)) for r in wanted]
                return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            tests = [F.col(IDX).between(r.start, r.stop - 1) for r in wanted]
            return self._fields().filter(tests[0] if len(tests) == 1 else tests[0] | tests[1])
        return self._fields(self.lookup(wanted)) if self.lookup is not None else self._fields().filter(among(F.col(IDX), wanted))

    def epoch(self, n: int = 0) -> DataFrame:
        """All rows with ``__pos``, their place in epoch n's order."""
        return self._positioned(self._fields(), n)

    def _positioned(self, df: DataFrame, epoch: int) -> DataFrame:
        pos = F.col(IDX) if self.shuffle_seed is None else keyed.permuted(F.col(IDX), self.length, self._seed(epoch), exact=self.exact)
        return df.withColumn("__pos", pos)

    def at(self, index: int) -> DataFrame:
        """One row; negative numbers count from the end."""
        if not -self.length <= index < self.length:
            raise IndexError(f"{index} is outside a source of {self.length}")
        return self._fields().filter(F.col(IDX) == index % self.length)

    def take_indices(self, indices: DataFrame) -> DataFrame:
        """Rows for a DataFrame of indices (column ``__idx``), repeats included."""
        return indices.select(IDX).join(self._fields(), IDX)

    def _seed(self, epoch: int) -> int:
        return (self.shuffle_seed + epoch) % (1 << 32)

    def indices_at(self, start: int, size: int, epoch: int = 0) -> list[int]:
        """The indices at positions start to start + size - 1 of an epoch, wrapping round the end.

        Of a shuffled source by the inverse of its permutation, for these positions alone; a list of ``size``, no job reads data.
        """
        places = [(start + k) % self.length for k in range(min(size, self.length))]
        if self.shuffle_seed is None or not places:
            return places
        one = self.df.sparkSession.sql("SELECT 0 AS none")  # a row of its own: evaluated by the driver, without a job
        at = F.transform(F.lit(places), lambda p: keyed.unpermuted(p, self.length, self._seed(epoch), exact=self.exact))
        return one.select(at.alias("at")).first()["at"]

    def batch_at(self, start: int, size: int, epoch: int = 0) -> DataFrame:
        """Positions start to start + size - 1, wrapping round the end; ``__slot`` numbers them.

        What is wanted are values or ranges of the index itself, which reach the scan: what holds none of them is not read.
        A batch of more than ``LISTED`` shuffled positions is a filter on computed positions instead, which reads the table.
        """
        if size < 1:
            raise ValueError("a batch has at least one row")
        start = start % self.length
        reach = min(size, self.length)
        pos = F.pmod(F.col("__pos") - start, F.lit(self.length))
        if self.shuffle_seed is None:
            stop = start + reach
            df = self._among([range(start, min(stop, self.length)), *([range(stop - self.length)] if stop > self.length else [])])
        else:
            df = self._among(self.indices_at(start, reach, epoch)) if reach <= LISTED else None
        whole = df is None
        df = self._fields() if whole else df
        df = self._positioned(df, epoch).withColumn("__slot", pos)
        if whole:
            df = df.filter(F.col("__slot") < reach)
        if size > self.length:  # round more than once
            df = df.withColumn("__slot", F.explode(F.sequence("__slot", F.lit(size - 1).cast("long"), F.lit(self.length).cast("long"))))
        return df

    def positions(self, wanted: DataFrame, epoch: int = 0) -> DataFrame:
        """Rows for a DataFrame of positions (column ``__pos``) of any size: their indices, then one join."""
        at = F.col("__pos") if self.shuffle_seed is None else keyed.unpermuted(F.col("__pos"), self.length, self._seed(epoch), exact=self.exact)
        return wanted.select("__pos", at.alias(IDX)).join(self._fields(), IDX)

    def shuffled(self, seed: int | None) -> Source:
        return replace(self, shuffle_seed=seed)

    def shard(self, worker: int, workers: int, epoch: int = 0) -> DataFrame:
        """Positions worker, worker + workers, ...: together the workers have each row once."""
        return self.epoch(epoch).filter(F.pmod(F.col("__pos"), F.lit(workers)) == worker)

    def repeated(self, epochs: int, first: int = 0) -> DataFrame:
        """``epochs`` epochs from ``first`` on, with ``__epoch`` and positions that go on over epochs; one scan for any number.

        An endless repeat is read in such pieces.
        """
        if epochs < 1:
            raise ValueError("epochs must be at least 1")
        epoch = F.sequence(F.lit(first).cast("long"), F.lit(first + epochs - 1).cast("long"))
        df = self._fields().withColumn("__epoch", F.explode(epoch))
        pos = F.col(IDX) if self.shuffle_seed is None else keyed.permuted(F.col(IDX), self.length, F.pmod(F.col("__epoch") + self.shuffle_seed, F.lit(1 << 32)), exact=self.exact)
        return df.withColumn("__pos", pos + F.col("__epoch") * self.length)


def from_memory(spark: SparkSession, data: dict[str, list] | list[dict], **options) -> Source:
    """A dict of equally long lists, or a list of records."""
    if isinstance(data, dict):
        sizes = {k: len(v) for k, v in data.items()}
        if len(set(sizes.values())) > 1:
            raise ValueError(f"fields of unequal length: {sizes}")
        rows = [dict(zip(data, r)) for r in zip(*data.values())]
    else:
        rows = list(data)
    if not rows:
        raise ValueError("no records")
    df = spark.createDataFrame([{IDX: i, **r} for i, r in enumerate(rows)])
    return Source(df, len(rows), **options)


def from_path(spark: SparkSession, path: str, fmt: str = "parquet", by: list[str] | None = None, dense: str | None = None, schema=None, reader: dict | None = None, **options) -> Source:
    """A table in a file format that Spark reads; columns left out by include or exclude are not read."""
    r = spark.read.format(fmt).options(**(reader or {}))
    df = with_index((r.schema(schema) if schema is not None else r).load(path), by, dense)
    return Source(df, df.count() if dense is None else dense_length(df), **options)


def require_local(path: str, name: str = "dataset") -> str:
    """The path, if it exists; else an error that names what was looked for (no downloads here)."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{name} is not at {path}; data is only read where it already is")
    return path


def stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **reader) -> DataFrame:
    """An unbounded source over a folder of files."""
    return spark.readStream.format(fmt).schema(schema).options(**reader).load(path)


def as_dataframe(x, spark: SparkSession | None = None) -> DataFrame:
    """DataFrame, Source or finite sequence of records as a DataFrame; one-shot iterators are refused."""
    if isinstance(x, DataFrame):
        return x
    if isinstance(x, Source):
        return x.epoch()
    if isinstance(x, (list, tuple, dict)):
        if spark is None:
            raise ValueError("records need a session")
        return from_memory(spark, x if isinstance(x, dict) else list(x)).df
    raise TypeError(f"{type(x).__name__} cannot be read again; give a sequence, a Source or a DataFrame")


def limited(df: DataFrame, count: int, by: str = IDX) -> DataFrame:
    """The first rows by index."""
    if count < 0:
        raise ValueError("count must not be negative")
    return df.orderBy(by).limit(count)
