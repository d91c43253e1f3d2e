"""Keeping results: in memory with spill, on disk as a table, or streamed ahead to the driver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Computed once while the block runs, then released."""
    try:
        yield df.persist(level)
    finally:
        df.unpersist()


def kept_at(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Written on the first call, read on later ones; a write that did not end does not count."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p.suffix("/_SUCCESS")):
        df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def rows_ahead(df: DataFrame) -> Iterator[Row]:
    """Rows on the driver one by one while the next partition is computed."""
    return df.toLocalIterator(prefetchPartitions=True)


def resolve(folder: str | None, default: str, name: str) -> str:
    """Path of a named cache below the given or default folder, of any store; it comes into being when something is written."""
    return f"{(folder or default).rstrip('/')}/{name}"
