"""Splits of dataset hubs that were exported to files: Parquet shards, or Arrow streams, read where they are.

An export is a folder with files ``<name>-<split>-00000-of-00005.parquet`` (the name may be missing), or with a folder for each
split. Nothing is downloaded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from weirflow.operators.base import IDX

from .indexed import Source, with_index


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    """Record batches of an Arrow file or stream, one in memory at a time."""
    with pa.memory_map(path) as source:
        head = source.read(6)
        source.seek(0)
        if head == b"ARROW1":
            f = pa.ipc.open_file(source)
            yield from (f.get_batch(i) for i in range(f.num_record_batches))
        else:
            yield from pa.ipc.open_stream(source)


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, p: _File) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in _batches(p.path):
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.path] * n, pa.string()), pa.array(range(at, at + n), pa.int64())], names=[*b.schema.names, "__file", "__row"])
            at += n


class ArrowSource(DataSource):
    """``spark.read.format("arrow_files").option("paths", ...)``: columns of the files, ``__file`` and ``__row``. Paths are separated by newlines."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def _paths(self) -> list[str]:
        return self.options["paths"].split("\n")

    def schema(self) -> StructType:
        first = next(_batches(self._paths()[0]), None)
        if first is None:
            raise ValueError(f"no record batch in {self._paths()[0]}")
        return from_arrow_schema(first.schema).add("__file", "string").add("__row", "long")

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self._paths())


def files_of(spark: SparkSession, folder: str, split: str) -> list[str]:
    """Paths of a split's files, in the order of their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kind = r"\.(?:parquet|arrow)"
    shard = re.compile(rf"(?:.*[-_])?{re.escape(split)}(?:-\d+-of-\d+)?{kind}")
    found = [s.getPath() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
    own = [p for p in found if shard.fullmatch(p.getName())]
    if not own and fs.exists(path(f"{folder}/{split}")):
        own = [s.getPath() for s in fs.listStatus(path(f"{folder}/{split}")) if re.fullmatch(rf"[^._].*{kind}", s.getPath().getName())]
    if not own:
        raise FileNotFoundError(f"no split {split!r} in {folder}; nothing is downloaded")
    return sorted(p.toString() for p in own)


def from_export(
    spark: SparkSession, folder: str, split: str = "train", include: tuple[str, ...] | None = None, exclude: tuple[str, ...] | None = None, supervised: tuple[str, str] | None = None, shuffle_seed: int | None = None
) -> Source:
    """A split as a source, numbered in the order of its files and their rows. ``supervised``: the two fields that become ``input`` and ``target``."""
    paths = files_of(spark, folder, split)
    if paths[0].endswith(".parquet"):
        df: DataFrame = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    else:
        spark.dataSource.register(ArrowSource)
        df = spark.read.format("arrow_files").option("paths", "\n".join(re.sub("^file:/+", "/", p) for p in paths)).load()
    if supervised is not None:
        if include is not None or exclude is not None:
            raise ValueError("supervised fields exclude include and exclude")
        df = df.select(F.col(supervised[0]).alias("input"), F.col(supervised[1]).alias("target"), "__file", "__row")
    elif include is not None:
        df = df.select(*include, "__file", "__row")
    df = with_index(df.drop(*(exclude or ())), ["__file", "__row"]).drop("__file", "__row")
    return Source(df.select(IDX, *[c for c in df.columns if c != IDX]), df.count(), shuffle_seed)
