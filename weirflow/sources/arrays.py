"""Arrays on disk as a Spark data source: ``.npy`` files read by ranges of rows and written by tasks, on any store that Arrow has a file system for."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files


def header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, kind, place of the first row) of an open ``.npy`` file."""
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1:
        raise ValueError("columns first: rows cannot be read by ranges")
    if kind.hasobject or not shape:
        raise ValueError(f"no rows of numbers: shape {shape}, kind {kind}")
    return shape, kind, f.tell()


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int) -> None:
        self.path, self.start, self.end, self.first = path, start, end, first


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[_Range]:
        out, first = [], 0
        for path in files.listed(self.path, ".npy"):
            with files.opened(path) as f:
                n = header(f)[0][0]
            out += [_Range(path, i, min(i + self.rows, n), first + i) for i in range(0, n, self.rows)]
            first += n
        return out or [_Range("", 0, 0, 0)]

    def read(self, p: _Range) -> Iterator[pa.RecordBatch]:
        if p.start == p.end:
            return
        with files.opened(p.path) as f:
            shape, kind, at = header(f)
            width = int(np.prod(shape[1:]))
            f.seek(at + p.start * width * kind.itemsize)
            data = np.frombuffer(f.read((p.end - p.start) * width * kind.itemsize), kind).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(data) + 1, max(width, 1), dtype=np.int32)), pa.array(data))
        yield pa.RecordBatch.from_arrays([pa.array(range(p.first, p.first + p.end - p.start), pa.int64()), lists], names=["__idx", "data"])


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class NpyWriter(DataSourceArrowWriter):
    """Every task writes its rows in files of at most ``rows`` rows; their names follow the order of the partitions."""

    def __init__(self, folder: str, schema: StructType, rows: int, overwrite: bool) -> None:
        self.folder, self.rows, self.overwrite, self.job = folder.rstrip("/"), rows, overwrite, uuid.uuid4().hex[:12]
        if len(schema) != 1 or not schema[0].dataType.simpleString().startswith("array<"):
            raise ValueError("one column of arrays makes a .npy file")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        part, paths, own, n = TaskContext.get().partitionId(), [], [], 0
        mark = uuid.uuid4().hex[:8]

        def flush() -> None:
            nonlocal own, n
            column = pa.chunked_array(own).combine_chunks()
            if column.null_count or column.flatten().null_count or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
                raise ValueError("rows of a .npy file are arrays of one length, without nulls")
            data = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
            path = f"{self.folder}/part-{part:06d}-{len(paths):06d}-{self.job}-{mark}.npy"
            files.put(path, lambda out: np.lib.format.write_array(out, data, allow_pickle=False))
            paths.append(path)
            own, n = [], 0

        for b in iterator:
            start = 0
            while start < b.num_rows:
                piece = b.column(0).slice(start, self.rows - n)
                own.append(piece)
                n, start = n + len(piece), start + len(piece)
                if n == self.rows:
                    flush()
        if n:
            flush()
        return _Written(paths)

    def commit(self, messages: list[_Written | None]) -> None:
        if self.overwrite:
            own = {p for m in messages if m is not None for p in m.paths}
            try:
                files.removed([p for p in files.listed(self.folder, ".npy") if p not in own])
            except FileNotFoundError:
                pass

    def abort(self, messages: list[_Written | None]) -> None:
        files.removed([p for m in messages if m is not None for p in m.paths])


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: ``__idx`` and ``data``, the row flattened; a file or a folder of files. Option ``rows``: of a partition, or of a file written."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "__idx long, data array<float>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", 4096)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema, int(self.options.get("rows", 65536)), overwrite)


def saved(df, folder: str, column: str = "data", order: str = "__idx", rows: int = 65536) -> str:
    """A column of arrays of one length as a folder of ``.npy`` files in the order of ``order``, written by the tasks; the opposite of reading."""
    register(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.select(order, column).repartitionByRange(n, order).sortWithinPartitions(order).select(column).write.format("npy").option("rows", rows).mode("overwrite").save(folder)
    return folder


def register(spark) -> None:
    spark.dataSource.register(NpySource)
