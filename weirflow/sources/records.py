"""Record files: compressed chunks of records with an index of the chunks at the end, as a Spark data source.

A file is a magic number, chunks, a footer and the footer's length. A chunk holds up to ``chunk`` records as a compressed Arrow
stream; the footer has the place, size, number of records and checksum of each. A dataset is a folder of such files and a manifest that repeats their
footers, written when all tasks have succeeded: what failed or repeated tasks leave behind is no part of it, and
planning a scan opens one file. Records are numbered through the files of the manifest.

Lists and ranges of record numbers go to the index of chunks: only chunks that hold wanted records are read, by
their offsets, on any store that Arrow has a file system for. They are options of the scan (:func:`read`), not filters that Spark
pushes: Spark 4.1 keeps a Python reader with the filters of one query for the next query on the same DataFrame, which then
misses rows. :func:`from_records` makes a dataset a :class:`Source`, with
epochs, a new shuffled order for each, batches by position and cursors.

Defined results: an empty table makes a dataset of no records with its schema; nulls and nested values are kept; a chunk whose checksum
is wrong, a file that is cut off and another kind of file are errors, never missing records.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from weirflow.operators.base import IDX

from . import files
from .indexed import Source

MAGIC = b"WRC1"
MANIFEST = "_records.json"
#: Records of a chunk, and of a partition of a scan.
CHUNK, PARTITION = 1024, 1 << 17
#: Records of a stream's batch, and their compressed bytes, unless a block of its shuffle buffer has more.
STRETCH, STRETCH_BYTES = 1 << 13, 1 << 22


@dataclass(frozen=True)
class Chunk:
    offset: int
    size: int
    rows: int
    check: int


def write_file(out, batches: Iterable[pa.RecordBatch], chunk: int) -> list[Chunk]:
    """One file; at most a chunk and a batch are in memory."""
    out.write(MAGIC)
    at, chunks, own, n = len(MAGIC), [], [], 0

    def flush() -> None:
        nonlocal at, own, n
        if n:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(own).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            data = sink.getvalue().to_pybytes()
            out.write(data)
            chunks.append(Chunk(at, len(data), n, zlib.crc32(data)))
            at, own, n = at + len(data), [], 0

    for b in batches:
        start = 0
        while start < b.num_rows:
            piece = b.slice(start, chunk - n)
            own.append(piece)
            n, start = n + piece.num_rows, start + piece.num_rows
            if n == chunk:
                flush()
    flush()
    footer = json.dumps([[c.offset, c.size, c.rows, c.check] for c in chunks]).encode()
    out.write(footer)
    out.write(len(footer).to_bytes(8, "little") + MAGIC)
    return chunks


def read_footer(path: str) -> list[Chunk]:
    """The index of one file."""
    with files.opened(path) as f:
        end = f.size()
        f.seek(max(0, end - 12))
        tail = f.read(12)
        if len(tail) < 12 or tail[8:] != MAGIC:
            raise ValueError(f"{path} is no record file, or cut off")
        size = int.from_bytes(tail[:8], "little")
        f.seek(end - 12 - size)
        return [Chunk(*c) for c in json.loads(f.read(size))]


def read_chunk(f, path: str, c: Chunk) -> pa.Table:
    f.seek(c.offset)
    data = f.read(c.size)
    if len(data) != c.size or zlib.crc32(data) != c.check:
        raise ValueError(f"{path}: the chunk at {c.offset} is damaged")
    return pa.ipc.open_stream(data).read_all()


def manifest_of(folder: str) -> dict:
    try:
        with files.opened(f"{folder.rstrip('/')}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        raise FileNotFoundError(f"no record dataset in {folder}") from None


class _Part(InputPartition):
    """Chunks of one file: (first record, chunk)."""

    def __init__(self, path: str, chunks: list[tuple[int, Chunk]]) -> None:
        self.path, self.chunks = path, chunks


class RecordReader(DataSourceReader):
    """``wanted``: record numbers, or None for all; ``low`` and ``high``: the first and last of a range."""

    def __init__(self, folder: str, schema: StructType, rows: int, wanted: list[int] | None = None, low: int = 0, high: int = 1 << 62) -> None:
        self.folder, self.schema, self.rows = folder, schema, rows
        self.wanted, self.low, self.high = None if wanted is None else sorted(set(wanted)), low, high

    def _holds(self, first: int, rows: int) -> bool:
        if first > self.high or first + rows <= self.low:
            return False
        if self.wanted is None:
            return True
        k = bisect.bisect_left(self.wanted, max(first, self.low))
        return k < len(self.wanted) and self.wanted[k] <= min(first + rows - 1, self.high)

    def partitions(self) -> list[_Part]:
        out, first = [], 0
        for name, chunks in manifest_of(self.folder)["files"]:
            own, n = [], 0
            for c in (Chunk(*c) for c in chunks):
                if self._holds(first, c.rows):
                    own.append((first, c))
                    n += c.rows
                    if n >= self.rows:
                        out.append(_Part(f"{self.folder.rstrip('/')}/{name}", own))
                        own, n = [], 0
                first += c.rows
            if own:
                out.append(_Part(f"{self.folder.rstrip('/')}/{name}", own))
        return out or [_Part("", [])]

    def read(self, p: _Part) -> Iterator[pa.RecordBatch]:
        if not p.chunks:
            return
        with files.opened(p.path) as f:
            for first, c in p.chunks:
                table = read_chunk(f, p.path, c)
                table = table.add_column(0, IDX, pa.array(range(first, first + c.rows), pa.int64()))
                if self.low > first or self.high < first + c.rows - 1:
                    table = table.slice(max(0, self.low - first), self.high - max(first, self.low) + 1)
                if self.wanted is not None:
                    a, b = bisect.bisect_left(self.wanted, first), bisect.bisect_left(self.wanted, first + c.rows)
                    own = [i - first - max(0, self.low - first) for i in self.wanted[a:b] if self.low <= i <= self.high]
                    table = table.take(own)
                yield from table.select(self.schema.names).to_batches()


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    chunks: list[list[int]]


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, chunk: int, overwrite: bool) -> None:
        self.folder, self.schema, self.chunk, self.overwrite = folder.rstrip("/"), schema, chunk, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{self.job}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}.rec"
        chunks: list[Chunk] = []
        files.put(f"{self.folder}/{name}", lambda out: chunks.extend(write_file(out, iterator, self.chunk)))
        return _Written(task.partitionId(), name, [[c.offset, c.size, c.rows, c.check] for c in chunks])

    def commit(self, messages: list[_Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        before = []
        try:
            before = manifest_of(self.folder)["files"]
        except FileNotFoundError:
            pass
        kept = [] if self.overwrite else before
        data = {"schema": self.schema.json(), "files": [*kept, *([m.name, m.chunks] for m in done)]}
        files.removed([f"{self.folder}/{MANIFEST}"])
        files.put(f"{self.folder}/{MANIFEST}", lambda out: out.write(json.dumps(data).encode()))
        if self.overwrite:
            files.removed([f"{self.folder}/{name}" for name, _ in before])

    def abort(self, messages: list[_Written | None]) -> None:
        files.removed([f"{self.folder}/{m.name}" for m in messages if m is not None])


class RecordSource(DataSource):
    """``spark.read.format("records").load(folder)``: ``__idx`` and the columns; ``df.write.format("records").save(folder)``.

    Options: ``chunk`` records of a chunk (writing); ``rows`` records of a partition, ``wanted`` numbers of records as a JSON list,
    ``low`` and ``high`` ends of a range of them (reading).
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> StructType:
        kept = StructType.fromJson(json.loads(manifest_of(self.options["path"])["schema"]))
        return StructType([StructField(IDX, LongType()), *kept.fields])

    def reader(self, schema: StructType) -> RecordReader:
        o = self.options
        wanted = json.loads(o["wanted"]) if "wanted" in o else None
        return RecordReader(o["path"], schema, int(o.get("rows", PARTITION)), wanted, int(o.get("low", 0)), int(o.get("high", 1 << 62)))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema, int(self.options.get("chunk", CHUNK)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)


def saved(df: DataFrame, folder: str, by: str = IDX, chunk: int = CHUNK, mode: str = "overwrite") -> str:
    """A table as a record dataset in the order of ``by``, written by its tasks; ``by`` itself is kept unless it is the index."""
    register(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, F.col(by)).sortWithinPartitions(by)
    (ordered.drop(IDX) if by == IDX else ordered).write.format("records").option("chunk", chunk).mode(mode).save(folder)
    return folder


def read(spark: SparkSession, folder: str, wanted: range | list[int] | None = None, rows: int = PARTITION) -> DataFrame:
    """All records, or those of a range or a list of numbers, from the chunks that hold them."""
    register(spark)
    r = spark.read.format("records").option("rows", rows)
    if isinstance(wanted, range) and wanted.step == 1:
        r = r.option("low", wanted.start).option("high", wanted.stop - 1)
    elif wanted is not None:
        r = r.option("wanted", json.dumps(list(wanted)))
    return r.load(folder)


def from_records(spark: SparkSession, folder: str, **options) -> Source:
    """A dataset as an indexed source; its length comes from the manifest, batches by position read their chunks only."""
    length = sum(c[2] for _, chunks in manifest_of(folder)["files"] for c in chunks)
    return Source(read(spark, folder), length, lookup=lambda wanted: read(spark, folder, wanted), **options)


# ------------------------------------------------------------------ streams


class _Span(InputPartition):
    """Positions of one epoch, and the chunks that hold their blocks of the shuffle buffer: (first record, file, chunk)."""

    def __init__(self, epoch: int, start: int, end: int, length: int, chunks: list[tuple[int, str, Chunk]]) -> None:
        self.epoch, self.start, self.end, self.length, self.chunks = epoch, start, end, length, chunks


class RecordStreamReader(DataSourceStreamReader):
    """Records as an unbounded table: epoch after epoch, mixed inside consecutive blocks of ``buffer`` records.

    An offset is a position in the endless order; which record is there follows from (seed, epoch, block) alone, so a
    restarted query reads what the stopped one would have read, and no buffer has to be kept. At most ``ahead`` positions
    are offered beyond those already planned. Spark does not say where a restarted query stands when it asks for the latest
    offset, so with ``ahead`` the planned end is noted in the folder ``progress`` (one for each query).
    """

    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.schema = options["path"], schema
        self.buffer, self.seed, self.epochs = int(options.get("buffer", 1)), int(options.get("seed", 0)), int(options.get("epochs", 1))
        self.ahead, self.progress = int(options.get("ahead", 0)), options.get("progress")
        if self.buffer < 1 or self.ahead < 0 or self.epochs < 0:
            raise ValueError("buffer must be at least 1, ahead and epochs not negative")
        if self.ahead and not self.progress:
            raise ValueError("a bounded look-ahead needs a folder for the progress of its query")
        if not self.epochs and not self.ahead:
            raise ValueError("endless epochs need a bounded look-ahead")
        self.rows = max(self.buffer, int(options.get("rows", PARTITION)) // self.buffer * self.buffer)
        self.length = sum(c[2] for _, chunks in manifest_of(self.folder)["files"] for c in chunks)
        self.planned = self._noted()
        self.index: tuple[list[str], np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": None}

    def _chunks(self, low: int, high: int) -> list[tuple[int, str, Chunk]]:
        """The chunks of records low ... high - 1; the manifest is read by the process that plans, once."""
        if self.index is None:
            names, rows = [], [np.empty((0, 5), np.int64)]
            for name, chunks in manifest_of(self.folder)["files"]:
                rows.append(np.insert(np.array(chunks, np.int64).reshape(-1, 4), 0, len(names), axis=1))
                names.append(name)
            table = np.concatenate(rows)
            self.index = names, np.insert(table, 0, np.cumsum(table[:, 3]) - table[:, 3], axis=1)
        names, table = self.index
        a, b = np.searchsorted(table[:, 0], low, "right") - 1, np.searchsorted(table[:, 0], high)
        return [(first, names[k], Chunk(*c)) for first, k, *c in table[a:b].tolist()]

    def _records(self, p: _Span, low: int, high: int, held: list) -> pa.Table:
        """Records low ... high - 1 of a span's chunks. ``held``: the file that is open, the chunk read last."""
        starts, tables = [first for first, _, _ in p.chunks], []
        for first, name, c in p.chunks[bisect.bisect_right(starts, low) - 1 : bisect.bisect_left(starts, high)]:
            if held[1] != first:
                path = f"{self.folder.rstrip('/')}/{name}"
                if held[0] is None or held[0][0] != name:
                    if held[0] is not None:
                        held[0][1].close()
                    held[0] = name, files.opened(path)
                held[1:] = first, read_chunk(held[0][1], path, c)
            a, b = max(low, first) - first, min(high, first + c.rows) - first
            tables.append(held[2].slice(a, b - a))
        return pa.concat_tables(tables)

    def _noted(self) -> int:
        if not self.progress:
            return 0
        try:
            with files.opened(f"{self.progress.rstrip('/')}/planned.json") as f:
                return json.loads(f.read())["end"]
        except FileNotFoundError:
            return 0

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        ends = [self.length * self.epochs] if self.epochs or not self.length else []
        return {"position": min([*ends, *([self.planned + self.ahead] if self.ahead else [])])}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        a, b = start["position"], end["position"]
        if b > self.planned:
            self.planned = b
            if self.progress:
                at = f"{self.progress.rstrip('/')}/planned.json"
                files.put(at, lambda out: out.write(json.dumps({"end": b}).encode()))
        out = []
        while a < b:
            epoch, inside = divmod(a, self.length)
            stop = min(self.length, inside + b - a, (inside // self.rows + 1) * self.rows)
            low, high = inside // self.buffer * self.buffer, min(-(-stop // self.buffer) * self.buffer, self.length)
            out.append(_Span(epoch, inside, stop, self.length, self._chunks(low, high)))
            a += stop - inside
        return out

    def read(self, p: _Span) -> Iterator[pa.RecordBatch]:
        # several blocks at a time, for a batch of few rows costs as much as one of many
        size = sum(c.size for _, _, c in p.chunks) / sum(c.rows for _, _, c in p.chunks)
        many = max(1, int(min(STRETCH, STRETCH_BYTES / size)) // self.buffer)
        held: list = [None, None, None]
        try:
            for block in range(p.start // self.buffer, (p.end - 1) // self.buffer + 1, many):
                low, high = block * self.buffer, min((block + many) * self.buffer, -(-p.end // self.buffer) * self.buffer, p.length)
                a, b = max(p.start, low), min(p.end, high)
                if self.buffer > 1:
                    order = np.concatenate([x - low + self._order(p.epoch, x // self.buffer, min(self.buffer, p.length - x)) for x in range(low, high, self.buffer)])[a - low : b - low]
                    table = self._records(p, low, high, held).take(pa.array(order))
                else:
                    order, table = np.arange(b - a), self._records(p, low, high, held)
                pos = pa.array(np.arange(p.epoch * p.length + a, p.epoch * p.length + b))
                table = table.add_column(0, "__pos", pos).add_column(1, "__epoch", pa.array(np.full(b - a, p.epoch))).add_column(2, IDX, pa.array(order + low))
                yield from table.select(self.schema.names).combine_chunks().to_batches()
        finally:
            if held[0] is not None:
                held[0][1].close()

    def _order(self, epoch: int, block: int, rows: int) -> np.ndarray:
        return np.random.Generator(np.random.Philox([self.seed, epoch * 2**32 + block])).permutation(rows)

    def commit(self, end: dict) -> None:
        """Nothing is kept of what has been read."""


class RecordStreamSource(DataSource):
    """``spark.readStream.format("record_stream")``; options as of :func:`stream`."""

    @classmethod
    def name(cls) -> str:
        return "record_stream"

    def schema(self) -> StructType:
        kept = StructType.fromJson(json.loads(manifest_of(self.options["path"])["schema"]))
        return StructType([*(StructField(c, LongType()) for c in ("__pos", "__epoch", IDX)), *kept.fields])

    def streamReader(self, schema: StructType) -> RecordStreamReader:
        return RecordStreamReader(dict(self.options), schema)


def stream(spark: SparkSession, folder: str, buffer: int = 1, seed: int = 0, epochs: int = 1, ahead: int = 0, progress: str | None = None, rows: int = PARTITION) -> DataFrame:
    """A record dataset as a stream with ``__pos``, ``__epoch`` and ``__idx``. ``epochs`` 0: endless; ``ahead`` 0: all at once.

    The dataset must stay as it is while the query lives.
    """
    spark.dataSource.register(RecordStreamSource)
    options = {"buffer": buffer, "seed": seed, "epochs": epochs, "ahead": ahead, "rows": rows} | ({"progress": progress} if progress else {})
    return spark.readStream.format("record_stream").options(**options).load(folder)
