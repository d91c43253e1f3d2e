"""Length-prefixed record files of ``Example`` messages (TFRecord), read through Spark's own file reader and parsed in Arrow batches.

A record is its length (8 bytes), a masked CRC-32C of these, the bytes, and a masked CRC-32C of them. The bytes are a message of
features by name, each a list of byte strings, of floats or of integers. Files are read as Spark reads any file, so from any
store, one file a task at a time (by convention these are shards of some hundred MB; a file over the limit of Spark's
``binaryFile`` is an error). Writing is done by the tasks, one file each, on stores that Arrow has a file system for.

A schema says what becomes of a feature: a scalar column takes its single value, an array column its list. No feature, or
an empty list for a scalar, is null; a scalar column with several values, another kind of list, and a record whose checksum
or length is wrong are errors. Without a schema it is inferred from the first records of one file, all as lists; string columns
decode as UTF-8, binary ones do not.

On writing, null columns leave their feature out, empty arrays are empty lists; booleans and integers become integers, floats and
doubles become floats (of 32 bits, the format has no others). Nulls inside arrays are an error. Files without records, and empty ones, give no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from weirflow.lineage import cut
from weirflow.operators.base import IDX

from . import files
from .indexed import Source

_INTEGERS, _FLOATS, _BYTES = (LongType, IntegerType, ShortType, BooleanType), (FloatType, DoubleType), (BinaryType, StringType)
#: Bytes of a lane of the checksum; rows of a batch that leaves a task; bytes, or a record, whose checksums are made at once.
LANE, ROWS, SUMMED = 64, 1024, 1 << 21


# ------------------------------------------------------------------ checksum


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[list[int]]]:
    """The table of one byte, and what a lane of zeros makes of each byte of a checksum."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    moved = np.array([[b << (8 * k) for b in range(256)] for k in range(4)], np.uint32)
    for _ in range(LANE):
        moved = (moved >> 8) ^ t[moved & 255]
    return t, moved.tolist()


def crc32c(data: bytes) -> int:
    return crc32cs([data])[0]


def crc32cs(items: list[bytes]) -> list[int]:
    """CRC-32C of each: the lanes of equal length of all at once, then an item's one after the other by what a lane's length does to a checksum."""
    table, moved = _tables()
    padded, counts = [], []
    for data in items:
        if len(data) >= 4:
            head = (int.from_bytes(data[:4], "little") ^ 0xFFFFFFFF).to_bytes(4, "little")
            padded += [bytes(-len(data) % LANE), head, data[4:]]
        counts.append(-(-len(data) // LANE) if len(data) >= 4 else 0)
    # a column of all lanes lies together
    lanes = np.ascontiguousarray(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, LANE).T)
    sums = np.zeros(lanes.shape[1], np.uint32)
    for column in lanes:
        sums = (sums >> 8) ^ table[(sums ^ column) & 255]
    sums, at, out = sums.tolist(), 0, []
    a, b, c, d = moved
    for data, n in zip(items, counts):
        value = 0
        for x in sums[at : at + n]:
            value = a[value & 255] ^ b[value >> 8 & 255] ^ c[value >> 16 & 255] ^ d[value >> 24] ^ x
        at += n
        if not n:
            value = 0xFFFFFFFF
            for x in data:
                value = (value >> 8) ^ int(table[(value ^ x) & 255])
        out.append(value ^ 0xFFFFFFFF)
    return out


def masked(data: bytes) -> int:
    return masks([data])[0]


def masks(items: list[bytes]) -> list[int]:
    return [((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF for c in crc32cs(items)]


# ------------------------------------------------------------------ records


def records_of(data: bytes | memoryview, name: str = "") -> Iterator[bytes]:
    """The records of a file; ValueError where one is damaged or cut off."""
    for places, cut in _hops(data):
        heads = masks([data[at : at + 8] for at, _ in places] + ([data[cut : cut + 8]] if cut is not None and cut + 12 <= len(data) else []))
        bodies = [bytes(data[at + 12 : at + 12 + n]) for at, n in places]
        for (at, n), head, body, check in zip(places, heads, bodies, masks(bodies)):
            if head != struct.unpack_from("<I", data, at + 8)[0]:
                raise ValueError(f"{name}: the length at byte {at} is damaged")
            if check != struct.unpack_from("<I", data, at + 12 + n)[0]:
                raise ValueError(f"{name}: the record at byte {at} is damaged")
            yield body
        if cut is not None:
            if len(heads) > len(places) and heads[-1] != struct.unpack_from("<I", data, cut + 8)[0]:
                raise ValueError(f"{name}: the length at byte {cut} is damaged")
            raise ValueError(f"{name}: cut off at byte {cut}")


def _hops(data: bytes | memoryview) -> Iterator[tuple[list[tuple[int, int]], int | None]]:
    """(byte, length) of records, some at a time, as their lengths say; and the byte of one that would end after the file."""
    at, end, places, held = 0, len(data), [], 0
    while at < end:
        n = struct.unpack_from("<Q", data, at)[0] if at + 12 <= end else end
        if at + 16 + n > end:
            yield places, at
            return
        places.append((at, n))
        at, held = at + 16 + n, held + n
        if held > SUMMED or len(places) == ROWS:
            yield places, None
            places, held = [], 0
    if places:
        yield places, None


def counted(data: bytes | memoryview, name: str = "") -> int:
    """The number of a file's records, by their lengths alone; these are checked."""
    total = 0
    for places, cut in _hops(data):
        for (at, _), head in zip(places, masks([data[at : at + 8] for at, _ in places])):
            if head != struct.unpack_from("<I", data, at + 8)[0]:
                raise ValueError(f"{name}: the length at byte {at} is damaged")
        if cut is not None:
            raise ValueError(f"{name}: cut off, or the length damaged, at byte {cut}")
        total += len(places)
    return total


def framed(body: bytes) -> bytes:
    return frames([body])


def frames(bodies: list[bytes]) -> bytes:
    """The bytes of a file for some records."""
    lengths = [struct.pack("<Q", len(b)) for b in bodies]
    return b"".join(x for n, h, b, c in zip(lengths, masks(lengths), bodies, masks(bodies)) for x in (n, struct.pack("<I", h), b, struct.pack("<I", c)))


# ------------------------------------------------------------------ messages


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, kind, value) of a message's fields; lengths are checked."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"a field of kind {kind} in an Example")
        if at > len(data):
            raise ValueError("a field longer than its Example")
        yield tag >> 3, kind, value


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def parse(body: bytes) -> dict[str, tuple[str, list]]:
    """Features by name: kind (bytes, float or int) and values."""
    out: dict[str, tuple[str, list]] = {}
    for number, _, features in _fields(body):
        if number != 1:
            continue
        for _, _, entry in _fields(features):
            name, feature = "", b""
            for n, _, v in _fields(entry):
                if n == 1:
                    name = v.decode()
                elif n == 2:
                    feature = v
            for n, _, values in _fields(feature):
                kind, found = {1: "bytes", 2: "float", 3: "int"}[n], []
                for _, form, v in _fields(values):
                    if kind == "bytes":
                        found.append(v)
                    elif kind == "float":
                        found += np.frombuffer(v, "<f4").tolist()  # one value or all, packed
                    elif form == 0:
                        found.append(_signed(v))
                    else:
                        at = 0
                        while at < len(v):
                            x, at = _varint(v, at)
                            found.append(_signed(x))
                out[name] = (kind, found)
    return out


def _number(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def _block(number: int, data: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(data)) + data


def message(values: dict[str, tuple[str, list]]) -> bytes:
    """The opposite of :func:`parse`."""
    entries = b""
    for name, (kind, found) in values.items():
        if kind == "bytes":
            feature = _block(1, b"".join(_block(1, v) for v in found))
        elif kind == "float":
            feature = _block(2, _block(1, np.array(found, "<f4").tobytes()) if found else b"")
        else:
            feature = _block(3, _block(1, b"".join(map(_number, found))) if found else b"")
        entries += _block(1, _block(1, name.encode()) + _block(2, feature))
    return _block(1, entries)


def _kind(t: DataType) -> str:
    t = t.elementType if isinstance(t, ArrayType) else t
    kind = "int" if isinstance(t, _INTEGERS) else "float" if isinstance(t, _FLOATS) else "bytes" if isinstance(t, _BYTES) else None
    if kind is None:
        raise TypeError(f"an Example has no {t.simpleString()}")
    return kind


# ------------------------------------------------------------------ tables


def _column(f: StructField, examples: list[dict], name: str) -> list:
    kind, many = _kind(f.dataType), isinstance(f.dataType, ArrayType)
    of = f.dataType.elementType if many else f.dataType
    turn = bytes.decode if isinstance(of, StringType) else bool if isinstance(of, BooleanType) else None
    out = []
    for e in examples:
        got = e.get(f.name)
        if got is None:
            out.append(None)
            continue
        if got[0] != kind and got[1]:
            raise ValueError(f"{name}: feature {f.name!r} holds {got[0]}, not {kind}")
        values = list(map(turn, got[1])) if turn else got[1]
        if not many and len(values) > 1:
            raise ValueError(f"{name}: feature {f.name!r} has {len(values)} values, one was expected")
        out.append(values if many else values[0] if values else None)
    return out


def inferred(spark: SparkSession, path: str, records: int = 100) -> StructType:
    """Fields of the first records of one file that has some, as arrays."""
    kinds: dict[str, str] = {}
    for row in spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").limit(1).collect():
        for _, body in zip(range(records), records_of(bytes(row["content"]), row["path"])):
            for name, (kind, values) in parse(body).items():
                if kinds.setdefault(name, kind) != kind and values:
                    raise ValueError(f"{row['path']}: feature {name!r} is of more than one kind")
    of = {"bytes": BinaryType(), "float": FloatType(), "int": LongType()}
    return StructType([StructField(n, ArrayType(of[k])) for n, k in sorted(kinds.items())])


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Records of a file, a folder or a pattern, with ``__file`` and ``__row`` (its number in the file)."""
    wanted = inferred(spark, path) if schema is None else spark.createDataFrame([], schema).schema
    for f in wanted:
        _kind(f.dataType)
    full = StructType([*wanted.fields, StructField("__file", StringType()), StructField("__row", LongType())])
    arrow = spark.createDataFrame([], full).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                name, start, own = path.as_py(), 0, []

                def made() -> pa.RecordBatch:
                    columns = [pa.array(_column(f, own, name), arrow.field(f.name).type) for f in wanted]
                    places = [pa.array([name] * len(own), pa.string()), pa.array(range(start, start + len(own)), pa.int64())]
                    return pa.RecordBatch.from_arrays([*columns, *places], names=arrow.names)

                for body in records_of(memoryview(content.as_buffer()), name):
                    own.append(parse(body))
                    if len(own) == ROWS:
                        yield made()
                        start, own = start + ROWS, []
                if own:
                    yield made()

    content = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    # few files to a batch: their contents are whole
    return content.mapInArrow(run, full)


def from_tfrecords(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> Source:
    """The records as an indexed source, numbered in the order of files and records.

    Counts of the files, one small row each and written down, say where a file's numbers begin: records are neither sorted nor moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_pydict({"__f": [path.as_py()], "__n": [counted(memoryview(content.as_buffer()), path.as_py())]})

    content = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    counts = cut(content.mapInArrow(run, "__f string, __n long"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = read(spark, path, schema)
    named = df.join(F.broadcast(counts.select("__f", before.alias("__base"))), F.col("__file") == F.col("__f"))
    names = [c for c in df.columns if c not in ("__file", "__row")]
    return Source(named.select((F.col("__base") + F.col("__row")).alias(IDX), *[F.col(f"`{c}`") for c in names]), counts.agg(F.sum("__n")).first()[0] or 0, **options)


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class TFRecordWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool) -> None:
        self.folder, self.schema, self.overwrite, self.job = folder.rstrip("/"), schema, overwrite, uuid.uuid4().hex[:12]
        for f in schema:
            _kind(f.dataType)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        path = f"{self.folder}/part-{TaskContext.get().partitionId():06d}-{self.job}-{uuid.uuid4().hex[:8]}.tfrecord"

        def put(out) -> None:
            for b in iterator:
                columns = [(f.name, _kind(f.dataType), isinstance(f.dataType, ArrayType), b.column(i).to_pylist()) for i, f in enumerate(self.schema)]
                bodies, held = [], 0
                for r in range(b.num_rows):
                    row = {}
                    for name, kind, many, values in columns:
                        if (v := values[r]) is not None:
                            v = v if many else [v]
                            if any(x is None for x in v):
                                raise ValueError(f"a null inside {name!r}")
                            row[name] = (kind, [x.encode() if isinstance(x, str) else x for x in v])
                    bodies.append(message(row))
                    held += len(bodies[-1])
                    if held > SUMMED:
                        out.write(frames(bodies))
                        bodies, held = [], 0
                out.write(frames(bodies))

        files.put(path, put)
        return _Written(path)

    def commit(self, messages: list[_Written | None]) -> None:
        if self.overwrite:
            own = {m.path for m in messages if m is not None}
            files.removed([p for p in files.listed(self.folder, ".tfrecord") if p not in own])

    def abort(self, messages: list[_Written | None]) -> None:
        files.removed([m.path for m in messages if m is not None])


class TFRecordSink(DataSource):
    """``df.write.format("tfrecord_files").save(folder)``; reading is :func:`read`."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord_files"

    def writer(self, schema: StructType, overwrite: bool) -> TFRecordWriter:
        return TFRecordWriter(self.options["path"], schema, overwrite)


def saved(df: DataFrame, folder: str, mode: str = "overwrite") -> str:
    df.sparkSession.dataSource.register(TFRecordSink)
    df.write.format("tfrecord_files").mode(mode).save(folder)
    return folder
