"""Example records: checksum and messages against known bytes, round trips, damage."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.operators.base import IDX
from weirflow.sources import tfrecords as tf


def slow(data):
    value = 0xFFFFFFFF
    for b in data:
        value ^= b
        for _ in range(8):
            value = (value >> 1) ^ (0x82F63B78 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


@settings(deadline=None)
@given(st.binary(max_size=300))
def test_checksum(data):
    assert tf.crc32c(data) == slow(data)


def test_known_values():
    assert tf.crc32c(b"123456789") == 0xE3069283 and tf.crc32c(b"") == 0 and tf.crc32c(bytes(32)) == 0x8A9136AA
    # a message by hand: one feature "a" with the integers 1 and -1 (packed), one "b" with a byte string
    packed = b"\x01" + b"\xff" * 9 + b"\x01"
    entry = lambda k, f: b"\x0a" + bytes([len(k) + len(f) + 4]) + b"\x0a" + bytes([len(k)]) + k + b"\x12" + bytes([len(f)]) + f
    ints = b"\x1a" + bytes([len(packed) + 2]) + b"\x0a" + bytes([len(packed)]) + packed
    text = b"\x0a\x05\x0a\x03xyz"
    body = entry(b"a", ints) + entry(b"b", text)
    assert tf.parse(b"\x0a" + bytes([len(body)]) + body) == {"a": ("int", [1, -1]), "b": ("bytes", [b"xyz"])}
    assert tf.message({"a": ("int", [1, -1]), "b": ("bytes", [b"xyz"])}) == b"\x0a" + bytes([len(body)]) + body
    # unpacked numbers
    one = b"\x1a\x04\x08\x05\x08\x07"
    body = entry(b"a", one) + entry(b"f", b"\x12\x05\x0d" + struct.pack("<f", 1.5))
    assert tf.parse(b"\x0a" + bytes([len(body)]) + body) == {"a": ("int", [5, 7]), "f": ("float", [1.5])}


values = st.one_of(st.tuples(st.just("bytes"), st.lists(st.binary(max_size=9), max_size=4)), st.tuples(st.just("int"), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=4)), st.tuples(st.just("float"), st.lists(st.floats(width=32, allow_nan=False), max_size=4)))


@settings(deadline=None)
@given(st.dictionaries(st.text(max_size=5), values, max_size=5))
def test_messages_and_back(features):
    assert tf.parse(tf.message(features)) == features
    assert list(tf.records_of(tf.framed(tf.message(features)) * 2)) == [tf.message(features)] * 2


SCHEMA = "i long, b boolean, n int, f float, s string, raw binary, many array<long>, texts array<string>, reals array<float>"
ROWS = [(1, True, 5, 1.5, "é", b"\xff\x00", [1, -2], ["a", ""], [0.5]), (None,) * 9, (-(2**63), False, -1, -0.0, "", b"", [], [], []), (7, None, None, 2.25, "x" * 100_000, b"y", list(range(1000)), None, None)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    at = tf.saved(df, f"file://{tmp_path}/t")
    got = tf.read(spark, at, df.schema).drop("__file", "__row")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    s = tf.from_tfrecords(spark, at, "i long, s string", shuffle_seed=1)
    assert len(s) == 4 and sorted(r[IDX] for r in s.epoch().collect()) == [0, 1, 2, 3]
    tf.saved(df.limit(1), at, "append")
    assert tf.read(spark, at, "i long").count() == 5
    tf.saved(df.limit(0), at)
    assert tf.read(spark, at, "i long").count() == 0


def test_inferred(spark, tmp_path):
    at = tf.saved(spark.createDataFrame(ROWS[:1], SCHEMA).coalesce(1), str(tmp_path / "t"))
    got = tf.read(spark, at).drop("__file", "__row")
    assert dict(got.dtypes) == {"i": "array<bigint>", "b": "array<bigint>", "n": "array<bigint>", "f": "array<float>", "s": "array<binary>", "raw": "array<binary>", "many": "array<bigint>", "texts": "array<binary>", "reals": "array<float>"}
    assert got.first()["many"] == [1, -2] and bytes(got.first()["s"][0]).decode() == "é"


def test_errors(spark, tmp_path):
    at = tf.saved(spark.createDataFrame(ROWS[:1], SCHEMA).coalesce(1), str(tmp_path / "t"))
    with pytest.raises(Exception, match="holds int, not bytes"):
        tf.read(spark, at, "i string").collect()
    with pytest.raises(Exception, match="2 values"):
        tf.read(spark, at, "many long").collect()
    with pytest.raises(TypeError):
        tf.read(spark, at, "i map<string,long>")
    with pytest.raises(Exception, match="a null inside"):
        tf.saved(spark.createDataFrame([([1, None],)], "a array<long>"), str(tmp_path / "n"))
    with pytest.raises(Exception, match="no map"):
        tf.saved(spark.createDataFrame([({"a": 1},)], "a map<string,long>"), str(tmp_path / "n"))
    one = next((tmp_path / "t").iterdir()) if next((tmp_path / "t").iterdir()).suffix == ".tfrecord" else [p for p in (tmp_path / "t").iterdir() if p.suffix == ".tfrecord"][0]
    data = one.read_bytes()
    for place, text in ((3, "length"), (40, "damaged"), (None, "cut off")):
        bad = data[:-2] if place is None else data[:place] + bytes([data[place] ^ 1]) + data[place + 1 :]
        with pytest.raises(ValueError, match=text):
            list(tf.records_of(bad))
    (tmp_path / "t" / one.name).write_bytes(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    (tmp_path / "t" / f".{one.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged"):
        tf.read(spark, at, "i long").collect()


def test_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("words", F.split("text", " "))
    at = tf.saved(docs, str(tmp_path / "d"))
    assert sorted(map(repr, tf.read(spark, at, docs.schema).drop("__file", "__row").collect())) == sorted(map(repr, docs.collect()))


def test_numbered_where_they_are(spark, tmp_path):
    """Numbers follow files and records, by counts of the files; the records are neither sorted nor exchanged."""
    at = tf.saved(spark.range(0, 5000, 1, 3).selectExpr("id", "repeat('é', cast(id % 90 as int)) AS s"), str(tmp_path / "n"))
    source = tf.from_tfrecords(spark, at, "id long, s string")
    places = tf.read(spark, at, "id long, s string").orderBy("__file", "__row").collect()
    assert len(source) == 5000
    assert [(r["__idx"], r["id"], r["s"]) for r in source.df.orderBy("__idx").collect()] == [(i, r["id"], r["s"]) for i, r in enumerate(places)]
    plan = source.df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Scan ExistingRDD[id" not in plan and "BroadcastHashJoin" in plan


def test_checksums_together():
    items = [bytes(range(n % 256)) * (1 + n % 3) for n in range(0, 200, 3)] + [b"", b"a", b"abc", b"abcd"]
    assert tf.crc32cs(items) == [slow(x) for x in items] and tf.crc32cs([]) == [] and tf.counted(tf.frames(items)) == len(items)
    assert list(tf.records_of(memoryview(tf.frames(items)))) == items
