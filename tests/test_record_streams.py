"""Streams of records and replay buffers: restarts, micro-batches of any size, hot groups."""

import pytest
from pyspark.sql import functions as F

from weirflow.operators import sampling
from weirflow.operators.base import IDX
from weirflow.sources import records
from weirflow.streaming import replay, twin


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    df = spark.range(0, 500, 1, 3).select(F.col("id").alias(IDX), (F.col("id") * 2).alias("v"), (F.col("id") % 3).alias("g"))
    return records.saved(df, str(tmp_path_factory.mktemp("rec") / "set"), chunk=32)


def all_rows(df):
    return sorted(map(repr, df.collect()))


def run(stream, at, batches=None):
    """Micro-batches to files until nothing is left, or until one fails on purpose."""
    spark, seen = stream.sparkSession, []

    def put(df, k):
        seen.append(k)
        df.withColumn("__batch", F.lit(k)).write.mode("append").parquet(f"{at}/out/{k}")
        if batches is not None and len(seen) > batches:
            raise RuntimeError("stopped")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").start()
    try:
        q.processAllAvailable()
    except Exception:
        assert batches is not None
    finally:
        q.stop()
    return seen


def out(spark, at):
    # a batch that was run twice wrote the same rows twice
    return spark.read.parquet(f"{at}/out/*").dropDuplicates()


def test_order_and_epochs(spark, folder, tmp_path):
    s = records.stream(spark, folder, buffer=64, seed=5, epochs=2, rows=100)
    got = twin.drained(s, str(tmp_path / "a")).orderBy("__pos").collect()
    assert [r["__pos"] for r in got] == list(range(1000)) and all(r["v"] == 2 * r[IDX] for r in got)
    for e in (0, 1):
        for b in range(0, 500, 64):
            block = [r[IDX] for r in got[e * 500 + b : e * 500 + min(b + 64, 500)]]
            assert sorted(block) == list(range(b, min(b + 64, 500))) and (len(block) < 5 or block != sorted(block))
    assert [r[IDX] for r in got[:64]] != [r[IDX] for r in got[500:564]]
    plain = twin.drained(records.stream(spark, folder), str(tmp_path / "b")).orderBy("__pos").collect()
    assert [r[IDX] for r in plain] == list(range(500))


def test_stopped_in_the_middle(spark, folder, tmp_path):
    whole = twin.drained(records.stream(spark, folder, buffer=50, seed=2, epochs=2), str(tmp_path / "whole"))
    at = str(tmp_path / "parts")
    make = lambda: records.stream(spark, folder, buffer=50, seed=2, epochs=2, ahead=130, progress=f"{at}/progress")
    first = run(make(), at, batches=3)
    second = run(make(), at)
    assert len(first) == 4 and second[0] in (3, 4) and len({*first, *second}) == 8
    got = out(spark, at)
    assert all_rows(got.drop("__batch").dropDuplicates()) == all_rows(whole) and got.groupBy("__batch").count().agg(F.max("count")).first()[0] <= 130


def test_options(spark, folder):
    for options in ({"ahead": 5}, {"epochs": 0}, {"buffer": 0}):
        with pytest.raises(ValueError):
            records.RecordStreamReader({"path": folder} | options, None)
    r = records.RecordStreamReader({"path": folder, "epochs": 0, "ahead": 700, "progress": folder + "-p"}, None)
    assert r.latestOffset() == {"position": 700} and [(p.epoch, p.start, p.end) for p in r.partitions({"position": 400}, {"position": 700})] == [(0, 400, 500), (1, 0, 200)]
    assert r.latestOffset() == {"position": 1400}


@pytest.mark.parametrize(("read", "seed"), [("in_turn", None), ("at_random", 4)])
@pytest.mark.parametrize("ahead", [0, 70])
def test_replay_equals_reads_of_a_table(spark, folder, tmp_path, read, seed, ahead):
    df = spark.range(500).select(F.col("id").alias(IDX))
    want = sampling.FifoBuffer(32, prefill=16).reads(df, 3, seed).collect()
    at = str(tmp_path / "r")
    s = records.stream(spark, folder, ahead=ahead, progress=f"{at}/progress" if ahead else None).select(IDX, "v", "g")
    got = replay.replayed(s, replay.Replay(32, 16, 3, read=read, seed=seed or 0), splits=4)
    run(got, at)
    rows = out(spark, at).collect()
    assert sorted((r["__t"], r["__k"], r[IDX]) for r in rows) == sorted((r["__t"], r["__k"], r[IDX]) for r in want)
    assert all(r["v"] == 2 * r[IDX] and r["g"] == r[IDX] % 3 for r in rows)


def test_reservoir_by_groups_and_restart(spark, folder, tmp_path):
    """Groups with an order of their own; what a stopped query leaves is taken up again."""
    make = lambda at: replay.replayed(records.stream(spark, folder, ahead=60, progress=f"{at}/progress").select(F.floor(F.col(IDX) / 3).alias(IDX), "v", "g"), replay.Replay(8, 4, 2, "reservoir", "at_random", 3), by=["g"], splits=3)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    run(make(one), one)
    run(make(two), two, batches=2)
    run(make(two), two)
    a, b = out(spark, one), out(spark, two)
    assert all_rows(a.drop("__batch").dropDuplicates()) == all_rows(b.drop("__batch").dropDuplicates())
    slots = spark.range(167).select("id", sampling.reservoir_slot(F.col("id"), 8, 3).alias("s")).collect()
    held = {}
    states = {}
    for r in slots:
        if r["s"] is not None:
            held[r["s"]] = r["id"]
        states[r["id"]] = set(held.values())
    rows = a.collect()
    assert all(r[IDX] in states[r["__t"]] for r in rows if r["__t"] >= 4) and all(r["v"] // 2 % 3 == r["g"] for r in rows)
    assert len({(r["g"], r["__t"], r["__k"]) for r in rows}) == len(rows) == 500 + 500 - 12


def test_late_rows_are_refused(spark, tmp_path):
    for k, ids in enumerate(([0, 1, 2], [3, 4], [1, 5])):
        spark.createDataFrame([(i, i) for i in ids], f"{IDX} long, v long").coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    s = spark.readStream.schema(f"{IDX} long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = replay.replayed(s, replay.Replay(4, 2, 1), splits=1).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    with pytest.raises(Exception, match="comes after row"):
        q.processAllAvailable()
    q.stop()
    for bad in ({"prefill": 5}, {"size": 3, "prefill": 2}, {"write": "x"}, {"prefill": 0}):
        with pytest.raises(ValueError):
            replay.Replay(**({"capacity": 4} | bad))
