"""Batches fetched ahead: order, bound, errors, early close; batches by position that read what they need."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from weirflow.functions import keyed
from weirflow.operators.base import IDX, Map
from weirflow.plans.pipeline import Pipeline
from weirflow.plans.prefetch import Prefetcher
from weirflow.sources import indexed
from weirflow.sources.indexed import Source, from_path


def test_order_and_last_batch(spark):
    s = Source(spark.range(103).select(F.col("id").alias(IDX), F.col("id").alias("x")), 103, shuffle_seed=3)
    p = Pipeline(s, [Map(lambda c: c * 2, ("x",))], 8)
    want = [r["x"] for r in p.rows().orderBy("__pos").collect()]
    for ahead, per_job in ((1, 1), (3, 4), (2, 100)):
        got = list(p.local_batches(ahead, per_job))
        assert [len(b) for b in got] == [8] * 12 + [7] and [r["x"] for b in got for r in b] == want
    assert [r["x"] for b in p.advanced(5).local_batches() for r in b] == want[40:]
    assert [len(b) for b in Pipeline(s, [], 8, last="drop").local_batches()] == [8] * 12


def test_slow_consumer_holds_few_ranges():
    running, most = [0], [0]
    lock = threading.Lock()

    def fetch(a, b):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.005)
        with lock:
            running[0] -= 1
        return list(range(a, b))

    p = Prefetcher(fetch, 0, 1000, 10, ahead=3, per_job=2)
    for k, b in enumerate(p):
        assert b == list(range(k * 10, k * 10 + 10))
        time.sleep(0.002)
        assert p.started * 20 - (k + 1) * 10 <= 20 * (3 + 1)
    assert most[0] > 1 and k == 99


def test_error_comes_after_what_precedes_it_and_ends_it():
    def fetch(a, b):
        if a >= 40:
            raise RuntimeError(f"at {a}")
        return list(range(a, b))

    p, got = Prefetcher(fetch, 0, 1000, 10, per_job=2), []
    with pytest.raises(RuntimeError, match="at 40"):
        for b in p:
            got += b
    assert got == list(range(40)) and list(p) == []


def test_spark_error_is_forwarded(spark):
    s = Source(spark.range(100).select(F.col("id").alias(IDX)), 100)
    bad = F.when(F.col(IDX) == 50, F.raise_error(F.lit("broken row"))).otherwise(F.lit(1))
    with pytest.raises(Exception, match="broken row"):
        list(Pipeline(s, [lambda d: d.withColumn("x", bad)], 10).local_batches())


def test_early_close():
    done = []
    with Prefetcher(lambda a, b: done.append(a) or list(range(a, b)), 0, 10_000, 10, ahead=2, per_job=1) as p:
        assert next(p) == list(range(10))
    assert len(done) <= 4 and list(p) == []
    p.close()


# ------------------------------------------------------------------ batches by position


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_inverse_permutation(spark, n):
    for exact in (False, True):
        df = spark.range(n).select("id", keyed.permuted(F.col("id"), n, 11, exact=exact).alias("p"))
        assert df.filter(keyed.unpermuted(F.col("p"), n, 11, exact=exact) != F.col("id")).count() == 0


def test_batches_of_any_kind(spark, monkeypatch):
    df = spark.range(50).select(F.col("id").alias(IDX))
    for seed in (None, 4):
        s = Source(df, 50, shuffle_seed=seed)
        order = {e: [r[IDX] for r in s.epoch(e).orderBy("__pos").collect()] for e in (0, 2)}
        for listed in (4096, 3):
            monkeypatch.setattr(indexed, "LISTED", listed)
            for start, size, e in ((0, 5, 0), (45, 10, 0), (49, 50, 2), (7, 120, 0), (1049, 3, 2)):
                got = [(r["__slot"], r[IDX]) for r in s.batch_at(start, size, e).orderBy("__slot").collect()]
                assert got == [(k, order[e][(start + k) % 50]) for k in range(size)]
        many = spark.range(3, 9).select(F.col("id").alias("__pos"))
        assert sorted((r["__pos"], r[IDX]) for r in s.positions(many, 2).collect()) == [(p, order[2][p]) for p in range(3, 9)]
    with pytest.raises(ValueError):
        Source(df, 50).batch_at(0, 0)


def read_rows(df):
    """Rows that left the scans of a DataFrame that has been run."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_shuffled_batch_reads_what_holds_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0, 200_000, 1, 40).select("id", (F.col("id") * 2).alias("v"))
    rows.write.option("parquet.block.size", 16_384).option("parquet.page.row.count.limit", 500).parquet(path)
    s = from_path(spark, path, dense="id").shuffled(5)
    b = s.batch_at(1000, 16)
    got = b.collect()
    assert len(got) == 16 and all(r["v"] == 2 * r[IDX] for r in got)
    assert "PushedFilters: [Or(" in b._jdf.queryExecution().toString().replace("PushedFilters: [Or(Or(", "PushedFilters: [Or(")
    assert read_rows(b) <= 16 * 1000, "whole groups of rows that hold none of the batch were read"
    plain = s.shuffled(None).batch_at(199_990, 20)
    assert len(plain.collect()) == 20 and read_rows(plain) <= 20_000


def test_dense_is_verified(spark, tmp_path):
    for k, ids in enumerate(([0, 1, 3], [0, 1, 1], [1, 2, 3], [0, None, 2], [-1, 0, 1])):
        path = str(tmp_path / str(k))
        spark.createDataFrame([(i,) for i in ids], "id long").write.parquet(path)
        with pytest.raises(ValueError, match="no dense index"):
            from_path(spark, path, dense="id")
    spark.range(0, 70_000, 1, 3).write.parquet(str(tmp_path / "good"))
    assert len(from_path(spark, str(tmp_path / "good"), dense="id")) == 70_000


def test_scan_and_fold_of_a_pipeline(spark):
    import pyarrow as pa

    from weirflow.operators import scan

    s = Source(spark.range(0, 100, 1, 4).select(F.col("id").alias(IDX), F.col("id").cast("double").alias("x")), 100, shuffle_seed=3)
    p = Pipeline(s, [Map(lambda c: c + 1, ("x",))], 8)
    order = [r["x"] for r in p.rows().orderBy("__pos").collect()]
    batches = [order[k : k + 8] for k in range(0, 100, 8)]
    carry, rows = p.scan(lambda c, b: (c * 0.5 + sum(b["x"].to_pylist()), pa.table({"n": [len(b)], "carry": [c]})), 1.0, "n int, carry double", per_range=32)
    want, c = [], 1.0
    for b in batches:
        want.append((len(b), c))
        c = c * 0.5 + sum(b)
    assert carry == c and sorted(map(tuple, rows.collect())) == sorted(want)
    assert p.fold(lambda c, rows: c + [rows[0]["x"]], []) == [b[0] for b in batches]
    run = {r["__pos"]: r["total"] for r in p.prefix({"total": scan.running_sum("x")}).collect()}
    assert all(run[k] == sum(order[: k + 1]) for k in range(100))
