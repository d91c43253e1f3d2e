"""Running carries against plain loops."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.operators import scan
from weirflow.operators.base import IDX


def rows(n, seed=1, gaps=False):
    r = random.Random(seed)
    at = sorted(r.sample(range(n * 40), n)) if gaps else list(range(n))
    return [(i, r.choice([None, r.uniform(-5, 5)]), r.randrange(9), {"k": i}) for i in at]


def loop(data):
    total = top = known = None
    ema, count, out = 0.0, 0, {}
    for i, x, k, _ in data:
        if x is not None:
            total = x if total is None else total + x
            top = x if top is None else max(top, x)
            known = x
            count += 1
        ema = 0.9 * ema + 0.1 * k
        out[i] = (total, top, known, count, ema)
    return out


@pytest.mark.parametrize(("n", "block", "gaps"), [(1, 4, False), (3, 4, True), (60, 4, False), (90, 8, True), (50, 1024, False)])
def test_prefix(spark, n, block, gaps):
    data = rows(n, n, gaps)
    df = spark.createDataFrame(data, f"{IDX} long, x double, k int, m map<string,long>").repartition(3, "k")
    native = scan.prefix(df, {"total": scan.running_sum("x"), "top": scan.running_max("x"), "count": scan.running_count("x")}, block=block)
    other = scan.prefix(df, {"known": scan.last_known("x"), "ema": scan.recurrence(lambda: F.lit(0.9), lambda: F.col("k") * 0.1)}, block=block)
    assert set(native.columns) == {*df.columns, "total", "top", "count"} and set(other.columns) == {*df.columns, "known", "ema"}
    want = loop(data)
    a, b = {r[IDX]: r for r in native.collect()}, {r[IDX]: r for r in other.collect()}
    assert set(a) == set(b) == set(want)
    for i, (total, top, known, count, ema) in want.items():
        assert a[i]["total"] == pytest.approx(total) and a[i]["top"] == top and a[i]["count"] == count and a[i]["m"] == {"k": i}
        assert b[i]["known"] == known and b[i]["ema"]["shift"] == pytest.approx(ema)


def test_prefix_of_nothing(spark):
    df = spark.createDataFrame([], f"{IDX} long, x double")
    assert scan.prefix(df, {"s": scan.running_sum("x")}).count() == 0 and scan.prefix(df, {"s": scan.last_known("x")}).columns == [IDX, "x", "s"]
    with pytest.raises(ValueError):
        scan.prefix(df, {"s": scan.running_sum("x")}, block=1)


def test_carried_in_order(spark):
    """A step that is not associative; ranges smaller and larger than the data, batches over partitions."""

    def step(carry, batch):
        seen = batch.column(IDX).to_pylist()
        value = (carry["value"] * 31 + sum(seen)) % 1009
        return {"value": value, "batches": carry["batches"] + 1}, pa.table({"first": [seen[0]], "n": [len(seen)], "value": [value]})

    df = spark.range(0, 103, 1, 5).select(F.col("id").alias(IDX))
    want, value = [], 7
    for low in range(0, 103, 10):
        ids = list(range(low, min(103, low + 10)))
        value = (value * 31 + sum(ids)) % 1009
        want.append((low, len(ids), value))
    for per_range in (10, 35, 1000):
        carry, out = scan.carried(df, step, {"value": 7, "batches": 0}, "first long, n long, value long", 10, per_range=per_range)
        assert carry == {"value": value, "batches": 11} and sorted(map(tuple, out.collect())) == want
    carry, out = scan.carried(df.limit(0), step, "start", "first long, n long, value long", 10)
    assert carry == "start" and out.count() == 0
    carry, out = scan.carried(df, lambda c, b: (c + len(b), None), 0, "n long", 8)
    assert carry == 103 and out.count() == 0


def test_no_rows_on_the_driver(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.col("id").alias(IDX), F.col("id").cast("double").alias("x"))
    plan = scan.prefix(df, {"s": scan.running_sum("x")}, block=64)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window [sum")[0] and scan.prefix(df, {"s": scan.running_sum("x")}, block=64).agg(F.max("s")).first()[0] == 19_999 * 10_000
