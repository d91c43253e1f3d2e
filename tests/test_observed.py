"""Counts from the run itself, on batches and streams; statistics with states of their own."""

import math

import pytest
from pyspark.sql import functions as F

from weirflow.operators import sketches
from weirflow.operators.base import IDX, Map
from weirflow.operators.compose import ConditionalSequential, Probabilistic, Sequential, When
from weirflow.plans.metrics import Collector
from weirflow.plans.observed import Recorder, observed


def chain():
    return Sequential((When(lambda f: f["x"] > 30, Map(lambda c: c * 2, ("x",))), Probabilistic(Map(lambda c: c + 1, ("x",)), 0.3), Map(lambda c: c - 1, ("x",))), seed=4)


def test_chain_of_a_batch(spark):
    df = spark.range(0, 1000, 1, 4).select(F.col("id").alias(IDX), F.when(F.col("id") % 10 != 0, F.col("id") % 97).alias("x"))
    told, c = [], Collector()
    r = Recorder(lambda name, m: told.append(name), c)
    out = observed(chain(), r, "prep")(df)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, chain()(df).collect()))
    got = r.results()
    hit = df.filter("x > 30").count()
    assert got["prep 0 When"] == {"rows": 1000, "applied": hit, "skipped": 1000 - hit}
    assert got["prep 2 Map"] == {"rows": 1000, "applied": 1000, "skipped": 0}
    first = Sequential(chain().children[:1], 4)(df).withColumnRenamed("x", "before")
    coin = Sequential(chain().children[:2], 4)(df).join(first, IDX).filter("x IS NOT NULL AND x <> before").count()
    nulls = df.filter("x IS NULL").count()
    assert coin <= got["prep 1 Probabilistic"]["applied"] <= coin + nulls and got["prep 1 Probabilistic"]["rows"] == 1000
    r.results()
    assert told == list(got) and len(c.metrics) == 9
    with pytest.raises(ValueError):
        r.watch(df, "prep 2 Map", n=F.count("*"))


def test_other_operators_and_own_metrics(spark):
    df = spark.range(50).select(F.col("id").alias(IDX), F.col("id").alias("x"))
    r = Recorder()
    op = ConditionalSequential((Map(lambda c: c * 0, ("x",)), Map(lambda c: c + 5, ("x",))), (lambda f: f["x"] < 10, lambda f: f["x"] == 0))
    out = r.watch(observed(op, r)(df), "end", total=F.sum("x"), most=F.max("x"))
    single = observed(Probabilistic(Map(lambda c: c, ("x",)), 1.0), r, "one")(out)
    single.write.format("noop").mode("overwrite").save()
    assert r.results() == {"0 When": {"rows": 50, "applied": 10, "skipped": 40}, "1 When": {"rows": 50, "applied": 10, "skipped": 40}, "end": {"total": sum(range(10, 50)) + 50, "most": 49}, "one 0 Probabilistic": {"rows": 50, "applied": 50, "skipped": 0}}


def test_stream(spark, tmp_path):
    import time

    for k in range(3):
        spark.range(k * 100, k * 100 + 100).selectExpr(f"id AS {IDX}", "id % 7 AS x").coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    s = spark.readStream.schema(f"{IDX} long, x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    r = Recorder()
    try:
        q = observed(When(lambda f: f["x"] > 3, Map(lambda c: c * 2, ("x",))), r)(s).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if r.results()["0 When"].get("rows") == 300:
                break
            time.sleep(0.1)
        assert r.results() == {"0 When": {"rows": 300, "applied": sum(i % 7 > 3 for i in range(300)), "skipped": sum(i % 7 <= 3 for i in range(300))}}
    finally:
        r.close()


# ------------------------------------------------------------------ statistics


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [(i % 3 if i % 11 else None, [math.sin(i), i / 100.0, float("nan") if i % 5 == 0 else 1.0] if i % 13 else None) for i in range(1, 400)]
    return rows, spark.createDataFrame(rows, "g long, v array<double>").repartition(7)


@pytest.mark.parametrize("fan", [64, 2])
def test_moments_and_histograms(arrays, fan):
    rows, df = arrays
    for by in ([], ["g"]):
        groups = {}
        for g, v in rows:
            groups.setdefault((g,) if by else (), []).append(v)
        moments, counts = {}, {}
        for key, own in groups.items():
            for p in range(3):
                x = [v[p] for v in own if v is not None and not math.isnan(v[p])]
                mean = sum(x) / len(x)
                moments[*key, p] = (len(x), mean, math.sqrt(sum((y - mean) ** 2 for y in x) / len(x)))
                for y in x:
                    k = (*key, p, min(7, max(0, math.floor((y + 1) / 3 * 8))))
                    counts[k] = counts.get(k, 0) + 1
        got = {tuple(r[:-3]): tuple(r[-3:]) for r in sketches.summarize(df, sketches.Moments("v"), by, fan).collect()}
        assert set(got) == set(moments) and all(got[k][0] == moments[k][0] and got[k][1:] == pytest.approx(moments[k][1:]) for k in got)
        assert {tuple(r[:-1]): r[-1] for r in sketches.summarize(df, sketches.Histogram("v", -1.0, 2.0, 8), by, fan).collect()} == counts


def test_quantiles(spark):
    df = spark.range(0, 1000, 1, 5).select(F.array(F.col("id") / 1000.0, F.lit(0.5)).alias("v"))
    got = {(r[0], r[1]): r[2] for r in sketches.summarize(df, sketches.Quantiles("v", 0.0, 1.0, 100, (0.0, 0.1, 0.5, 1.0))).collect()}
    assert got == pytest.approx({(0, 0.0): 0.01, (0, 0.1): 0.1, (0, 0.5): 0.5, (0, 1.0): 1.0, (1, 0.0): 0.51, (1, 0.1): 0.51, (1, 0.5): 0.51, (1, 1.0): 0.51})


def test_empty_and_uneven(spark):
    none = spark.createDataFrame([], "g long, v array<double>")
    assert sketches.summarize(none, sketches.Moments("v"), ["g"]).count() == 0 and sketches.summarize(none, sketches.Histogram("v", 0, 1)).count() == 0
    with pytest.raises(Exception, match="entries"):
        sketches.summarize(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1), sketches.Moments("v")).collect()


def test_rows_do_not_meet(arrays):
    """Only states are shuffled: what reaches the exchange is one row a group and task."""
    df = sketches.summarize(arrays[1], sketches.Moments("v"), ["g"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow") and "__state" in plan


def test_floats_next_to_an_edge(spark):
    """Bins of single floats as SQL computes them, which a sum in doubles puts one lower; doubles stay doubles."""
    import duckdb

    x = [0.06249998137354851, -1.3969838619232178e-08, -0.0625000149011612, 0.3]
    con = duckdb.connect()
    for kind in ("float", "double"):
        got = spark.createDataFrame([(x,)], f"v array<{kind}>")
        want = [con.execute(f"SELECT CAST(floor((CAST(? AS {kind}) + CAST(0.5 AS {kind})) * 16) AS INTEGER)", [e]).fetchone()[0] for e in x]
        assert [r["bin"] for r in sketches.summarize(got, sketches.Histogram("v", -0.5, 0.5, 16)).orderBy("place").collect()] == want
    assert want[:3] == [8, 7, 6]
