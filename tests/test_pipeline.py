"""Pipelines, cursors, checkpoints, configuration, metrics, streams."""

import io
import json

import pytest
from pyspark.sql import functions as F

from weirflow import cli
from weirflow.operators.base import IDX, Map
from weirflow.plans import components, config
from weirflow.plans.checkpoints import CheckpointMismatchError, Checkpoints
from weirflow.plans.metrics import Collector, Metric, Reporter, summary
from weirflow.plans.pipeline import Cursor, Pipeline, order_of
from weirflow.sources.indexed import Source
from weirflow.streaming import twin


@pytest.fixture(scope="module")
def source(spark):
    return Source(spark.range(100).select(F.col("id").alias(IDX), F.col("id").cast("double").alias("x")), 100, shuffle_seed=3)


def ids(df):
    return [r[IDX] for r in df.orderBy("__pos").collect()]


def test_resume_gives_the_rest(source):
    p = Pipeline(source, [Map(lambda c: c * 2, ("x",))], 8)
    whole = ids(p.rows().select(IDX, "__pos"))
    assert ids(p.advanced(3).rows().select(IDX, "__pos")) == whole[24:]
    assert ids(p.resumed(Cursor.from_json(Cursor(50).to_json())).rows()) == whole[50:]
    assert p.advanced(13).cursor == Cursor(0, 1)
    assert [len(b) for b in p.local_batches()] == [8] * 12 + [4]
    assert sum(1 for _ in p.advanced(11)) == 2
    assert p.fold(lambda n, rows: n + len(rows), 0) == 100
    with pytest.raises(ValueError):
        p.resumed(Cursor(101))


def test_graph_order():
    assert order_of({"b": ["a"], "a": ["source"]}, {"a", "b"}, "b") == ["a", "b"]
    for edges, nodes in (({"a": ["b"], "b": ["a"]}, {"a", "b"}), ({"a": ["source"]}, {"a", "b"}), ({"a": ["source"], "b": ["source"]}, {"a", "b"}), ({"a": ["x"]}, {"a"})):
        with pytest.raises(ValueError):
            order_of(edges, nodes, "a")


def test_checkpoints(spark, source, tmp_path):
    p = Pipeline(source, [], 8)
    c = Checkpoints(spark, f"file://{tmp_path}", keep=2)
    for s in range(5):
        c.save_every(s, 2, p.advanced(s))
    assert c.steps() == [2, 4] and c.restore(p).cursor.position == 32 and c.restore(p, 2).cursor.position == 16
    with pytest.raises(CheckpointMismatchError):
        c.restore(Pipeline(source, [], 9))
    with pytest.raises(FileNotFoundError):
        Checkpoints(spark, str(tmp_path / "none")).restore(p)
    with pytest.raises(FileNotFoundError):
        c.restore(p, 3)
    assert c.save_async(9, p.advanced(2)).result().endswith("ckpt-9.json") and c.steps() == [4, 9] and c.restore(p).cursor.position == 16


def test_configuration(spark, tmp_path, capsys):
    spark.range(50).selectExpr("id", "id * 2.0 AS x").write.parquet(str(tmp_path / "t"))
    (tmp_path / "base.toml").write_text("batch_size = 4\nseed = 1\n")
    (tmp_path / "c.toml").write_text(f'include = "base.toml"\nbatch_size = 8\n[source]\ntype = "file"\npath = "{tmp_path}/t"\ndense = "id"\n[[stages]]\ntype = "sql"\nx = "x + 1"\n[[stages]]\ntype = "where"\ncondition = "x > 11"\n')
    c = config.from_environment(config.load(tmp_path / "c.toml"), "W", {"W_BATCH_SIZE": "16", "W_SOURCE__DENSE": "id", "X": "1"})
    assert c["batch_size"] == 16 and c["seed"] == 1
    assert components.build(spark, c).rows().count() == 44
    (tmp_path / "a.toml").write_text('include = "b.toml"')
    (tmp_path / "b.toml").write_text('include = "a.toml"')
    with pytest.raises(RecursionError):
        config.load(tmp_path / "a.toml")
    with pytest.raises(ValueError, match="unknown: y; missing: source; batch_size"):
        config.PIPELINE.validate({"y": 1, "batch_size": "x"})
    assert [config.scalar(x) for x in ("true", "3", "2.5", "a")] == [True, 3, 2.5, "a"]
    with pytest.raises(KeyError):
        config.REGISTRY.get("operator.none")
    with pytest.raises(ValueError):
        config.REGISTRY.register("operator", "sql")(print)
    assert cli.main(["validate", str(tmp_path / "c.toml")]) == 0 and cli.main(["version"]) == 0 and cli.main(["list", "source"]) == 0
    assert cli.main(["create", str(tmp_path / "new.toml")]) == 0 and cli.main(["create", str(tmp_path / "new.toml")]) == 1
    assert cli.main(["validate", str(tmp_path / "none.toml")]) == 1
    assert cli.main(["benchmark", str(tmp_path / "c.toml")]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["rows"] == 50


def test_metrics():
    now = iter(range(100))
    c = Collector(clock=lambda: next(now))
    out = io.StringIO()
    c.observers.append(Reporter(c, every=2, to=out))
    for v in (1.0, 3.0, 5.0):
        c.record("reader", "rows", v)
    s = summary(c.metrics)["reader.rows"]
    assert (s["avg"], s["min"], s["max"], s["sum"], s["count"], s["rate"]) == (3.0, 1.0, 5.0, 9.0, 3, 1.5)
    assert summary([Metric("a", "b", 1, 0)])["a.b"]["rate"] is None and out.getvalue().count("\n") == 2
    with c.timed("a", "b"):
        pass
    assert c.metrics[-1].name == "b"


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.range(k * 100, (k + 1) * 100).selectExpr("id", "id % 3 AS g", "timestamp_seconds(id * 30) AS ts", "id * 1.0 AS x").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    read = lambda n: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", n).parquet(str(tmp_path / "in"))
    op = Map(lambda c: c * 2, ("x",))
    got = twin.run_once(twin.apply(read(1), op, index="id"), "s1", str(tmp_path / "c1"))
    want = twin.apply(batch, op, index="id")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    rolled = twin.run_once(twin.windowed_roll_up(read(3), "ts", "x", ["g"], "10 minutes", "0 seconds"), "s2", str(tmp_path / "c2"), "append")
    assert rolled.count() > 0 and rolled.agg(F.max("n")).first()[0] <= 7
    samples = []
    for n in (1, 3):
        t = twin.run_once(twin.reservoirs(read(n), "id", "g", 5, seed=2), f"s3{n}", str(tmp_path / f"c3{n}"), "update")
        last = {}
        for r in t.collect():  # the memory table has each update; the last five of a group are its sample
            last.setdefault(r["group"], []).append(r["idx"])
        samples.append({g: set(v[-5:]) for g, v in last.items()})
    assert samples[0] == samples[1] and all(len(v) == 5 for v in samples[0].values())
    twin.write(read(3), str(tmp_path / "out"), str(tmp_path / "c4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
