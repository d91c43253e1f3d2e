"""Record files: round trips, chunks read, shuffled epochs, damage."""

import pytest
from pyspark.sql import functions as F

from weirflow.operators.base import IDX
from weirflow.plans.pipeline import Pipeline
from weirflow.sources import files, records


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(0, 1000, 1, 5).select(F.col("id").alias(IDX), (F.col("id") * 3).alias("v"), F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("n"), "id")).alias("s"))
    return df.withColumn("nested", F.struct(F.array("v").alias("a"), F.create_map(F.lit("k"), F.col("v")).alias("m")))


@pytest.fixture(scope="module")
def folder(table, tmp_path_factory):
    return records.saved(table, f"file://{tmp_path_factory.mktemp('rec')}/set", chunk=32)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_round_trip(spark, table, folder):
    s = records.from_records(spark, folder)
    assert len(s) == 1000 and s.df.columns == table.columns and rows(s.df) == rows(table)
    assert rows(records.from_records(spark, folder, include=("v",)).epoch().drop("__pos")) == rows(table.select(IDX, "v"))


CONDITIONS = ["__idx = 77", "__idx IN (3, 500, 999, 5000)", "__idx BETWEEN 40 AND 71", "__idx > 990 AND v < 2985", "__idx = 5 OR __idx = 900", "__idx < 0", "__idx >= 300 AND __idx IN (" + ", ".join(map(str, range(0, 1000, 50))) + ")", "__idx IS NULL", "s IS NULL AND __idx <= 40"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_conditions(spark, table, folder, condition):
    assert rows(records.from_records(spark, folder).df.filter(condition)) == rows(table.filter(condition))


def test_conditions_one_after_the_other(spark, table, folder):
    """A filtered query leaves nothing behind for the next one on the same frame."""
    df = records.from_records(spark, folder).df
    for condition in CONDITIONS[:4]:
        df.filter(condition).count()
        assert df.count() == 1000


def chunks(folder, **wanted):
    r = records.RecordReader(folder, records.RecordSource({"path": folder}).schema(), 64, **wanted)
    return sum(len(p.chunks) for p in r.partitions()), sum(b.num_rows for p in r.partitions() for b in r.read(p))


def test_only_wanted_chunks_are_read(spark, table, folder):
    whole, n = chunks(folder)
    assert n == 1000 and whole >= 32
    assert chunks(folder, wanted=[500]) == (1, 1) and chunks(folder, wanted=[1, 2, 999, 999]) == (2, 3)
    used, n = chunks(folder, low=100, high=109)
    assert used <= 2 and n == 10 and chunks(folder, wanted=[4000]) == (0, 0) and chunks(folder, wanted=[]) == (0, 0)
    assert chunks(folder, wanted=[99, 100, 105, 110], low=100, high=109)[1] == 2
    assert rows(records.read(spark, folder, [7, 3, 999, 5000])) == rows(table.filter("__idx IN (3, 7, 999)"))
    assert rows(records.read(spark, folder, range(30, 70))) == rows(table.filter("__idx BETWEEN 30 AND 69"))


def test_batches_read_their_chunks(spark, table, folder):
    for seed in (3, None):
        s = records.from_records(spark, folder, shuffle_seed=seed)
        for start, size in ((10, 20), (990, 30)):
            b = s.batch_at(start, size)
            assert sorted(r["__slot"] for r in b.collect()) == list(range(size))
            leaves = b._jdf.queryExecution().executedPlan().collectLeaves()
            assert sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size())) == size


def test_epochs_cursors_and_batches(spark, table, folder):
    s = records.from_records(spark, folder, shuffle_seed=3)
    order = [[r["v"] for r in s.epoch(e).orderBy("__pos").collect()] for e in (0, 1)]
    assert order[0] != order[1] and sorted(order[0]) == sorted(order[1])
    p = Pipeline(s, [], 64)
    assert [r["v"] for b in p.advanced(3).local_batches() for r in b] == order[0][192:]
    assert [r["v"] for r in p.advanced(16).rows().orderBy("__pos").collect()] == order[1]


def test_modes_and_empty(spark, table, tmp_path):
    at = str(tmp_path / "d")
    records.saved(table.limit(0), at)
    s = records.from_records(spark, at)
    assert len(s) == 0 and s.df.count() == 0 and s.df.columns == table.columns
    records.saved(table.filter(F.col(IDX) < 10), at)
    records.saved(table.filter(F.col(IDX) < 5), at, mode="append")
    assert [r["v"] for r in records.from_records(spark, at).df.orderBy(IDX).collect()] == [*range(0, 30, 3), *range(0, 15, 3)]
    with pytest.raises(FileNotFoundError):
        records.from_records(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.opened("nostore://x/y")


def test_damage_is_an_error(spark, table, tmp_path):
    at = records.saved(table, str(tmp_path / "d"), chunk=16)
    one = next(p for p in (tmp_path / "d").iterdir() if p.suffix == ".rec")
    assert len(records.read_footer(str(one))) > 1
    data = bytearray(one.read_bytes())
    data[len(data) // 3] ^= 1
    one.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        records.from_records(spark, at).df.collect()
    one.write_bytes(data[:-3])
    with pytest.raises(ValueError, match="cut off"):
        records.read_footer(str(one))


def test_left_behind_files_do_not_count(spark, table, tmp_path):
    at = records.saved(table, str(tmp_path / "d"))
    (tmp_path / "d" / "part-000000-other-0.rec").write_bytes(b"rest of a failed task")
    assert records.from_records(spark, at).df.count() == 1000
