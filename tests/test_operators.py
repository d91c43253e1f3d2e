"""Invariances, closed forms and argument checks of the library's operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.functions import arrays, audio, image, keyed, specs
from weirflow.operators import augment, batching, sampling
from weirflow.operators.base import IDX, ElementFn, KeyFilter, Map, PandasFn, Remap
from weirflow.operators.compose import Branching, ConditionalParallel, Parallel, Probabilistic, Selector, Sequential, WeightedParallel
from weirflow.sources import arrays as npy
from weirflow.sources import exports
from weirflow.plans import caching
from weirflow.sources import metadata, mixture
from weirflow.sources.indexed import Source, as_dataframe, from_memory, from_path, require_local, with_index


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(500).select(F.col("id").alias(IDX), (F.col("id") * 1.5).alias("x"))


def values(df, c="x"):
    return [r[c] for r in df.orderBy(IDX).collect()]


@pytest.mark.parametrize("op", [Probabilistic(Map(lambda c: c * 2, ("x",)), 0.5, seed=3), Selector((Map(lambda c: c + 1, ("x",)), Map(lambda c: -c, ("x",))), seed=3)])
def test_draws_do_not_depend_on_partitions(numbers, op):
    want = values(op(numbers))
    for n in (1, 7):
        assert values(op(numbers.repartition(n))) == want
    assert values(op(numbers.filter(f"{IDX} >= 250"))) == want[250:]


def test_seeds_and_paths_give_other_draws(numbers):
    one, two = (Probabilistic(Map(lambda c: c * 0 + 1, ("x",)), 0.5, seed=s) for s in (1, 2))
    assert values(one(numbers)) != values(two(numbers))
    a = Sequential((ElementFn(lambda f, d: {"u": d("a")}), ElementFn(lambda f, d: {"v": d("a")})))(numbers).collect()
    assert all(r["u"] != r["v"] for r in a)


def test_uniforms_are_uniform(numbers):
    for draw in (keyed.uniform, keyed.fast_uniform):
        u = np.array(values(numbers.select(IDX, draw(F.col(IDX), "t", 5).alias("x"))))
        assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.06 and abs(u.var() - 1 / 12) < 0.02


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 100, 257, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(keyed.permuted(F.col("id"), n, 9)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert got != sorted(got)
        assert got != [r[0] for r in spark.range(n).select(keyed.permuted(F.col("id"), n, 10)).collect()]


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(1, 7), st.booleans())
def test_sliding_windows(spark, n, window, stride, drop):
    w = sampling.SlidingWindow(window, stride, drop)
    rows = w.indices(spark, n).collect()
    want = {(k, o, min(k * stride + o, n - 1)) for k in range(w.count(n)) for o in range(window)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    over = w.over(spark.range(n).select(F.col("id").alias(IDX)), n).select("__window", "__offset", IDX).collect()
    assert {tuple(r) for r in over} == want and len(over) == len(want)


def test_samplers_check_arguments(spark):
    assert sampling.range_length(0, 10, 3) == 4 and sampling.range_length(0, 10, 3, truncate=True) == 3
    with pytest.raises(ValueError):
        sampling.range_length(0, 10, 0)
    with pytest.raises(ValueError):
        sampling.SlidingWindow(0)
    with pytest.raises(ValueError):
        sampling.sequential(spark, 0)


def test_reservoir_is_uniform(numbers):
    held = sampling.reservoir_state(numbers, 50, 1)
    assert held.count() == 50 and held.select("__slot").distinct().count() == 50


def test_source_positions(spark, numbers):
    s = Source(numbers, 500, shuffle_seed=4)
    order = [r[0] for r in s.epoch().orderBy("__pos").select(IDX).collect()]
    assert sorted(order) == list(range(500)) and order != sorted(order)
    assert order != [r[0] for r in s.epoch(1).orderBy("__pos").select(IDX).collect()]
    got = [r[0] for r in s.batch_at(480, 40).orderBy("__slot").select(IDX).collect()]
    assert got == (order + order)[480:520]
    shards = [set(r[0] for r in s.shard(k, 3).select(IDX).collect()) for k in range(3)]
    assert set.union(*shards) == set(range(500)) and sum(map(len, shards)) == 500
    assert s.at(-1).first()[IDX] == 499
    with pytest.raises(IndexError):
        s.at(500)
    assert s.take_indices(spark.createDataFrame([(3,), (3,), (7,)], f"{IDX} long")).count() == 3


def test_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = with_index(df, ["k"]).orderBy("k").collect()
    assert [r[IDX] for r in got] == list(range(1000)) and [r["k"] for r in got] == list(range(1000))
    with pytest.raises(ValueError):
        with_index(df)


def test_sources(spark, tmp_path):
    s = from_memory(spark, {"a": [1, 2, 3], "b": ["x", "y", "z"]}, include=("a",))
    assert s.epoch().columns == [IDX, "a", "__pos"] and len(s) == 3
    with pytest.raises(ValueError):
        from_memory(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(ValueError):
        Source(s.df, 3, include=("a",), exclude=("b",))
    with pytest.raises(TypeError):
        as_dataframe(iter([1]))
    with pytest.raises(FileNotFoundError):
        require_local(str(tmp_path / "none"))
    for fmt in ("parquet", "json", "orc"):
        s.df.drop(IDX).write.format(fmt).save(str(tmp_path / fmt))
        assert len(from_path(spark, str(tmp_path / fmt), fmt, by=["a"])) == 3
    np.save(tmp_path / "x.npy", np.arange(30, dtype=np.float32).reshape(10, 3))
    npy.register(spark)
    rows = spark.read.format("npy").option("rows", "4").load(str(tmp_path / "x.npy")).orderBy(IDX).collect()
    assert [r["data"] for r in rows] == np.arange(30).reshape(10, 3).tolist()


def test_mixtures(spark, numbers):
    a, b = Source(numbers, 500), Source(numbers.filter(f"{IDX} < 100"), 100)
    got = mixture.sample([a, b], [0.8, 0.2], 2000, seed=1)
    share = got.filter("__src = 1").count() / 2000
    assert got.count() == 2000 and abs(share - 0.2) < 0.04
    assert mixture.interleave([a, b]).count() == 600 and mixture.round_robin([a, b], 3).count() == 600
    with pytest.raises(ValueError):
        mixture.sample([a, Source(numbers.withColumn("y", F.lit(1)), 500)], [1, 1])


def test_composition_checks(numbers):
    two = Map(lambda c: c * 2, ("x",))
    with pytest.raises(ValueError):
        WeightedParallel((two,), None)
    with pytest.raises(ValueError):
        Probabilistic(two, 1.5)
    with pytest.raises(KeyError):
        Map(lambda c: c, ("nope",))(numbers)
    with pytest.raises(KeyError):
        Remap("nope")(numbers)
    with pytest.raises(ValueError):
        KeyFilter(("a",), ("b",))
    assert values(Branching((two, Map(lambda c: c, ("x",))), lambda f: F.lit(99))(numbers)) == values(numbers)
    assert values(Branching((two, Map(lambda c: c, ("x",))), lambda f: F.lit(None).cast("int"))(numbers)) == values(two(numbers))
    none = ConditionalParallel((two, two), (lambda f: f["x"] < 0, lambda f: f["x"] < 0), "mean")
    assert set(values(none(numbers))) == {0.0}
    custom = Parallel((two, two), merge=lambda rs: rs[1])
    assert values(custom(numbers)) == values(two(numbers))


def test_pandas_function(numbers):
    assert values(PandasFn("x", lambda s: s + 1, "double")(numbers)) == [v + 1 for v in values(numbers)]
    keyed_ = PandasFn("x", lambda s, k: s * 0 + (k % 7), "double", keyed=True)
    assert values(keyed_(numbers)) == values(keyed_(numbers.repartition(3)))


@pytest.mark.parametrize("last,count", [("keep", 8), ("drop", 7), ("pad", 8), ("wrap", 8)])
def test_batches(numbers, last, count):
    b = batching.Batcher(64, last)
    rows = b.assign(numbers, 500).collect()
    assert b.count(500) == count and len({r["batch_id"] for r in rows}) == count
    assert len(rows) == {"keep": 500, "drop": 448, "pad": 512, "wrap": 512}[last]
    assert sum(not r["valid"] for r in rows) == (12 if last == "pad" else 0)
    if last == "wrap":
        assert sorted(r[IDX] for r in rows if r["batch_id"] == 7)[:12] == list(range(12))


def test_regrouping(numbers):
    with pytest.raises(ValueError):
        batching.rebatch(numbers, 64, 500)
    with pytest.raises(ValueError):
        batching.split_equal(numbers, 3, 500)
    assert batching.contiguous_bounds(10, 3) == [(0, 3), (3, 6), (6, 9)]
    assert batching.contiguous_bounds(10, 3, False) == [(0, 4), (4, 7), (7, 10)]
    wrong = numbers.select(IDX, F.array("x", "x").alias("x"))
    with pytest.raises(Exception, match="not one entry"):
        batching.remove_batch_dimension(wrong, ["x"]).collect()
    with pytest.raises(ValueError):
        batching.upsample(F.col("x"), 0)


def test_mixup_of_a_single_row_changes_nothing(spark):
    one = spark.createDataFrame([(0, 0, 5.0)], f"{IDX} long, batch_id long, x double")
    assert augment.mixup(one, ["x"]).first()["x"] == 5.0


def test_mixup_alpha(numbers):
    d = batching.Batcher(50).assign(numbers, 500).select(IDX, "batch_id", "x")
    lam = {(r["batch_id"], r["lam"]) for r in augment.mixup(d, ["x"], alpha=0.4, seed=2).collect()}
    assert len(lam) == 10 and all(0 <= v <= 1 for _, v in lam)


def one_image(spark, x):
    return spark.createDataFrame([(0, [float(v) for v in x.ravel()])], f"{IDX} long, image array<double>")


def test_array_functions_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((4, 4, 3))
    df = one_image(spark, x)
    i = F.col("image")

    def got(c, shape=(4, 4, 3)):
        return np.array(df.select(c.alias("v")).first()["v"]).reshape(shape)

    assert np.allclose(got(arrays.flip_up_down(i, 4, 4, 3)), x[::-1])
    for k in range(4):
        assert np.allclose(got(arrays.rot90(i, 4, 4, 3, k)), np.rot90(x, k))
    assert np.allclose(got(arrays.crop(i, 4, 4, 3, 1, 2, 3, 2), (3, 2, 3)), x[1:4, 2:4])
    assert np.allclose(got(arrays.grayscale(i), (4, 4)), x @ np.array([0.299, 0.587, 0.114]))
    assert np.allclose(got(arrays.contrast(i, 1.4)), np.clip(x.mean() + 1.4 * (x - x.mean()), 0, 1))
    assert got(arrays.pad_to_multiple(i, 50), (50,))[48:].tolist() == [0, 0]
    assert np.allclose(got(arrays.max_pool(i, 5), (9,)), x.ravel()[:45].reshape(9, 5).max(1))
    assert got(arrays.frames(i, 10, 7), (6, 10)).shape == (6, 10)


def test_image_functions():
    rng = np.random.default_rng(1)
    x = rng.random((6, 5, 3))
    assert np.allclose(image.hsv_to_rgb(image.rgb_to_hsv(x)), x)
    assert np.allclose(image.rgb_to_hsv(np.array([[[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]]))[0, :, 0], [0, 2 * np.pi / 3, 4 * np.pi / 3])
    assert np.allclose(image.hue(x, 0.0), x) and np.allclose(image.saturation(x, 1.0), x)
    assert np.allclose(image.rotate(x, 0.0)[:-1, :-1], x[:-1, :-1])
    for m in ("nearest", "bilinear", "bicubic"):
        assert np.allclose(image.resize(x, 6, 5, m), x) and np.allclose(image.resize(np.ones((4, 4, 1)), 9, 3, m), 1)
    assert np.allclose(image.blur(np.ones((5, 5, 3)), 1.0), 1)
    assert np.array_equal(image.poisson_noise(x, 5), image.poisson_noise(x, 5))


def test_audio(spark):
    t = np.arange(16000) / 16000
    loud, soft = (audio.loudness_of(a * np.sin(2 * np.pi * 1000 * t)) for a in (1.0, 0.1))
    assert np.allclose((loud - soft)[20:-20], 20, atol=0.1)
    assert audio.loudness_of(np.zeros(640)).tolist() == [-80.0] * 10
    assert abs(spark.range(1).select(audio.a_weighting(F.lit(1000.0))).first()[0]) < 0.01
    peak = [0.0] * 100 + [1.0] + [0.0] * 259
    hz = spark.createDataFrame([(peak,)], "a array<double>").select(audio.pitch(F.col("a")), audio.confidence(F.col("a"))).first()
    assert math.isclose(hz[0], 10 * 2 ** ((audio.CENTS_FIRST + 100 * audio.CENTS_STEP) / 1200)) and hz[1] == 1.0
    f = audio.normalized_frames(np.random.default_rng(0).random(4000))
    assert f.shape[1] == 1024 and np.allclose(f.mean(1), 0) and np.allclose(f.std(1), 1)


def test_metadata(spark, numbers):
    m = metadata.with_metadata(numbers, 500, batch_size=10, key=F.col("x").cast("string"))
    both = m.withColumn("other", metadata.of(F.lit(0), 500, 2, shards=3)).select(metadata.merged(F.col("meta"), F.col("other")).alias("r")).filter("r.index = 7").first()["r"]
    assert (both["index"], both["epoch"], both["global_step"], both["batch_idx"], both["shard_id"], both["record_key"]) == (7, 2, 1000, 0, 0, "10.5")
    with pytest.raises(Exception, match="at most 128 bytes"):
        metadata.with_metadata(numbers, 500, key=F.repeat(F.lit("k"), 129)).collect()


def test_specs(spark):
    df = spark.createDataFrame([((1, [1.0, 2.0]), [3, 4])], "a struct<b: int, c: array<float>>, d array<int>")
    d = specs.with_shape(df, "d", (2, 1))
    assert specs.element_spec(d) == {"a.b": ((), "int"), "a.c": ((None,), "float"), "d": ((2, 1), "int")}
    assert specs.batch_spec(d, 8, valid=True)["d"] == ((8, 2, 1), "int") and specs.batch_spec(d, 8, valid=True)["valid"] == ((8,), "boolean")
    with pytest.raises(ValueError):
        specs.same_structure(df, df.drop("d"))
    ts = specs.TimeSeries(8, 2)
    assert ts.solution == 4 and spark.range(1).select(ts.holds(F.array_repeat(F.lit(0), 8), F.array_repeat(F.lit(0), 4))).first()[0]
    with pytest.raises(ValueError):
        specs.TimeSeries(7, 2)


def test_caches(spark, numbers, tmp_path):
    first = caching.kept_at(numbers, str(tmp_path / "t")).count()
    assert first == 500 and caching.kept_at(numbers.limit(1), str(tmp_path / "t")).count() == 500
    with caching.cached(numbers) as c:
        assert c.is_cached and sum(1 for _ in caching.rows_ahead(c)) == 500
    assert caching.resolve(None, f"{tmp_path}/", "x") == f"{tmp_path}/x" and caching.resolve("hdfs://a/b", "c", "x") == "hdfs://a/b/x"


def test_images_by_batches_are_those_one_by_one(spark):
    rng = np.random.default_rng(3)
    x, a, s = rng.random((7, 6, 5, 3)), rng.uniform(-1, 1, 7), rng.uniform(0.2, 2, 7)
    for fn, p in ((image.rotate, a), (image.blur, s), (image.hue, a), (image.saturation, s), (lambda x, u: image.resized_crop(x, u, u), np.abs(a) * 0.99)):
        assert np.allclose(fn(x, p), np.stack([fn(one, q) for one, q in zip(x, p)]))
    assert np.allclose(image.jitter(x, s, s, s, a), np.stack([image.jitter(one, q, q, q, r) for one, q, r in zip(x, s, a)]))
    assert np.allclose(image.resize(x, 3, 9), np.stack([image.resize(one, 3, 9) for one in x]))
    rows = [(i, None if i == 2 else one.ravel().tolist(), float(r)) for i, (one, r) in enumerate(zip(x, a))]
    df = spark.createDataFrame(rows, "i int, x array<double>, r double")
    got = {r["i"]: r["y"] for r in df.select("i", image.over(image.rotate, (6, 5, 3))(F.col("x"), F.col("r")).alias("y")).collect()}
    assert got[2] is None and all(np.allclose(got[i], image.rotate(x[i], a[i]).ravel()) for i in range(7) if i != 2)


def test_loudness_of_waves_of_any_length(spark):
    waves = [np.sin(np.arange(n) / 3.0).tolist() for n in (640, 1280, 640)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate([*waves, None])], "i int, x array<double>")
    got = {r["i"]: r["y"] for r in df.select("i", audio.loudness(F.col("x")).alias("y")).collect()}
    assert got[3] is None and all(np.allclose(got[i], audio.loudness_of(np.array(w))) for i, w in enumerate(waves))


@pytest.mark.parametrize("capacity", [1, 2, 5, 33, 600])
def test_ring_buffer_holds_the_last_rows(numbers, capacity):
    got = {r[IDX]: r["__buffer"] for r in sampling.FifoBuffer(capacity).contents(numbers.repartition(3), "x").collect()}
    assert got == {i: [k * 1.5 for k in range(max(0, i - capacity + 1), i + 1)] for i in range(500)}


def test_partners_are_a_permutation_of_the_batch(numbers):
    b = batching.Batcher(64).assign(numbers, 500).select(IDX, "batch_id", "x")
    met = augment.partner(b, ["x", IDX], seed=3)
    rows = met.collect()
    assert sorted(r[IDX] for r in rows) == list(range(500)) == sorted(r["__other"][IDX] for r in rows)
    assert all(r[IDX] // 64 == r["__other"][IDX] // 64 and r["__other"]["x"] == r["__other"][IDX] * 1.5 for r in rows)
    assert all(r["__n"] == min(64, 500 - r["batch_id"] * 64) for r in rows)
    assert "Join" not in met._jdf.queryExecution().toString() and met.columns[:3] == b.columns


def test_endless_sampler(spark):
    done = []
    c = sampling.EpochCursor(10, seed=5, on_epoch=done.append)
    parts = []
    for n in (7, 16, 5):
        df, c = c.take(spark, n)
        parts += sorted(map(tuple, df.select("__pos", "__epoch", IDX).collect()))
    assert [p for p, _, _ in parts] == list(range(28)) and done == [0, 1] and c.progress() == 0.8
    assert all(sorted(i for _, e, i in parts if e == k) == list(range(10)) for k in (0, 1))
    again, _ = sampling.EpochCursor(10, seed=5).restored({"n": 10, "position": 20}).take(spark, 8)
    assert sorted(map(tuple, again.select("__pos", "__epoch", IDX).collect())) == parts[20:]
    assert c.state() == {"n": 10, "position": 28, "epoch": 2, "offset": 8}
    with pytest.raises(ValueError):
        c.restored({"n": 11, "position": 0})


def test_permutations_by_sql_rounds(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(keyed.permuted(F.col("id"), n, 9, exact=True)).collect()]
        assert sorted(got) == list(range(n))


def test_values_of_the_row_are_computed_once(spark):
    x = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda v: v.cast("double"))
    got = spark.range(3).select(arrays.bind(lambda a, b: F.transform(a, lambda v: v + b), a=x, b=F.col("id").cast("double"))[1]).collect()
    assert [r[0] for r in got] == [1.0, 2.0, 3.0]


def test_exported_splits(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    tables = [pa.table({"x": list(range(k * 10, k * 10 + 10)), "y": [f"n{i}" for i in range(10)]}) for k in range(3)]
    for k, t in enumerate(tables):
        pq.write_table(t, tmp_path / f"set-train-0000{k}-of-00003.parquet")
        with pa.OSFile(str(tmp_path / f"set-test-0000{k}-of-00003.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t, max_chunksize=4)
    (tmp_path / "dev").mkdir()
    with pa.OSFile(str(tmp_path / "dev/a.arrow"), "wb") as f, pa.ipc.new_file(f, tables[0].schema) as w:
        w.write_table(tables[0])
    for split, n in (("train", 30), ("test", 30), ("dev", 10)):
        s = exports.from_export(spark, str(tmp_path), split, include=("x",))
        assert len(s) == n and s.epoch().columns == [IDX, "x", "__pos"]
        assert [(r[IDX], r["x"]) for r in s.epoch().orderBy(IDX).collect()] == [(i, i) for i in range(n)]
    pair = exports.from_export(spark, str(tmp_path), "test", supervised=("x", "y"), shuffle_seed=3)
    assert pair.epoch().columns == [IDX, "input", "target", "__pos"] and {r["target"] for r in pair.epoch().collect()} == {f"n{i}" for i in range(10)}
    with pytest.raises(FileNotFoundError):
        exports.from_export(spark, str(tmp_path), "none")
    with pytest.raises(ValueError):
        exports.from_export(spark, str(tmp_path), "train", include=("x",), supervised=("x", "y"))
