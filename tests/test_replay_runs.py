"""Replay buffers: reads of a run are done by the stream's own tasks, the rest by keys. Streams of records come in batches of many rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.operators.base import IDX
from weirflow.sources import records
from weirflow.streaming import replay


class Kept:
    def __init__(self):
        self.value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def batches(rows, size):
    schema = pa.schema([("t", pa.int64()), ("w", pa.int64()), ("r", pa.list_(pa.int64())), ("g0", pa.list_(pa.string())), ("g1", pa.int32()), ("v0", pa.string())])
    return [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[a : a + size]], schema) for a in range(0, len(rows), size)]


def replayed(parts, states):
    """A micro-batch in tasks of these batches: (group, row, which read, row that is read, its value)."""
    got, keys = [], {}
    for part in parts:
        for b in replay._done(iter(part), ["x"]):
            got += [(x["__t"], x["__k"], x[IDX], x["x"]) for x in b.to_pylist()]
        for b in replay._left(iter(part), 3):
            for x in b.to_pylist():
                keys.setdefault((str(x["g0"]), x["g1"], x["split"]), []).append((x["t"], x["k"], x["slot"], x["v0"]))
    for key, rows in sorted(keys.items(), key=repr):
        if key not in states:
            states[key] = replay._Slots(["x"])
            states[key].init(Kept())
        for f in states[key].handleInputRows(key, iter([pd.DataFrame(rows, columns=["t", "k", "slot", "v0"])]), None):
            got += list(f.itertuples(index=False, name=None))
    return got


@pytest.mark.parametrize("dealt", ["in order", "anyhow", "by twos"])
def test_runs_and_keys(dealt, monkeypatch):
    monkeypatch.setattr(replay, "ROWS", 50)
    rng, rows, want, held = np.random.default_rng(3), [], [], {}
    groups = [(["a", None], 1), (None, 1), (["a"], None), (["a"], 2)]
    for t in range(200):
        for g in groups:
            w = None if t % 7 == 3 else int(rng.integers(0, 9))
            r = None if t < 6 else rng.integers(0, 10, 2).tolist()
            rows.append((t, w, r, *g, f"{g} {t}"))
            if w is not None:
                held[repr(g), w] = (t, rows[-1][-1])
            want += [(t, 0, t, rows[-1][-1])] if r is None else [(t, k, *held[repr(g), s]) for k, s in enumerate(r) if (repr(g), s) in held]
    got, states = [], {}
    for a in range(0, 800, 320):
        own = rows[a : a + 320]
        if dealt == "anyhow":
            own = [own[i] for i in rng.permutation(len(own))]
        parts = [own[0::2], own[1::2]] if dealt == "by twos" else [own[:100], own[100:]]
        got += replayed([batches(p, 30) for p in parts], states)
    assert sorted(got) == sorted(want)


def test_little_is_left_of_a_run():
    rows = [(t, t % 32, [(t * 5) % 32, (t * 11) % 32], ["a"], 1, "x") for t in range(16, 20_016)]
    assert sum(b.num_rows for b in replay._left(iter(batches(rows, 4000)), 4)) < 150


def test_rows_again_are_refused():
    rows = lambda a, b: batches([(t, t % 4, [t % 3], ["a"], 1, "x") for t in range(a, b)], 1000)
    states = {}
    assert len(replayed([rows(60, 80), rows(0, 60)], states)) == 80
    for parts in ([rows(79, 120)], [rows(20, 30)], [rows(90, 100), rows(80, 91)]):
        with pytest.raises(ValueError, match="comes after"):
            replayed(parts, states)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    df = spark.range(0, 500, 1, 3).select(F.col("id").alias(IDX), (F.col("id") * 2).alias("v"))
    return records.saved(df, str(tmp_path_factory.mktemp("rec") / "set"), chunk=32)


@pytest.mark.parametrize("buffer", [1, 7, 64, 1000])
@pytest.mark.parametrize("stretch", [None, 20])
def test_batches_of_a_stream(spark, folder, monkeypatch, buffer, stretch):
    if stretch:
        monkeypatch.setattr(records, "STRETCH", stretch)
    schema = records.RecordStreamSource({"path": folder}).schema()
    r = records.RecordStreamReader({"path": folder, "buffer": buffer, "seed": 5, "epochs": 2}, schema)
    got = []
    for a, b in ((0, 3), (3, 450), (450, 1000)):
        for p in r.partitions({"position": a}, {"position": b}):
            frames = list(r.read(p))
            if not stretch:
                assert len(frames) == 1
            got += [x for f in frames for x in f.to_pylist()]
    assert [x["__pos"] for x in got] == list(range(1000)) and all(x["v"] == 2 * x[IDX] and x["__epoch"] == x["__pos"] // 500 for x in got)
    want = []
    for e in (0, 1):
        for block, low in enumerate(range(0, 500, buffer)):
            n = min(buffer, 500 - low)
            want += (low + np.random.Generator(np.random.Philox([5, e * 2**32 + block])).permutation(n)).tolist()
    assert [x[IDX] for x in got] == want


def test_spans_bring_their_chunks(spark, folder):
    r = records.RecordStreamReader({"path": folder}, None)
    (p,) = r.partitions({"position": 100}, {"position": 140})
    assert sum(c.rows for _, _, c in p.chunks) <= 40 + 2 * 32 and r.__getstate__()["index"] is None


def test_state_partitions(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with replay.state_partitions(spark, 2):
        assert spark.conf.get(name) == "2"
    assert spark.conf.get(name) == before
