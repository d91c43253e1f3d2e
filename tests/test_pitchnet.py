"""The network's forward pass against a loop over every output, and over a table."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.functions import audio, pitchnet


def slow(frame, w, size):
    """One frame, one output at a time."""
    x = frame.astype(np.float64)[:, None]
    for i, layer in enumerate(pitchnet.layers(size)):
        x = np.concatenate([np.zeros((layer.pad[0], x.shape[1])), x, np.zeros((layer.pad[1], x.shape[1]))])
        k, out = w[f"conv{i}.kernel"].astype(np.float64), []
        for at in range(0, len(x) - layer.width + 1, layer.stride):
            total = w[f"conv{i}.bias"].astype(np.float64)
            for c in range(x.shape[1]):
                total = total + x[at : at + layer.width, c] @ k[:, c]
            total = np.where(total > 0, total, 0)
            out.append((total - w[f"norm{i}.mean"]) / np.sqrt(w[f"norm{i}.var"] + 0.001) * w[f"norm{i}.scale"] + w[f"norm{i}.bias"])
        x = np.array([np.maximum(out[j], out[j + 1]) for j in range(0, len(out) - 1, 2)])
    z = x.reshape(-1) @ w["dense.kernel"].astype(np.float64) + w["dense.bias"]
    return 1 / (1 + np.exp(-z))


def test_forward_is_the_loop():
    w = pitchnet.seeded("tiny", 3)
    x = audio.normalized_frames(np.sin(np.arange(1344) * 2 * np.pi * 220 / 16000) + 0.1 * np.cos(np.arange(1344)))
    got = pitchnet.forward(x, w, "tiny")
    assert got.shape == (3, 360) and np.abs(got[0] - slow(x[0], w, "tiny")).max() < 1e-4
    assert np.allclose(got[1:], pitchnet.forward(x[1:], w, "tiny"), atol=1e-6)


def test_shapes_of_the_published_sizes():
    assert pitchnet.shapes("full")["conv0.kernel"] == (512, 1, 1024) and pitchnet.shapes("full")["dense.kernel"] == (2048, 360)
    assert [layer.channels for layer in pitchnet.layers("small")] == [256, 32, 32, 32, 64, 128]
    with pytest.raises(ValueError):
        pitchnet.layers("huge")


def test_over_a_table(spark, monkeypatch):
    w = pitchnet.seeded("tiny", 1)
    frames = [np.sin(np.arange(1024) * k / 50).astype(np.float32) for k in range(5)]
    df = spark.createDataFrame([(k, f.tolist()) for k, f in enumerate(frames)] + [(9, None)], "i long, f array<float>").repartition(2)
    packed = io.BytesIO()
    np.savez(packed, **w)
    want = pitchnet.forward(np.stack(frames), w, "tiny")
    for weights in (w, packed.getvalue()):
        out = df.select("i", pitchnet.activations(spark, F.col("f"), weights, "tiny").alias("a"))
        got = {r["i"]: r["a"] for r in out.collect()}
        assert got[9] is None and all(np.allclose(got[k], want[k], atol=1e-6) for k in range(5))
    hertz = {r["i"]: r["h"] for r in out.where("a IS NOT NULL").select("i", audio.pitch(F.col("a")).alias("h")).collect()}
    assert all(30 < h < 2100 for h in hertz.values())
    with pytest.raises(ValueError, match="another shape"):
        pitchnet.activations(spark, F.col("f"), w, "small")
    with pytest.raises(Exception, match="1024 numbers"):
        df.select(pitchnet.activations(spark, F.slice("f", 1, 10), w, "tiny")).collect()
