"""A convolutional pitch network over frames of audio: the forward pass, by Arrow batches.

Six blocks of padding, convolution, rectifier, normalisation by given statistics and pooling by two, then one dense layer and a
sigmoid: the published pitch network's layout at any of its sizes. Weights are supplied (a dict of arrays, or an ``.npz``
file's bytes) and sent to the executors once; nothing is trained or downloaded here. A convolution is one matrix product over
the unfolded input of a few frames at a time, so memory is bounded whatever the batch.

Null frames give null; frames of another length, or with NaN, are errors.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Channels of the layers of the smallest unit, and how many units each size has.
UNITS = (32, 4, 4, 4, 8, 16)
SIZES = {"tiny": 4, "small": 8, "medium": 16, "large": 24, "full": 32}
FRAME, BINS, EPSILON = 1024, 360, 0.001
#: Frames that are unfolded at once.
AT_ONCE = 32


@dataclass(frozen=True)
class Layer:
    channels: int
    width: int
    stride: int
    pad: tuple[int, int]


def layers(size: str) -> list[Layer]:
    if size not in SIZES:
        raise ValueError(f"size must be one of {sorted(SIZES)}")
    own = [SIZES[size] * u for u in UNITS]
    return [Layer(own[0], 512, 4, (254, 254)), *(Layer(c, 64, 1, (31, 32)) for c in own[1:])]


def shapes(size: str) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the weights: kernels are (width, channels in, channels out)."""
    out, before = {}, 1
    for i, layer in enumerate(layers(size)):
        out[f"conv{i}.kernel"] = (layer.width, before, layer.channels)
        out |= {f"{n}{i}.{w}": (layer.channels,) for n, w in (("conv", "bias"), ("norm", "scale"), ("norm", "bias"), ("norm", "mean"), ("norm", "var"))}
        before = layer.channels
    return out | {"dense.kernel": (4 * before, BINS), "dense.bias": (BINS,)}


def seeded(size: str, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of no meaning, for tests and timing."""
    r, out = np.random.default_rng(seed), {}
    for name, shape in shapes(size).items():
        if name.endswith(("var", "scale")):
            out[name] = r.uniform(0.5, 1.5, shape).astype(np.float32)
        else:
            fan = int(np.prod(shape[:-1])) if len(shape) > 1 else 100
            out[name] = (r.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
    return out


def checked(weights: dict[str, np.ndarray] | bytes, size: str) -> dict[str, np.ndarray]:
    if isinstance(weights, bytes):
        with np.load(io.BytesIO(weights), allow_pickle=False) as z:
            weights = {k: z[k] for k in z.files}
    wrong = {k: s for k, s in shapes(size).items() if k not in weights or weights[k].shape != s}
    if wrong:
        raise ValueError(f"weights missing or of another shape: {wrong}")
    return {k: np.asarray(weights[k], np.float32) for k in shapes(size)}


def forward(x: np.ndarray, weights: dict[str, np.ndarray], size: str) -> np.ndarray:
    """Activations (frames, 360) of frames (frames, 1024)."""
    if x.ndim != 2 or x.shape[1] != FRAME or not np.isfinite(x).all():
        raise ValueError(f"frames must be {FRAME} numbers each")
    x = x.astype(np.float32)[:, :, None]
    for i, layer in enumerate(layers(size)):
        x = np.pad(x, ((0, 0), layer.pad, (0, 0)))
        seen = np.lib.stride_tricks.sliding_window_view(x, layer.width, axis=1)[:, :: layer.stride]
        n, length, c, _ = seen.shape
        kernel = weights[f"conv{i}.kernel"].transpose(1, 0, 2).reshape(c * layer.width, layer.channels)
        x = np.maximum(seen.reshape(n * length, c * layer.width) @ kernel + weights[f"conv{i}.bias"], 0)
        scale = weights[f"norm{i}.scale"] / np.sqrt(weights[f"norm{i}.var"] + np.float32(EPSILON))
        x = ((x - weights[f"norm{i}.mean"]) * scale + weights[f"norm{i}.bias"]).reshape(n, length, layer.channels)
        x = x[:, : length // 2 * 2].reshape(n, length // 2, 2, layer.channels).max(axis=2)
    z = x.reshape(len(x), -1) @ weights["dense.kernel"] + weights["dense.bias"]
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def activations(spark: SparkSession, frames: Column, weights: dict[str, np.ndarray] | bytes, size: str = "full") -> Column:
    """The 360 activations of each frame (an array of 1024 numbers), input of :func:`~weirflow.functions.audio.pitch`."""
    sent = spark.sparkContext.broadcast(checked(weights, size))  # some MB to some hundred, as the size has it

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        known = np.flatnonzero(s.is_valid().to_numpy(zero_copy_only=False))
        own = s.take(pa.array(known))
        lengths = own.value_lengths().to_numpy(zero_copy_only=False)
        if (lengths != FRAME).any():
            raise ValueError(f"frames must be {FRAME} numbers each")
        x = own.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, FRAME)
        out: list[np.ndarray | None] = [None] * len(s)
        for at in range(0, len(x), AT_ONCE):
            for i, row in zip(known[at : at + AT_ONCE], forward(x[at : at + AT_ONCE], sent.value, size)):
                out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    return run(frames)
