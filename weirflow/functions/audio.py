"""Audio: loudness, framing for pitch, decoding of pitch activations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corner frequencies of A-weighting (IEC 61672), and its gain at 1 kHz in dB.
A_CORNERS, A_GAIN = (20.598997, 107.65265, 737.86223, 12194.217), 2.0
#: Cents of the first pitch bin, cents between bins, bins.
CENTS_FIRST, CENTS_STEP, PITCH_BINS = 1997.3794084376191, 20.0, 360


def a_weighting(hz: Column) -> Column:
    """Decibels by frequency."""
    f2 = hz * hz
    a, b, c, d = (x * x for x in A_CORNERS)
    gain = (f2 * f2 * d) / ((f2 + a) * F.sqrt((f2 + b) * (f2 + c)) * (f2 + d))
    return F.lit(A_GAIN) + F.lit(20.0) * F.log10(gain)


def _weights(n_fft: int, rate: float) -> np.ndarray:
    f2 = np.maximum(np.fft.rfftfreq(n_fft, 1 / rate), 1e-9) ** 2
    a, b, c, d = (x * x for x in A_CORNERS)
    return A_GAIN + 20 * np.log10(np.maximum(f2 * f2 * d / ((f2 + a) * np.sqrt((f2 + b) * (f2 + c)) * (f2 + d)), 1e-20))


def loudness_of(x: np.ndarray, rate: float = 16000, n_fft: int = 512, hop: int = 64, reference: float = 20.7, floor: float = 80.0) -> np.ndarray:
    """A-weighted mean power in dB of each of len // hop frames of waves [..., len]; frames are centred, the ends padded with zeros."""
    n = x.shape[-1] // hop
    p = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(n_fft // 2, n_fft // 2)])
    at = np.arange(n)[:, None] * hop + np.arange(n_fft)[None, :]
    window = np.hanning(n_fft + 1)[:-1]
    power = np.abs(np.fft.rfft(p[..., np.minimum(at, p.shape[-1] - 1)] * window)) ** 2
    db = 10 * np.log10(np.maximum(power, 1e-20)) + _weights(n_fft, rate)
    level = 10 * np.log10(np.mean(10 ** (db / 10), axis=-1)) - reference
    return np.maximum(level, -floor)


def loudness(x: Column, **options) -> Column:
    """:func:`loudness_of` waves of any lengths: those of one length at once. Null stays null."""

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        lengths = s.value_lengths().to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(s)
        for n in np.unique(lengths[~np.isnan(lengths.astype(float))]):
            own = np.flatnonzero(lengths == n)
            waves = s.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), int(n))
            for i, row in zip(own, loudness_of(waves, **options)):
                out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    return run(x)


def normalized_frames(x: np.ndarray, size: int = 1024, hop: int = 160) -> np.ndarray:
    """Frames of zero mean and unit variance, the input of a pitch model."""
    n = 1 + max(0, len(x) - size) // hop
    f = x[np.minimum(np.arange(n)[:, None] * hop + np.arange(size)[None, :], len(x) - 1)]
    f = f - f.mean(axis=1, keepdims=True)
    return f / np.maximum(f.std(axis=1, keepdims=True), 1e-8)


def pitch(activations: Column, radius: int = 4) -> Column:
    """Hertz from an array of bin activations: the weighted mean of cents within ``radius`` bins of the strongest."""
    best = (F.array_position(activations, F.array_max(activations)) - 1).cast("int")
    lo = F.greatest(F.lit(0), best - radius)
    near = F.sequence(lo, F.least(F.size(activations) - 1, best + radius))
    weight = F.aggregate(near, F.lit(0.0), lambda a, i: a + F.get(activations, i))
    cents = F.aggregate(near, F.lit(0.0), lambda a, i: a + F.get(activations, i) * (F.lit(CENTS_FIRST) + i * CENTS_STEP))
    return F.lit(10.0) * F.pow(F.lit(2.0), cents / weight / F.lit(1200.0))


def pitch_soft(logits: Column, temperature: float = 1.0) -> Column:
    """Hertz from the softmax-weighted mean of cents over all bins."""
    top = F.array_max(logits)
    e = F.transform(F.array(top), lambda m: F.transform(logits, lambda v: F.exp((v - m) / temperature)))[0]
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    cents = F.aggregate(F.transform(e, lambda v, i: v * (F.lit(CENTS_FIRST) + i * CENTS_STEP)), F.lit(0.0), lambda a, v: a + v)
    return F.lit(10.0) * F.pow(F.lit(2.0), cents / total / F.lit(1200.0))


def confidence(activations: Column) -> Column:
    """1 less the entropy of the normalised activations over its largest value."""
    total = F.aggregate(activations, F.lit(0.0), lambda a, v: a + v)
    h = F.aggregate(activations, F.lit(0.0), lambda a, v: a - F.when(v > 0, v / total * F.log(v / total)).otherwise(0.0))
    return F.lit(1.0) - h / F.log(F.size(activations).cast("double"))


def decibels(power: float) -> float:
    return 10 * math.log10(max(power, 1e-20))
