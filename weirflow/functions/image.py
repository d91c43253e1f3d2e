"""Image functions that need neighbours or many channels: numpy, over whole Arrow batches.

Images are arrays of shape [..., H, W, C] in [0, 1], of any number of leading axes; parameters have those axes, or none.
In tables images are flattened, with their shape given to :func:`over`, which stacks pieces of a batch into arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of the images that are worked on at once: what a function needs besides its input and result grows with these, not with a batch.
ENTRIES = 1 << 17


def over(fn: Callable[..., np.ndarray], shape: tuple[int, ...], **fixed) -> Callable[..., Column]:
    """``fn(images, *scalars)`` as a function of an array column and columns of scalars; null stays null."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, *scalars: pa.Array) -> pa.Array:
        valid = x.is_valid().to_numpy(zero_copy_only=False)
        there, step, out = np.flatnonzero(valid), max(1, ENTRIES // math.prod(shape)), np.zeros((0, 0))
        for k in range(0, len(there), step):
            rows = pa.array(there[k : k + step])
            images = x.take(rows).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)
            part = np.asarray(fn(images, *(c.take(rows).to_numpy(zero_copy_only=False) for c in scalars), **fixed), float).reshape(len(rows), -1)
            if not k:
                out = np.empty((len(there), part.shape[1]))
            out[k : k + step] = part
        ends = np.concatenate([[0], np.cumsum(valid)]).astype(np.int32) * np.int32(out.shape[1])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~valid))

    return run


def _per(p: float | np.ndarray, axes: int) -> np.ndarray:
    """A parameter with ``axes`` more axes, to go with those of an image."""
    p = np.asarray(p)
    return p.reshape(p.shape + (1,) * axes)


def _taps(n: int, out: int, kernel: Callable[[np.ndarray], np.ndarray], support: float, antialias: bool) -> np.ndarray:
    """Weights [out, n] of a separable resampling with half-pixel centres; edges renormalised."""
    scale = n / out
    wide = max(scale, 1.0) if antialias else 1.0
    centre = (np.arange(out) + 0.5) * scale - 0.5
    w = kernel((centre[:, None] - np.arange(n)[None, :]) / wide)
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)


def _linear(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0))


def resize(x: np.ndarray, h: int, w: int, method: str = "bilinear", antialias: bool = True) -> np.ndarray:
    h, w = int(h), int(w)
    if method == "nearest":
        i = np.floor((np.arange(h) + 0.5) * x.shape[-3] / h).astype(int)
        j = np.floor((np.arange(w) + 0.5) * x.shape[-2] / w).astype(int)
        return x[..., i, :, :][..., j, :]
    kernel, support = {"bilinear": (_linear, 1.0), "bicubic": (_cubic, 2.0)}[method]
    down = np.einsum("oh,...hwc->...owc", _taps(x.shape[-3], h, kernel, support, antialias), x)
    return np.einsum("ow,...hwc->...hoc", _taps(x.shape[-2], w, kernel, support, antialias), down)


def resized_crop(x: np.ndarray, u: float | np.ndarray, v: float | np.ndarray, share: float = 0.75) -> np.ndarray:
    """A crop of ``share`` of either side at (u, v) of the free room, resized back."""
    rows, cols = x.shape[-3:-1]
    h, w = max(1, int(rows * share)), max(1, int(cols * share))
    top, left = (np.asarray(r * n).astype(int) for r, n in ((u, rows - h + 1), (v, cols - w + 1)))
    i, j = top[..., None] + np.arange(h), left[..., None] + np.arange(w)
    part = np.take_along_axis(np.take_along_axis(x, i[..., :, None, None], -3), j[..., None, :, None], -2)
    return resize(part, rows, cols)


def rgb_to_hsv(x: np.ndarray) -> np.ndarray:
    """Hue in radians, saturation, value."""
    hi, lo = x.max(-1), x.min(-1)
    d = hi - lo
    r, g, b = np.moveaxis(x, -1, 0)
    safe = np.where(d > 0, d, 1)
    sector = np.where(hi == r, ((g - b) / safe) % 6, np.where(hi == g, (b - r) / safe + 2, (r - g) / safe + 4))
    return np.stack([np.where(d > 0, sector, 0) * (np.pi / 3), np.where(hi > 0, d / np.where(hi > 0, hi, 1), 0), hi], -1)


def hsv_to_rgb(x: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(x, -1, 0)
    k = (np.array([5.0, 3.0, 1.0]) + (h / (np.pi / 3))[..., None]) % 6
    return v[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))


def saturation(x: np.ndarray, factor: float | np.ndarray) -> np.ndarray:
    h = rgb_to_hsv(x)
    h[..., 1] = np.clip(h[..., 1] * _per(factor, 2), 0, 1)
    return np.clip(hsv_to_rgb(h), 0, 1)


def hue(x: np.ndarray, delta: float | np.ndarray) -> np.ndarray:
    """Hue turned by ``delta`` radians, at most half a turn either way."""
    h = rgb_to_hsv(x)
    h[..., 0] = (h[..., 0] + np.clip(_per(delta, 2), -np.pi, np.pi)) % (2 * np.pi)
    return np.clip(hsv_to_rgb(h), 0, 1)


def jitter(x: np.ndarray, brightness: float | np.ndarray = 1.0, contrast: float | np.ndarray = 1.0, saturate: float | np.ndarray = 1.0, turn: float | np.ndarray = 0.0) -> np.ndarray:
    """Brightness, then contrast, then saturation, then hue."""
    x = np.clip(x * _per(brightness, 3), 0, 1)
    mean = x.mean(axis=(-3, -2, -1), keepdims=True)
    x = np.clip(mean + _per(contrast, 3) * (x - mean), 0, 1)
    return hue(saturation(x, saturate), turn) if x.shape[-1] == 3 else x


def rotate(x: np.ndarray, angle: float | np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Turned by ``angle`` radians about (H/2, W/2), bilinear, ``fill`` where the source is outside."""
    h, w = x.shape[-3:-1]
    i, j = np.meshgrid(np.arange(h) - h / 2, np.arange(w) - w / 2, indexing="ij")
    c, s = np.cos(_per(angle, 2)), np.sin(_per(angle, 2))
    si, sj = i * c - j * s + h / 2, i * s + j * c + w / 2
    inside = (si >= 0) & (si <= h - 1) & (sj >= 0) & (sj <= w - 1)
    a, b = np.clip(si, 0, h - 1), np.clip(sj, 0, w - 1)
    i0, j0 = np.minimum(np.floor(a).astype(int), max(h - 2, 0)), np.minimum(np.floor(b).astype(int), max(w - 2, 0))
    i1, j1 = np.minimum(i0 + 1, h - 1), np.minimum(j0 + 1, w - 1)
    flat = x.reshape(*x.shape[:-3], h * w, x.shape[-1])

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        place = (i * w + j).reshape(*i.shape[:-2], h * w, 1)
        return np.take_along_axis(flat, np.broadcast_to(place, (*flat.shape[:-1], 1)), -2).reshape(x.shape)

    fa, fb = (a - i0)[..., None], (b - j0)[..., None]
    out = (1 - fa) * ((1 - fb) * at(i0, j0) + fb * at(i0, j1)) + fa * ((1 - fb) * at(i1, j0) + fb * at(i1, j1))
    return np.where(inside[..., None], out, fill)


def blur(x: np.ndarray, sigma: float | np.ndarray, size: int = 5) -> np.ndarray:
    """Gaussian of ``size`` taps along both axes, edges repeated."""
    t = np.arange(size) - size // 2
    k = np.exp(-(t**2) / (2 * _per(sigma, 1) ** 2))
    k /= k.sum(axis=-1, keepdims=True)
    for axis in (-3, -2):
        n = x.shape[axis]
        x = sum(_per(k[..., i], 3) * np.take(x, np.clip(np.arange(n) + t[i], 0, n - 1), axis) for i in range(size))
    return x


def poisson_noise(x: np.ndarray, seed: int | np.ndarray, scale: float = 255.0) -> np.ndarray:
    """Poisson counts of mean x scale, scaled back; each image keyed by its own seed."""
    draw = lambda one, s: np.random.Generator(np.random.PCG64(int(s) % (1 << 64))).poisson(np.maximum(one, 0) * scale) / scale
    return np.stack([draw(one, s) for one, s in zip(x, seed)]) if np.ndim(seed) and len(seed) else draw(x, seed) if not np.ndim(seed) else x
