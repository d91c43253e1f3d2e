"""Functions of flattened arrays (row-major), in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keyed

#: Weights of red, green and blue in luma.
LUMA = (0.299, 0.587, 0.114)


def bind(fn: Callable[..., Column], **columns: Column) -> Column:
    """``fn(**columns)`` with each column computed once a row: inside a lambda over entries it would be once an entry."""
    once = F.struct(*[c.alias(k) for k, c in columns.items()])
    return F.transform(F.array(once), lambda s: fn(**{k: s.getField(k) for k in columns}))[0]


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def to_unit(x: Column) -> Column:
    """Bytes to [0, 1] as floats."""
    return F.transform(x, lambda v: (v / F.lit(255.0)).cast("float"))


def affine(x: Column, scale: float | Column = 1.0, shift: float | Column = 0.0) -> Column:
    scale, shift = (F.lit(v) if isinstance(v, (int, float)) else v for v in (scale, shift))
    return bind(lambda a, b: F.transform(x, lambda v: v * a + b), a=scale, b=shift)


def mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v, lambda a: a / F.greatest(F.size(x), F.lit(1)))


def l2(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def unit_length(x: Column) -> Column:
    """x / |x|; the zero vector stays."""
    return F.transform(F.array(l2(x)), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(F.transform(x, lambda v: v.cast("double"))))[0]


def normalize(x: Column, means: list[float], stds: list[float], bounds: tuple[float, float] | None = None) -> Column:
    """(x - mean) / std by channel (last axis), clipped where bounds are given."""
    m, s, n = F.array(*map(F.lit, means)), F.array(*map(F.lit, stds)), len(means)
    out = F.transform(x, lambda v, i: (v - F.get(m, F.pmod(i, F.lit(n)))) / F.get(s, F.pmod(i, F.lit(n))))
    return clip(out, *bounds) if bounds else out


def brightness(x: Column, factor: float | Column = 1.0, delta: float | Column = 0.0, bounds: tuple[float, float] = (0.0, 1.0)) -> Column:
    return clip(affine(x, factor, delta), *bounds)


def contrast(x: Column, factor: float | Column, bounds: tuple[float, float] = (0.0, 1.0)) -> Column:
    """mean + factor (x - mean), the mean over the whole array."""
    f = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return clip(bind(lambda m, f: F.transform(x, lambda v: m + f * (v - m)), m=mean(x), f=f), *bounds)


def grayscale(x: Column, keep_channels: bool = False) -> Column:
    """Luma of each pixel of an RGB array; repeated three times with ``keep_channels``."""
    pixels = F.sequence(F.lit(0), (F.size(x) / 3 - 1).cast("int"))
    luma = bind(lambda x: F.transform(pixels, lambda p: sum((F.get(x, p * 3 + c) * w for c, w in enumerate(LUMA)), F.lit(0.0))), x=x)
    return F.flatten(F.transform(luma, lambda v: F.array_repeat(v, 3))) if keep_channels else luma


def gather(x: Column, h: int, w: int, c: int, source: Callable[[Column, Column], tuple[Column, Column]], out_h: int | None = None, out_w: int | None = None, fill: float | None = None) -> Column:
    """Entry (i, j, k) of the result is entry (source(i, j), k) of ``x``; ``fill`` where that is outside."""
    oh, ow = out_h or h, out_w or w

    def entry(x: Column, at: Column) -> Column:
        i, j, k = F.floor(at / (ow * c)), F.pmod(F.floor(at / c), F.lit(ow)), F.pmod(at, F.lit(c))
        si, sj = source(i, j)
        value = F.get(x, (si * (w * c) + sj * c + k).cast("int"))
        return value if fill is None else F.when((si >= 0) & (si < h) & (sj >= 0) & (sj < w), value).otherwise(F.lit(fill))

    return bind(lambda x: F.transform(F.sequence(F.lit(0), F.lit(oh * ow * c - 1)), lambda at: entry(x, at)), x=x)


def flip_left_right(x: Column, h: int, w: int, c: int) -> Column:
    return gather(x, h, w, c, lambda i, j: (i, F.lit(w - 1) - j))


def flip_up_down(x: Column, h: int, w: int, c: int) -> Column:
    return gather(x, h, w, c, lambda i, j: (F.lit(h - 1) - i, j))


def rot90(x: Column, h: int, w: int, c: int, k: int = 1) -> Column:
    """k quarter turns against the clock."""
    k %= 4
    if k == 0:
        return x
    if k == 2:
        return gather(x, h, w, c, lambda i, j: (F.lit(h - 1) - i, F.lit(w - 1) - j))
    if k == 1:
        return gather(x, h, w, c, lambda i, j: (j, F.lit(w - 1) - i), w, h)
    return gather(x, h, w, c, lambda i, j: (F.lit(h - 1) - j, i), w, h)


def crop(x: Column, h: int, w: int, c: int, top: int | Column, left: int | Column, out_h: int, out_w: int) -> Column:
    out_h, out_w = min(out_h, h), min(out_w, w)
    top, left = (F.lit(v) if isinstance(v, int) else v for v in (top, left))
    return bind(lambda t, l: gather(x, h, w, c, lambda i, j: (i + t, j + l), out_h, out_w), t=top, l=left)


def center_crop(x: Column, h: int, w: int, c: int, out_h: int, out_w: int) -> Column:
    out_h, out_w = min(out_h, h), min(out_w, w)
    return crop(x, h, w, c, (h - out_h) // 2, (w - out_w) // 2, out_h, out_w)


def patch_dropout(x: Column, h: int, w: int, c: int, corners: list[tuple[Column, Column]], ph: int, pw: int, fill: float = 0.0) -> Column:
    """Patches of ph x pw at the given corners set to ``fill``; images smaller than a patch stay."""
    if ph > h or pw > w:
        return x

    def cut(**at: Column) -> Column:
        def entry(v: Column, place: Column) -> Column:
            i, j = F.floor(place / (w * c)), F.pmod(F.floor(place / c), F.lit(w))
            hit = F.lit(False)
            for k in range(len(corners)):
                top, left = at[f"top{k}"], at[f"left{k}"]
                hit = hit | ((i >= top) & (i < top + ph) & (j >= left) & (j < left + pw))
            return F.when(hit, F.lit(fill)).otherwise(v)

        return F.transform(x, entry)

    return bind(cut, **{f"{name}{k}": v for k, corner in enumerate(corners) for name, v in zip(("top", "left"), corner)}) if corners else x


def entry_draw(idx: Column, i: Column, tag: str, seed: int, draw: Callable[..., Column] = keyed.fast_uniform) -> Column:
    return draw(idx * 1_048_576 + i, tag, seed)


def gaussian_noise(x: Column, idx: Column, sigma: float = 0.05, mu: float = 0.0, tag: str = "noise", seed: int = 0, draw: Callable[..., Column] = keyed.fast_uniform) -> Column:
    """One normal an entry, keyed by (index, place)."""
    return F.transform(x, lambda v, i: v + mu + sigma * keyed.normal(idx * 1_048_576 + i, tag, seed, draw))


def salt_pepper(x: Column, idx: Column, salt: float = 0.01, pepper: float = 0.01, high: float | None = None, tag: str = "saltpepper", seed: int = 0, draw: Callable[..., Column] = keyed.fast_uniform) -> Column:
    """An entry becomes ``high`` with chance ``salt``, 0 with chance ``pepper``; high is 255 or 1 by the array's range where not given."""
    top = F.lit(high) if high is not None else F.when(F.array_max(x) > 1.5, 255.0).otherwise(1.0)

    def entry(v: Column, u: Column, top: Column) -> Column:
        return F.when(u < salt, top).when(u < salt + pepper, F.lit(0.0)).otherwise(v)

    return bind(lambda top: F.transform(x, lambda v, i: bind(lambda u: entry(v, u, top), u=entry_draw(idx, i, tag, seed, draw))), top=top)


def dropout(x: Column, idx: Column, rate: float = 0.1, channels: int | None = None, tag: str = "dropout", seed: int = 0, draw: Callable[..., Column] = keyed.fast_uniform) -> Column:
    """Entries, or whole channels (last axis), set to 0 with chance ``rate``; the rest is not scaled."""
    place = (lambda i: F.pmod(i, F.lit(channels))) if channels else (lambda i: i)
    return F.transform(x, lambda v, i: F.when(entry_draw(idx, place(i), tag, seed, draw) >= rate, v).otherwise(F.lit(0.0)))


def solarize(x: Column, threshold: float | Column) -> Column:
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    return bind(lambda t: F.transform(x, lambda v: F.when(v >= t, 1.0 - v).otherwise(v)), t=t)


def pad_to_multiple(x: Column, multiple: int = 128) -> Column:
    """Zeros at the end, up to the next multiple."""
    return F.concat(x, F.array_repeat(F.lit(0), F.pmod(-F.size(x), F.lit(multiple))))


def attention_mask(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: (t != 0).cast("float"))


def causal_mask(n: Column) -> Column:
    """n x n, 1 where the column is not after the row."""
    r = F.sequence(F.lit(0), n - 1)
    return F.transform(r, lambda i: F.transform(r, lambda j: (j <= i).cast("float")))


def hash_tokens(text: Column, vocabulary: int) -> Column:
    """crc32 of each word, modulo the vocabulary."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(vocabulary)))


def fixed_length(tokens: Column, n: int) -> Column:
    """Cut or padded with zeros to n entries."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(0).cast("long"), n)), 1, n)


def max_pool(x: Column, size: int, stride: int | None = None) -> Column:
    """Maxima of whole windows."""
    stride = stride or size
    n = F.floor((F.size(x) - size) / stride).cast("int")
    return F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), n), lambda i: F.array_max(F.slice(x, i * stride + 1, size)))).otherwise(F.slice(x, 1, 0))


def frames(x: Column, size: int, hop: int) -> Column:
    """Windows of ``size`` entries, ``hop`` apart; whole ones only."""
    n = F.floor((F.size(x) - size) / hop).cast("int")
    return F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(x, i * hop + 1, size)))
