"""Random augmentation of array fields: parameters are keyed draws of the record."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import arrays, image, keyed

from .base import IDX, Operator, Record


@dataclass(frozen=True)
class ArrayOp(Operator):
    """Base of operators on one array field of a given shape [H, W, C]."""

    name: str = "image"
    shape: tuple[int, int, int] = (32, 32, 3)
    seed: int = 0
    stream: str = "augment"
    stochastic = True

    def change(self, x: Column, r: Record) -> Column:
        raise NotImplementedError

    def apply(self, r: Record) -> Record:
        return r.with_fields(**{self.name: self.change(r.fields[self.name], r)})


@dataclass(frozen=True)
class Brightness(ArrayOp):
    """x + d with d uniform in ``bounds``, clipped; a given ``delta`` makes it deterministic."""

    bounds: tuple[float, float] = (-0.2, 0.2)
    delta: float | None = None
    clip: tuple[float, float] = (0.0, 1.0)

    def change(self, x: Column, r: Record) -> Column:
        return arrays.brightness(x, 1.0, F.lit(self.delta) if self.delta is not None else keyed.between(r.uniform(), *self.bounds), self.clip)


@dataclass(frozen=True)
class Contrast(ArrayOp):
    bounds: tuple[float, float] = (0.8, 1.2)
    factor: float | None = None
    clip: tuple[float, float] = (0.0, 1.0)

    def change(self, x: Column, r: Record) -> Column:
        return arrays.contrast(x, self.factor if self.factor is not None else keyed.between(r.uniform(), *self.bounds), self.clip)


@dataclass(frozen=True)
class Scale(ArrayOp):
    bounds: tuple[float, float] = (0.8, 1.2)

    def change(self, x: Column, r: Record) -> Column:
        return arrays.affine(x, keyed.between(r.uniform(), *self.bounds))


@dataclass(frozen=True)
class Noise(ArrayOp):
    """gaussian, salt_pepper or poisson."""

    kind: str = "gaussian"
    sigma: float = 0.05
    salt: float = 0.01
    pepper: float = 0.01
    exact: bool = False  # draws that SQL engines can repeat

    def change(self, x: Column, r: Record) -> Column:
        draw = keyed.uniform if self.exact else keyed.fast_uniform
        if self.kind == "gaussian":
            return arrays.gaussian_noise(x, r.idx, self.sigma, tag=r.tag, seed=r.seed, draw=draw)
        if self.kind == "salt_pepper":
            return arrays.salt_pepper(x, r.idx, self.salt, self.pepper, tag=r.tag, seed=r.seed, draw=draw)
        if self.kind == "poisson":
            return image.over(image.poisson_noise, self.shape)(x, F.xxhash64(F.lit(r.seed), F.lit(r.tag), r.idx))
        raise ValueError(f"no noise {self.kind!r}")


@dataclass(frozen=True)
class Dropout(ArrayOp):
    rate: float = 0.1
    by_channel: bool = False
    exact: bool = False

    def change(self, x: Column, r: Record) -> Column:
        return arrays.dropout(x, r.idx, self.rate, self.shape[2] if self.by_channel else None, r.tag, r.seed, keyed.uniform if self.exact else keyed.fast_uniform)


@dataclass(frozen=True)
class PatchDropout(ArrayOp):
    patches: int = 4
    size: tuple[int, int] = (8, 8)
    fill: float = 0.0

    def change(self, x: Column, r: Record) -> Column:
        h, w, c = self.shape
        ph, pw = self.size
        if ph > h or pw > w:
            return x
        corners = [(keyed.integer(r.uniform(f"top{i}"), h - ph + 1), keyed.integer(r.uniform(f"left{i}"), w - pw + 1)) for i in range(self.patches)]
        return arrays.patch_dropout(x, h, w, c, corners, ph, pw, self.fill)


@dataclass(frozen=True)
class Flip(ArrayOp):
    """Left-right (or up-down) with chance p."""

    p: float = 0.5
    vertical: bool = False

    def change(self, x: Column, r: Record) -> Column:
        turned = (arrays.flip_up_down if self.vertical else arrays.flip_left_right)(x, *self.shape)
        return turned if self.p >= 1 else x if self.p <= 0 else F.when(r.uniform() < self.p, turned).otherwise(x)


@dataclass(frozen=True)
class Crop(ArrayOp):
    """A crop of out x out at a random place; ``pad`` puts it back into zeros of the old shape."""

    out: tuple[int, int] = (28, 28)
    pad: bool = False

    def change(self, x: Column, r: Record) -> Column:
        h, w, c = self.shape
        oh, ow = min(self.out[0], h), min(self.out[1], w)
        top, left = keyed.integer(r.uniform("top"), h - oh + 1), keyed.integer(r.uniform("left"), w - ow + 1)
        cropped = arrays.crop(x, h, w, c, top, left, oh, ow)
        return arrays.gather(cropped, oh, ow, c, lambda i, j: (i, j), h, w, fill=0.0) if self.pad else cropped


@dataclass(frozen=True)
class Grayscale(ArrayOp):
    p: float = 0.2

    def change(self, x: Column, r: Record) -> Column:
        gray = arrays.grayscale(x, keep_channels=True)
        return gray if self.p >= 1 else F.when(r.uniform() < self.p, gray).otherwise(x)


@dataclass(frozen=True)
class Solarize(ArrayOp):
    bounds: tuple[float, float] = (0.5, 1.0)

    def change(self, x: Column, r: Record) -> Column:
        return arrays.solarize(x, keyed.between(r.uniform(), *self.bounds))


@dataclass(frozen=True)
class QuarterTurns(ArrayOp):
    """0 to 3 quarter turns of a square image."""

    def change(self, x: Column, r: Record) -> Column:
        k = keyed.integer(r.uniform(), 4)
        turn = lambda x, i: arrays.rot90(x, *self.shape, i)
        return arrays.bind(lambda x, k: F.when(k == 0, x).when(k == 1, turn(x, 1)).when(k == 2, turn(x, 2)).otherwise(turn(x, 3)), x=x, k=k)


@dataclass(frozen=True)
class Rotation(ArrayOp):
    """Degrees uniform in ``bounds``; ``random`` false takes the middle."""

    bounds: tuple[float, float] = (-15.0, 15.0)
    fill: float = 0.0
    random: bool = True

    def change(self, x: Column, r: Record) -> Column:
        degrees = keyed.between(r.uniform(), *self.bounds) if self.random else F.lit(sum(self.bounds) / 2)
        return image.over(image.rotate, self.shape, fill=self.fill)(x, degrees * (math.pi / 180))


@dataclass(frozen=True)
class ColorJitter(ArrayOp):
    brightness: float = 0.2
    contrast: float = 0.2
    saturation: float = 0.2
    hue: float = 0.1

    def change(self, x: Column, r: Record) -> Column:
        near = lambda what, d: keyed.between(r.uniform(what), 1 - d, 1 + d)
        return image.over(image.jitter, self.shape)(x, near("b", self.brightness), near("c", self.contrast), near("s", self.saturation), keyed.between(r.uniform("h"), -self.hue, self.hue))


@dataclass(frozen=True)
class Blur(ArrayOp):
    bounds: tuple[float, float] = (0.1, 2.0)

    def change(self, x: Column, r: Record) -> Column:
        return image.over(image.blur, self.shape)(x, keyed.between(r.uniform(), *self.bounds))


@dataclass(frozen=True)
class ResizedCrop(ArrayOp):
    share: float = 0.75

    def change(self, x: Column, r: Record) -> Column:
        return image.over(image.resized_crop, self.shape, share=self.share)(x, r.uniform("top"), r.uniform("left"))


@dataclass(frozen=True)
class ChannelAffine(ArrayOp):
    """Scale and shift by channel, from parameters supplied, then dropout."""

    scales: tuple[float, ...] = (1.0, 1.0, 1.0)
    shifts: tuple[float, ...] = (0.0, 0.0, 0.0)
    rate: float = 0.0
    exact: bool = False

    def change(self, x: Column, r: Record) -> Column:
        s, b, n = F.array(*map(F.lit, self.scales)), F.array(*map(F.lit, self.shifts)), len(self.scales)
        y = F.transform(x, lambda v, i: v * F.get(s, F.pmod(i, F.lit(n))) + F.get(b, F.pmod(i, F.lit(n))))
        return arrays.dropout(y, r.idx, self.rate, None, r.tag, r.seed, keyed.uniform if self.exact else keyed.fast_uniform) if self.rate else y


def partner(df: DataFrame, names: list[str], seed: int = 0, tag: str = "mix") -> DataFrame:
    """``df`` (with batch_id) plus ``__other``, fields of the row that a keyed permutation of the batch puts here, and ``__n``, the batch's size.

    Row k of a batch is given the row whose draw has rank k. A batch's rows meet once, in order, and are paired by place:
    one shuffle, as many rows out as in.
    """
    columns = [c for c in df.columns if c != "batch_id"]
    rows = df.select("batch_id", F.struct(F.col(IDX).alias("i"), F.struct(*columns).alias("row")).alias("r"), F.struct(keyed.uniform(F.col(IDX), f"{tag}/perm", seed).alias("u"), F.col(IDX).alias("i"), F.struct(*names).alias("other")).alias("o"))
    batch = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list("r")).alias("r"), F.sort_array(F.collect_list("o")).alias("o"))
    pairs = F.zip_with("r", "o", lambda r, o: F.struct(r["row"].alias("row"), o["other"].alias("other")))
    d = batch.select("batch_id", F.size("r").alias("__n"), F.explode(pairs).alias("p"))
    return d.select("batch_id", "p.row.*", F.col("p.other").alias("__other"), "__n").select(*df.columns, "__other", "__n")


def beta(alpha: float, key: Column) -> Column:
    """Beta(alpha, alpha) keyed by a 64-bit column; one draw for each key."""

    @F.arrow_udf("double")
    def run(k: pa.Array) -> pa.Array:
        keys, where = np.unique(k.to_numpy(zero_copy_only=False), return_inverse=True)  # rows of a batch have one key
        draws = np.array([np.random.Generator(np.random.PCG64(int(v) % (1 << 64))).beta(alpha, alpha) for v in keys])
        return pa.array(draws[where])

    return run(key)


def lam(alpha: float, seed: int = 0, tag: str = "mix") -> Column:
    """The mixing weight of a batch, drawn once for it."""
    if alpha == 1.0:
        return keyed.uniform(F.col("batch_id"), f"{tag}/lambda", seed)
    return beta(alpha, F.xxhash64(F.lit(seed), F.lit(tag), F.col("batch_id")))


def mixup(df: DataFrame, names: list[str], alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """b + lambda (a - b) on scalar or array fields, b the partner in the batch; batches of one row stay."""
    d = partner(df, names, seed).withColumn("__lam", F.when(F.col("__n") < 2, 1.0).otherwise(lam(alpha, seed)))
    kinds = dict(df.dtypes)

    def mix(c: str) -> Column:
        a, b, w = F.col(c), F.col("__other").getField(c), F.col("__lam")
        return F.zip_with(a, b, lambda x, y: y + w * (x - y)) if kinds[c].startswith("array") else b + w * (a - b)

    return d.withColumns({c: mix(c) for c in names}).withColumnRenamed("__lam", "lam").drop("__other", "__n")


def cutmix_box(h: int, w: int, seed: int = 0, tag: str = "mix") -> tuple[Column, Column, Column, Column]:
    """(top, bottom, left, right) of a batch's patch: area 1 - lambda about a random centre, clipped to the image."""
    side = F.sqrt(F.lit(1.0) - F.col("__lam"))
    ph, pw = F.floor(side * h), F.floor(side * w)
    cy = keyed.integer(keyed.uniform(F.col("batch_id"), f"{tag}/y", seed), h)
    cx = keyed.integer(keyed.uniform(F.col("batch_id"), f"{tag}/x", seed), w)
    inside = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n), v))
    half = lambda v: F.floor(v / 2)
    return inside(cy - half(ph), h), inside(cy + half(ph), h), inside(cx - half(pw), w), inside(cx + half(pw), w)


def cutmix(df: DataFrame, images: list[str], labels: list[str], shape: tuple[int, int, int], alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """The partner's pixels inside the patch; labels by the share of the image that the clipped patch leaves."""
    h, w, c = shape
    d = partner(df, images + labels, seed).withColumn("__lam", F.when(F.col("__n") < 2, 1.0).otherwise(lam(alpha, seed)))
    d = d.withColumns(dict(zip(("__top", "__bottom", "__left", "__right"), cutmix_box(h, w, seed))))
    kept = F.lit(1.0) - (F.col("__bottom") - F.col("__top")) * (F.col("__right") - F.col("__left")) / F.lit(h * w)
    d = d.withColumn("lam", kept)

    def paste(n: str) -> Column:
        def entry(v: Column, at: Column) -> Column:  # the patch is columns of the row
            i, j = F.floor(at / (w * c)), F.pmod(F.floor(at / c), F.lit(w))
            hit = (i >= F.col("__top")) & (i < F.col("__bottom")) & (j >= F.col("__left")) & (j < F.col("__right"))
            return F.when(hit, F.get(F.col("__other").getField(n), at)).otherwise(v)

        return F.transform(n, entry)

    mixed = {n: paste(n) for n in images} | {n: F.col("__other").getField(n) + F.col("lam") * (F.col(n) - F.col("__other").getField(n)) for n in labels}
    return d.withColumns(mixed).drop("__other", "__n", "__lam", "__top", "__bottom", "__left", "__right")
