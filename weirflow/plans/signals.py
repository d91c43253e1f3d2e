"""Registered queries over images and waves made of whole embeddings, with DuckDB SQL for the same rows.

An embedding of 64 entries gives an image of 8 x 8 pixels in [0, 1]: its entries, moved by a half and clipped, are the
red channel, the same entries from the end the green one, and one less each the blue one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import arrays, audio, image, keyed
from weirflow.operators import augment, batching
from weirflow.operators.base import IDX
from weirflow.operators.compose import Sequential
from weirflow.plans.catalog import query
from weirflow.sources.indexed import with_index

U = keyed.uniform_sql
SHAPE = (8, 8, 3)
SEED = 6

_PIX = """(SELECT vec_id, flatten(list_transform(range(64), lambda q: [y[q + 1], y[64 - q], 1.0 - y[q + 1]])) AS x
FROM (SELECT vec_id, list_transform(embedding, lambda v: greatest(0.0, least(1.0, CAST(v AS DOUBLE) + 0.5))) AS y FROM embeddings))"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return with_index(spark.read.parquet(f"{d}/embeddings.parquet"), dense="vec_id").select(IDX, F.col("embedding").cast("array<double>").alias("x"), "label")


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select(IDX, arrays.clip(F.transform("x", lambda v: v + 0.5)).alias("y"))
    rgb = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda q: F.array(F.get("y", q), F.get("y", F.lit(63) - q), F.lit(1.0) - F.get("y", q)))
    return v.select(IDX, F.flatten(rgb).alias("image"))


def _places(df: DataFrame, places: int = 5) -> DataFrame:
    # outer, for Spark puts a filter on the size of an exploded column below the explosion, and would make the image twice
    entries = df.select(F.col(IDX).alias("i"), F.posexplode_outer("image").alias("place", "v")).where(F.col("place").isNotNull())
    return entries.select("i", "place", (F.round("v", places) + 0.0).alias("v"))


def _image_sql(expression: str, size: int = 192) -> str:
    """The expression at every place p of an image x: row p // 24, column p % 24 // 3, channel p % 3."""
    return f"SELECT vec_id AS i, CAST(p AS INTEGER) AS place, round({expression}, 5) + 0.0 AS v FROM {_PIX}, range({size}) t(p)"


def _draw(what: int | str = 0, idx: str = "vec_id", stream: str = "augment") -> str:
    return U(idx, f"{stream}/{what}", SEED)


def _between(u: str, lo: float, hi: float) -> str:
    return f"({lo!r} + {u} * {hi - lo!r})"


def _clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def _register(name: str, sql: str | None, change, places: int = 5) -> None:
    """A query of ``change`` (an operator on ``image``, or a function of the column) over all images."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        px = _pixels(spark, d)
        return _places(px.withColumn("image", change(F.col("image"))) if not hasattr(change, "apply") else change(px), places)

    run.__name__ = name
    query(sql)(run)


# ------------------------------------------------------------------ pointwise

_register("image_brightness", _image_sql(_clip("x[p + 1] * 1.3 + 0.1")), lambda c: arrays.brightness(c, 1.3, 0.1))
_register("image_random_brightness", _image_sql(_clip(f"x[p + 1] * 1.0 + {_between(_draw(), -0.2, 0.2)}")), augment.Brightness(shape=SHAPE, seed=SEED))
_register("image_contrast", _image_sql(_clip("list_avg(x) + 1.5 * (x[p + 1] - list_avg(x))")), lambda c: arrays.contrast(c, 1.5))
_register("image_random_contrast", _image_sql(_clip(f"list_avg(x) + {_between(_draw(), 0.8, 1.2)} * (x[p + 1] - list_avg(x))")), augment.Contrast(shape=SHAPE, seed=SEED))
_register("image_random_scale", _image_sql(f"x[p + 1] * {_between(_draw(), 0.8, 1.2)}"), augment.Scale(shape=SHAPE, seed=SEED))
_LUMA = "0.299 * x[3 * {q} + 1] + 0.587 * x[3 * {q} + 2] + 0.114 * x[3 * {q} + 3]"
_register("image_grayscale", _image_sql(_LUMA.format(q="p"), 64), lambda c: arrays.grayscale(c))
_register("image_random_grayscale", _image_sql(f"CASE WHEN {_draw()} < 0.2 THEN {_LUMA.format(q='(p // 3)')} ELSE x[p + 1] END"), augment.Grayscale(shape=SHAPE, seed=SEED))
_register(
    "image_normalize",
    _image_sql("(x[p + 1] - CASE p % 3 WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END) / CASE p % 3 WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END"),
    lambda c: arrays.normalize(c, [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]),
)
_register("image_solarize", _image_sql(f"CASE WHEN x[p + 1] >= {_between(_draw(), 0.5, 1.0)} THEN 1.0 - x[p + 1] ELSE x[p + 1] END"), augment.Solarize(shape=SHAPE, seed=SEED))
_register("image_bytes_to_unit", _image_sql("CAST(CAST(floor(x[p + 1] * 255) AS DOUBLE) / 255.0 AS FLOAT)"), lambda c: arrays.to_unit(F.transform(c, lambda v: F.floor(v * 255).cast("int"))))
_CHANNEL = "x[p + 1] * CASE p % 3 WHEN 0 THEN 1.1 WHEN 1 THEN 0.9 ELSE 1.0 END + CASE p % 3 WHEN 1 THEN 0.1 ELSE 0.0 END"
_ENTRY = "vec_id * 1048576 + {place}"
_register(
    "image_channel_affine",
    _image_sql(f"CASE WHEN {U(_ENTRY.format(place='p'), 'augment', SEED)} >= 0.1 THEN {_CHANNEL} ELSE 0.0 END"),
    augment.ChannelAffine(shape=SHAPE, scales=(1.1, 0.9, 1.0), shifts=(0.0, 0.1, 0.0), rate=0.1, exact=True, seed=SEED),
)

# ------------------------------------------------------------------ noise and dropout, a draw an entry

_AT = _ENTRY.format(place="p")
_NORMAL = f"sqrt(-2.0 * ln(1.0 - {U(_AT, 'augment/r', SEED)})) * cos({2 * math.pi!r} * {U(_AT, 'augment/a', SEED)})"
_register("image_noise", _image_sql(f"x[p + 1] + 0.0 + 0.05 * {_NORMAL}"), augment.Noise(shape=SHAPE, exact=True, seed=SEED))
_SP = U(_AT, "augment", SEED)
_register(
    "image_salt_pepper",
    _image_sql(f"CASE WHEN {_SP} < 0.01 THEN (CASE WHEN list_max(x) > 1.5 THEN 255.0 ELSE 1.0 END) WHEN {_SP} < 0.02 THEN 0.0 ELSE x[p + 1] END"),
    augment.Noise(shape=SHAPE, kind="salt_pepper", exact=True, seed=SEED),
)
_register("image_dropout", _image_sql(f"CASE WHEN {U(_AT, 'augment', SEED)} >= 0.1 THEN x[p + 1] ELSE 0.0 END"), augment.Dropout(shape=SHAPE, exact=True, seed=SEED))
_register("image_channel_dropout", _image_sql(f"CASE WHEN {U(_ENTRY.format(place='p % 3'), 'augment', SEED)} >= 0.1 THEN x[p + 1] ELSE 0.0 END"), augment.Dropout(shape=SHAPE, by_channel=True, exact=True, seed=SEED))
#: Poisson counts come from a generator of their own, which SQL has not.
_register("image_poisson", None, augment.Noise(shape=SHAPE, kind="poisson", seed=SEED))
_PATCH = " OR ".join(
    f"(p // 24 >= floor({_draw(f'top{k}')} * 6) AND p // 24 < floor({_draw(f'top{k}')} * 6) + 3 AND p % 24 // 3 >= floor({_draw(f'left{k}')} * 6) AND p % 24 // 3 < floor({_draw(f'left{k}')} * 6) + 3)"
    for k in range(4)
)
_register("image_patch_dropout", _image_sql(f"CASE WHEN {_PATCH} THEN 0.0 ELSE x[p + 1] END"), augment.PatchDropout(shape=SHAPE, size=(3, 3), seed=SEED))

# ------------------------------------------------------------------ moved pixels

_LR, _UD = "x[(p // 24) * 24 + (7 - p % 24 // 3) * 3 + p % 3 + 1]", "x[(7 - p // 24) * 24 + p % 24 + 1]"
_register("image_flip", _image_sql(_LR), lambda c: arrays.flip_left_right(c, *SHAPE))
_register("image_flip_up_down", _image_sql(_UD), lambda c: arrays.flip_up_down(c, *SHAPE))
_register("image_random_flip", _image_sql(f"CASE WHEN {_draw()} < 0.5 THEN {_LR} ELSE x[p + 1] END"), augment.Flip(shape=SHAPE, seed=SEED))
_register("image_random_flip_up_down", _image_sql(f"CASE WHEN {_draw()} < 0.5 THEN {_UD} ELSE x[p + 1] END"), augment.Flip(shape=SHAPE, vertical=True, seed=SEED))
_register("image_center_crop", _image_sql("x[(p // 12 + 2) * 24 + (p % 12 // 3 + 2) * 3 + p % 3 + 1]", 48), lambda c: arrays.center_crop(c, *SHAPE, 4, 4))
_TOP, _LEFT = (f"CAST(least(floor({_draw(w)} * 4), 3) AS BIGINT)" for w in ("top", "left"))
_register("image_random_crop", _image_sql(f"x[(p // 15 + {_TOP}) * 24 + (p % 15 // 3 + {_LEFT}) * 3 + p % 3 + 1]", 75), augment.Crop(shape=SHAPE, out=(5, 5), seed=SEED))
_register(
    "image_random_crop_padded",
    _image_sql(f"CASE WHEN p // 24 < 5 AND p % 24 // 3 < 5 THEN x[(p // 24 + {_TOP}) * 24 + (p % 24 // 3 + {_LEFT}) * 3 + p % 3 + 1] ELSE 0.0 END"),
    augment.Crop(shape=SHAPE, out=(5, 5), pad=True, seed=SEED),
)
_TURN = f"least(floor({_draw()} * 4), 3)"
_register(
    "image_quarter_turns",
    _image_sql(f"CASE {_TURN} WHEN 0 THEN x[p + 1] WHEN 1 THEN x[(p % 24 // 3) * 24 + (7 - p // 24) * 3 + p % 3 + 1] WHEN 2 THEN x[(7 - p // 24) * 24 + (7 - p % 24 // 3) * 3 + p % 3 + 1] ELSE x[(7 - p % 24 // 3) * 24 + (p // 24) * 3 + p % 3 + 1] END"),
    augment.QuarterTurns(shape=SHAPE, seed=SEED),
)

# ------------------------------------------------------------------ resampling


def _rotation_sql(angle: str) -> str:
    at = lambda i, j: f"x[{i} * 24 + {j} * 3 + p % 3 + 1]"
    return f"""WITH a AS (SELECT vec_id, x, p, {angle} AS a, p // 24 - 4.0 AS di, p % 24 // 3 - 4.0 AS dj FROM {_PIX}, range(192) t(p)),
s AS (SELECT *, di * cos(a) - dj * sin(a) + 4.0 AS si, di * sin(a) + dj * cos(a) + 4.0 AS sj FROM a),
g AS (SELECT *, si >= 0 AND si <= 7 AND sj >= 0 AND sj <= 7 AS inside, greatest(0.0, least(7.0, si)) AS ci, greatest(0.0, least(7.0, sj)) AS cj FROM s),
f AS (SELECT *, CAST(least(floor(ci), 6) AS BIGINT) AS i0, CAST(least(floor(cj), 6) AS BIGINT) AS j0 FROM g),
w AS (SELECT *, ci - i0 AS fa, cj - j0 AS fb FROM f)
SELECT vec_id AS i, CAST(p AS INTEGER) AS place, round(CASE WHEN inside THEN (1 - fa) * ((1 - fb) * {at('i0', 'j0')} + fb * {at('i0', '(j0 + 1)')}) + fa * ((1 - fb) * {at('(i0 + 1)', 'j0')} + fb * {at('(i0 + 1)', '(j0 + 1)')}) ELSE 0.0 END, 5) + 0.0 AS v FROM w"""


_register("image_rotation", _rotation_sql(f"{_between(_draw(), -15.0, 15.0)} * {math.pi / 180!r}"), augment.Rotation(shape=SHAPE, seed=SEED))
_register("image_rotation_fixed", _rotation_sql(repr(30.0 * (math.pi / 180))), augment.Rotation(shape=SHAPE, bounds=(20.0, 40.0), random=False, seed=SEED))


def _tap(o: str, s: str, n: int, out: int) -> str:
    """Weight of entry ``s`` of n for entry ``o`` of out, not yet normalised."""
    return f"greatest(0.0, 1.0 - abs((({o} + 0.5) * {n / out!r} - 0.5 - {s}) / {max(n / out, 1.0)!r}))"


def _resize_sql(source: str, n: int, out: int, at: str = "{i} * {row} + {j} * 3 + p % 3 + 1") -> str:
    """Expression of a square resized from n to out, at place p of the result."""
    row, col = f"(p // {out * 3})", f"(p % {out * 3} // 3)"
    wi, wj = _tap(row, "u // " + str(n), n, out), _tap(col, f"u % {n}", n, out)
    value = f"{source}[{at.format(i=f'(u // {n})', j=f'(u % {n})', row=n * 3)}]"
    total = f"list_sum(list_transform(range({n * n}), lambda u: {wi} * {wj}))"
    return f"(list_sum(list_transform(range({n * n}), lambda u: {wi} * {wj} * {value})) / {total})"


_register("image_resize", _image_sql(_resize_sql("x", 8, 12), 432), lambda c: image.over(image.resize, SHAPE, h=12, w=12)(c))
_register("image_resize_down", _image_sql(_resize_sql("x", 8, 4), 48), lambda c: image.over(image.resize, SHAPE, h=4, w=4)(c))
_register("image_resize_nearest", _image_sql("x[CAST(floor((p // 15 + 0.5) * 1.6) AS BIGINT) * 24 + CAST(floor((p % 15 // 3 + 0.5) * 1.6) AS BIGINT) * 3 + p % 3 + 1]", 75), lambda c: image.over(image.resize, SHAPE, h=5, w=5, method="nearest")(c))
_register(
    "image_multiscale",
    f"""WITH h AS (SELECT vec_id, list(v ORDER BY p) AS z FROM (SELECT vec_id, p, {_resize_sql('x', 8, 4)} AS v FROM {_PIX}, range(48) t(p)) GROUP BY vec_id)
SELECT vec_id AS i, CAST(p AS INTEGER) AS place, round({_resize_sql('z', 4, 8)}, 5) + 0.0 AS v FROM h, range(192) t(p)""",
    lambda c: image.over(image.resize, (4, 4, 3), h=8, w=8)(image.over(image.resize, SHAPE, h=4, w=4)(c)),
)
_CT, _CL = (f"CAST(floor({_draw(w)} * 3) AS BIGINT)" for w in ("top", "left"))
_register(
    "image_resized_crop",
    f"""WITH c AS (SELECT vec_id, {_CT} AS top, {_CL} AS lft, x FROM {_PIX}),
k AS (SELECT vec_id, list(x[(q // 18 + top) * 24 + (q % 18 // 3 + lft) * 3 + q % 3 + 1] ORDER BY q) AS z FROM c, range(108) t(q) GROUP BY vec_id)
SELECT vec_id AS i, CAST(p AS INTEGER) AS place, round({_resize_sql('z', 6, 8)}, 5) + 0.0 AS v FROM k, range(192) t(p)""",
    augment.ResizedCrop(shape=SHAPE, seed=SEED),
)
_SIGMA = _between(_draw(), 0.1, 2.0)
_GAUSS = "exp(-(({o}) * ({o})) / (2.0 * sigma * sigma))"
_NORM = "(1.0 + 2.0 * " + _GAUSS.format(o="1.0") + " + 2.0 * " + _GAUSS.format(o="2.0") + ")"
_register(
    "image_blur",
    f"""WITH s AS (SELECT vec_id, x, {_SIGMA} AS sigma FROM {_PIX})
SELECT vec_id AS i, CAST(p AS INTEGER) AS place, round(list_sum(list_transform(range(25), lambda u: {_GAUSS.format(o='u // 5 - 2.0')} * {_GAUSS.format(o='u % 5 - 2.0')}
* x[least(7, greatest(0, p // 24 + u // 5 - 2)) * 24 + least(7, greatest(0, p % 24 // 3 + u % 5 - 2)) * 3 + p % 3 + 1])) / ({_NORM} * {_NORM}), 5) + 0.0 AS v FROM s, range(192) t(p)""",
    augment.Blur(shape=SHAPE, seed=SEED),
)

# ------------------------------------------------------------------ colour spaces, in steps over pixels

_RGB = f"SELECT vec_id, q, x[3 * q + 1] AS r, x[3 * q + 2] AS g, x[3 * q + 3] AS b FROM {_PIX}, range(64) t(q)"
_HI, _LO = "greatest(r, g, b)", "least(r, g, b)"


def _to_hsv(source: str) -> str:
    """h in radians, s and v of a table of r, g and b."""
    d = f"({_HI} - {_LO})"
    red = f"(g - b) / {d}"
    sector = f"CASE WHEN {d} = 0 THEN 0 WHEN {_HI} = r THEN (CASE WHEN {red} < 0 THEN {red} + 6 ELSE {red} END) WHEN {_HI} = g THEN (b - r) / {d} + 2 ELSE (r - g) / {d} + 4 END"
    return f"SELECT *, {sector} * {math.pi / 3!r} AS h, CASE WHEN {_HI} > 0 THEN {d} / {_HI} ELSE 0 END AS s, {_HI} AS v FROM ({source})"


def _from_hsv(source: str, h: str = "h", s: str = "s") -> str:
    def channel(n: float) -> str:
        k = f"fmod({n} + ({h}) / {math.pi / 3!r}, 6)"
        return _clip(f"v * (1 - ({s}) * {_clip(f'least({k}, 4 - {k})')})")

    return f"SELECT * EXCLUDE (r, g, b, h, s, v), {channel(5.0)} AS r, {channel(3.0)} AS g, {channel(1.0)} AS b FROM ({source})"


def _of_pixels(source: str, names: str = "rgb") -> str:
    columns = " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(names))
    return f"SELECT vec_id AS i, CAST(3 * q + c AS INTEGER) AS place, round(CASE c {columns} END, 5) + 0.0 AS v FROM ({source}), range(3) t(c)"


def _turned(delta: str) -> str:
    return f"fmod(h + {delta} + {2 * math.pi!r}, {2 * math.pi!r})"


_register("image_hsv", _of_pixels(_to_hsv(_RGB), "hsv"), lambda c: image.over(image.rgb_to_hsv, SHAPE)(c))
_register("image_hsv_and_back", _of_pixels(_from_hsv(_to_hsv(_RGB))), lambda c: image.over(lambda x: image.hsv_to_rgb(image.rgb_to_hsv(x)), SHAPE)(c))
_register("image_saturation", _of_pixels(_from_hsv(_to_hsv(_RGB), s=_clip("s * 1.4"))), lambda c: image.over(image.saturation, SHAPE)(c, F.lit(1.4)))
_register("image_hue", _of_pixels(_from_hsv(_to_hsv(_RGB), h=_turned("0.7"))), lambda c: image.over(image.hue, SHAPE)(c, F.lit(0.7)))


def _jitter_sql() -> str:
    b, c, s, h = _between(_draw("b"), 0.8, 1.2), _between(_draw("c"), 0.8, 1.2), _between(_draw("s"), 0.8, 1.2), _between(_draw("h"), -0.1, 0.1)
    each = lambda f: ", ".join(f"{f(k)} AS {k}" for k in "rgb")
    bright = f"SELECT vec_id, q, {each(lambda k: _clip(f'{k} * {b}'))} FROM ({_RGB})"
    mean = f"SELECT *, avg(r + g + b) OVER (PARTITION BY vec_id) / 3.0 AS m FROM ({bright})"
    contrast = f"SELECT vec_id, q, {each(lambda k: _clip(f'm + {c} * ({k} - m)'))} FROM ({mean})"
    return _of_pixels(_from_hsv(_to_hsv(_from_hsv(_to_hsv(contrast), s=_clip(f"s * {s}"))), h=_turned(h)))


_register("image_color_jitter", _jitter_sql(), augment.ColorJitter(shape=SHAPE, seed=SEED))

# ------------------------------------------------------------------ chains


def _deep(stream: str) -> Sequential:
    return Sequential(
        (augment.Flip(shape=SHAPE), augment.Brightness(shape=SHAPE), augment.Contrast(shape=SHAPE), augment.Scale(shape=SHAPE), augment.Solarize(shape=SHAPE)),
        seed=SEED,
        stream=stream,
    )


def _chain_sql(stream: str) -> str:
    u = lambda k: U("vec_id", f"{stream}/{k}/0", SEED)
    at = lambda x: f"flatten(list_transform(range(8), lambda a: flatten(list_transform(range(8), lambda b: {x}[a * 24 + (7 - b) * 3 + 1 : a * 24 + (7 - b) * 3 + 3]))))"
    return f"""WITH a AS (SELECT vec_id, CASE WHEN {u(0)} < 0.5 THEN {at('x')} ELSE x END AS x, {_between(u(1), -0.2, 0.2)} AS d, {_between(u(2), 0.8, 1.2)} AS c, {_between(u(3), 0.8, 1.2)} AS s, {_between(u(4), 0.5, 1.0)} AS t FROM {_PIX}),
b AS (SELECT * EXCLUDE (x), list_transform(x, lambda v: greatest(0.0, least(1.0, v * 1.0 + d))) AS x FROM a),
m AS (SELECT *, list_avg(x) AS m FROM b),
f AS (SELECT vec_id, t, p, greatest(0.0, least(1.0, m + c * (x[p + 1] - m))) * s AS v FROM m, range(192) r(p))
SELECT vec_id AS i, CAST(p AS INTEGER) AS place, round(CASE WHEN v >= t THEN 1.0 - v ELSE v END, 5) + 0.0 AS v FROM f"""


@query(_chain_sql("chain"))
def image_chain(spark: SparkSession, d: str) -> DataFrame:
    """Five keyed operators in one chain."""
    return _places(_deep("chain")(_pixels(spark, d)))


# ------------------------------------------------------------------ mixing inside batches

_BATCH = f"""WITH b AS (SELECT vec_id AS i, vec_id // 64 AS batch_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, CAST(label AS DOUBLE) AS y, {U('vec_id', 'mix/perm', 1)} AS u FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY i) AS k, row_number() OVER (PARTITION BY batch_id ORDER BY u, i) AS r, count(*) OVER (PARTITION BY batch_id) AS n FROM b),
p AS (SELECT a.i, a.batch_id, a.x, a.y, o.x AS ox, o.y AS oy, CASE WHEN a.n < 2 THEN 1.0 ELSE {U('a.batch_id', 'mix/lambda', 1)} END AS lam FROM k a JOIN k o ON a.batch_id = o.batch_id AND a.k = o.r)
"""


def _batches(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return batching.Batcher(64).assign(v, v.count()).select(IDX, "batch_id", "x", F.col("label").cast("double").alias("y"))


@query(f"{_BATCH} SELECT i, CAST(q AS INTEGER) AS place, round(ox[q + 1] + lam * (x[q + 1] - ox[q + 1]), 6) + 0.0 AS v, round(oy + lam * (y - oy), 6) AS y FROM p, range(64) t(q)")
def mixup_arrays(spark: SparkSession, d: str) -> DataFrame:
    m = augment.mixup(_batches(spark, d), ["x", "y"], seed=1)
    return m.select(F.col(IDX).alias("i"), F.round("y", 6).alias("y"), F.posexplode("x").alias("place", "v")).select("i", "place", (F.round("v", 6) + 0.0).alias("v"), "y")


_CUT = f"""c AS (SELECT *, floor(sqrt(1.0 - lam) * 8) AS ph, least(floor({U('batch_id', 'mix/y', 1)} * 8), 7) AS cy, least(floor({U('batch_id', 'mix/x', 1)} * 8), 7) AS cx FROM p),
e AS (SELECT *, greatest(0, least(8, cy - floor(ph / 2))) AS t, greatest(0, least(8, cy + floor(ph / 2))) AS b, greatest(0, least(8, cx - floor(ph / 2))) AS l, greatest(0, least(8, cx + floor(ph / 2))) AS r FROM c),
f AS (SELECT *, 1.0 - (b - t) * (r - l) / 64 AS kept FROM e)"""


@query(f"{_BATCH}, {_CUT} SELECT i, CAST(q AS INTEGER) AS place, round(CASE WHEN q // 8 >= t AND q // 8 < b AND q % 8 >= l AND q % 8 < r THEN ox[q + 1] ELSE x[q + 1] END, 6) + 0.0 AS v, round(oy + kept * (y - oy), 6) AS y, kept AS lam FROM f, range(64) u(q)")
def cutmix_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel after the partner's patch is pasted."""
    m = augment.cutmix(_batches(spark, d), ["x"], ["y"], (8, 8, 1), seed=1)
    return m.select(F.col(IDX).alias("i"), "lam", F.round("y", 6).alias("y"), F.posexplode("x").alias("place", "v")).select("i", "place", (F.round("v", 6) + 0.0).alias("v"), "y", "lam")


# ------------------------------------------------------------------ audio

_FFT, _HOP = 32, 16


def _db(hz2: str) -> str:
    a, b, c, d = (x * x for x in audio.A_CORNERS)
    return f"(2.0 + 20.0 * log10(greatest(({hz2} * {hz2} * {d!r}) / (({hz2} + {a!r}) * sqrt(({hz2} + {b!r}) * ({hz2} + {c!r})) * ({hz2} + {d!r})), 1e-20)))"


@query(
    f"""WITH w AS (SELECT vec_id, list_transform(range({64 + _FFT}), lambda p: CASE WHEN p >= {_FFT // 2} AND p < {64 + _FFT // 2} THEN CAST(embedding[p - {_FFT // 2} + 1] AS DOUBLE) ELSE 0.0 END) AS x FROM embeddings),
f AS (SELECT vec_id, fr, list_transform(range({_FFT}), lambda k: x[fr * {_HOP} + k + 1] * (0.5 - 0.5 * cos({2 * math.pi!r} * k / {_FFT}))) AS y FROM w, range({64 // _HOP}) t(fr)),
s AS (SELECT vec_id, fr, bin, pow(list_sum(list_transform(range({_FFT}), lambda k: y[k + 1] * cos({2 * math.pi!r} * bin * k / {_FFT}))), 2) + pow(list_sum(list_transform(range({_FFT}), lambda k: y[k + 1] * sin({2 * math.pi!r} * bin * k / {_FFT}))), 2) AS power,
greatest(pow(bin * {16000 / _FFT!r}, 2), 1e-18) AS q FROM f, range({_FFT // 2 + 1}) u(bin)),
d AS (SELECT vec_id, fr, 10 * log10(avg(pow(10.0, (10 * log10(greatest(power, 1e-20)) + {_db('q')}) / 10))) - 20.7 AS level FROM s GROUP BY vec_id, fr)
SELECT vec_id AS i, CAST(fr AS INTEGER) AS place, round(greatest(level, -80.0), 4) + 0.0 AS v FROM d"""
)
def audio_loudness(spark: SparkSession, d: str) -> DataFrame:
    w = _vectors(spark, d).select(IDX, audio.loudness(F.col("x"), n_fft=_FFT, hop=_HOP).alias("image"))
    return _places(w, 4)


_STEP = f"({audio.CENTS_FIRST!r} + {{k}} * {audio.CENTS_STEP!r})"


@query(
    f"""WITH a AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)) + 1e-6) AS a FROM embeddings),
b AS (SELECT *, list_position(a, list_max(a)) - 1 AS best, list_sum(a) AS total, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM a),
c AS (SELECT *, range(greatest(0, best - 4), least(len(a) - 1, best + 4) + 1) AS near FROM b)
SELECT vec_id AS i,
round(10.0 * pow(2.0, list_sum(list_transform(near, lambda k: a[k + 1] * {_STEP.format(k='k')})) / list_sum(list_transform(near, lambda k: a[k + 1])) / 1200.0), 4) AS hz,
round(10.0 * pow(2.0, list_sum(list_transform(range(len(e)), lambda k: e[k + 1] * {_STEP.format(k='k')})) / list_sum(e) / 1200.0), 4) AS soft,
round(1.0 + list_sum(list_transform(a, lambda v: v / total * ln(v / total))) / ln(len(a)), 5) AS confidence FROM c"""
)
def audio_pitch(spark: SparkSession, d: str) -> DataFrame:
    a = F.transform("x", lambda v: F.abs(v) + 1e-6)
    v = _vectors(spark, d)
    return v.select(F.col(IDX).alias("i"), F.round(audio.pitch(a), 4).alias("hz"), F.round(audio.pitch_soft(F.col("x")), 4).alias("soft"), F.round(audio.confidence(a), 5).alias("confidence"))


def frames_of(x: Column) -> Column:
    return arrays.frames(x, 16, 8)


@query("SELECT vec_id AS i, CAST(f AS INTEGER) AS frame, round(list_sum(list_transform(embedding[f * 8 + 1 : f * 8 + 16], lambda v: CAST(v AS DOUBLE))), 5) + 0.0 AS total FROM embeddings, range(7) t(f)")
def audio_frames(spark: SparkSession, d: str) -> DataFrame:
    f = _vectors(spark, d).select(F.col(IDX).alias("i"), F.posexplode(frames_of(F.col("x"))).alias("frame", "w"))
    return f.select("i", "frame", (F.round(F.aggregate("w", F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("total"))
