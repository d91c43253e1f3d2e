"""Keyed randomness: every draw is a function of (seed, tag, index), never of layout, order or batch size."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(1 << 52)


def uniform(idx: Column, tag: str | Column, seed: int = 0) -> Column:
    """A double in [0, 1): the first 52 bits of md5 of ``seed|tag|index``."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), tag, idx.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(TWO_52)


def uniform_sql(idx: str, tag: str, seed: int = 0) -> str:
    """DuckDB's form of :func:`uniform`, bit for bit."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{tag}', CAST({idx} AS VARCHAR))), 1, 13) AS BIGINT) / {TWO_52!r})"


def fast_uniform(idx: Column, tag: str | Column, seed: int = 0) -> Column:
    """A double in [0, 1) from 52 bits of xxhash64: for one draw per array entry, where md5 would dominate."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    bits = F.xxhash64(F.lit(seed), tag, idx)
    return F.shiftrightunsigned(bits, 12) / F.lit(TWO_52)


def between(u: Column, lo: float, hi: float) -> Column:
    return F.lit(lo) + u * F.lit(hi - lo)


def normal(idx: Column, tag: str, seed: int = 0, draw=uniform) -> Column:
    """A standard normal by Box-Muller from two uniforms."""
    u, v = draw(idx, f"{tag}/r", seed), draw(idx, f"{tag}/a", seed)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def integer(u: Column, n: int | Column) -> Column:
    """An integer in [0, n) from a uniform."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor(u * n), (n - 1).cast("long")).cast("long")


def pick(u: Column, weights: list[float]) -> Column:
    """The number of the interval of cumulated, normalised weights that ``u`` falls into."""
    total, acc = float(sum(weights)), 0.0
    out = F.lit(len(weights) - 1)
    bounds = []
    for w in weights[:-1]:
        acc += w
        bounds.append(acc / total)
    for i in reversed(range(len(bounds))):
        out = F.when(u < bounds[i], F.lit(i)).otherwise(out)
    return out


def permuted(idx: Column, n: int, seed: int | Column = 0, rounds: int = 4, exact: bool = False) -> Column:
    """Image of ``idx`` under a keyed permutation of [0, n), computed from the index alone.

    A balanced Feistel network on the next even number of bits, walked until the value is inside the
    range: no sort, no shuffle, and any slice of the order can be computed by itself. ``exact`` rounds are
    :func:`uniform` draws, which SQL engines can repeat.
    """
    return _walked(idx, n, seed, rounds, exact, inverse=False)


def unpermuted(pos: Column, n: int, seed: int | Column = 0, rounds: int = 4, exact: bool = False) -> Column:
    """The inverse of :func:`permuted`: which index is at ``pos``. The network's rounds run backwards, the walk does too."""
    return _walked(pos, n, seed, rounds, exact, inverse=True)


def _walked(value: Column, n: int, seed: int | Column, rounds: int, exact: bool, inverse: bool) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    if n <= 1:
        return F.lit(0).cast("long")
    half = (max(1, (n - 1).bit_length()) + 1) // 2
    width = 1 << half

    def network(x: Column) -> Column:
        start = F.struct(F.shiftright(x, half).alias("a"), x.bitwiseAND(F.lit(width - 1).cast("long")).alias("b"))
        drawn = lambda b, r: F.floor(uniform(b, F.concat_ws("|", F.lit("feistel"), seed.cast("string"), r.cast("string"))) * width) if exact else F.pmod(F.xxhash64(b, seed, r), F.lit(width))
        step = lambda s, r: F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(drawn(s["b"], r).cast("long")).alias("b"))
        back = lambda s, r: F.struct(s["b"].bitwiseXOR(drawn(s["a"], r).cast("long")).alias("a"), s["a"].alias("b"))
        order = F.sequence(F.lit(rounds), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(rounds))
        return F.aggregate(order, start, back if inverse else step, lambda s: s["a"] * width + s["b"])

    first = F.struct(value.cast("long").alias("x"), F.lit(True).alias("out"))
    walk = lambda s, _: F.when(s["out"], F.transform(F.array(network(s["x"])), lambda v: F.struct(v.alias("x"), (v >= n).alias("out")))[0]).otherwise(s)
    # the domain is under 4 n, so a step is inside with a chance over 1/4; 512 steps leave none out
    short = F.aggregate(F.sequence(F.lit(1), F.lit(12)), first, walk)
    long = F.aggregate(F.sequence(F.lit(1), F.lit(500)), short, walk)
    return F.transform(F.array(short), lambda s: F.when(s["out"], long["x"]).otherwise(s["x"]))[0]
