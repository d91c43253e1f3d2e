"""Mixtures of indexed sources: drawn with replacement by weight, or interleaved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions import keyed
from weirflow.operators.base import IDX

from .indexed import Source


def same_schema(sources: list[Source]) -> None:
    first = {f.name: f.dataType for f in sources[0].df.schema if f.name != IDX}
    for i, s in enumerate(sources[1:], 1):
        own = {f.name: f.dataType for f in s.df.schema if f.name != IDX}
        if own != first:
            raise ValueError(f"source {i} has other fields than source 0: {sorted(set(own.items()) ^ set(first.items()), key=str)}")


def _union(sources: list[Source]) -> DataFrame:
    out = None
    for i, s in enumerate(sources):
        one = s.df.withColumns({"__src": F.lit(i), "__local": F.col(IDX)}).drop(IDX)
        out = one if out is None else out.unionByName(one)
    return out


def draws(spark, lengths: list[int], weights: list[float], n: int, seed: int = 0):
    """__pos, __src, __local for positions 0..n-1: a source by weight, then a row of it, both keyed by position."""
    pos = F.col("id")
    src = keyed.pick(keyed.uniform(pos, "mix/source", seed), weights)
    length = F.element_at(F.array(*map(F.lit, lengths)), src + 1)
    d = spark.range(n).select(pos.alias("__pos"), src.alias("__src"), length.cast("long").alias("__len"))
    return d.select("__pos", "__src", keyed.integer(keyed.uniform(F.col("__pos"), "mix/row", seed), F.col("__len")).alias("__local"))


def sample(sources: list[Source], weights: list[float], n: int | None = None, seed: int = 0) -> DataFrame:
    """n records (default: as many as all sources have), each position's source drawn by weight, its row uniformly, with replacement.

    One equi-join on (source, row); any slice of positions can be computed by itself.
    """
    if len(weights) != len(sources) or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("one weight for each source, not negative, not all 0")
    same_schema(sources)
    n = sum(map(len, sources)) if n is None else n
    d = draws(sources[0].df.sparkSession, [len(s) for s in sources], weights, n, seed)
    return d.join(_union(sources), ["__src", "__local"])


def interleave(sources: list[Source], weights: list[float] | None = None) -> DataFrame:
    """All rows of all sources, spread so that each stretch holds them by weight; ``__key`` orders them.

    Row j of a source of weight w stands at (j + 0.5) / w; ties go to the earlier source.
    """
    same_schema(sources)
    weights = weights or [1.0] * len(sources)
    w = F.element_at(F.array(*map(F.lit, [float(x) for x in weights])), F.col("__src") + 1)
    return _union(sources).withColumn("__key", (F.col("__local") + 0.5) / w)


def round_robin(sources: list[Source], cycle: int = 1) -> DataFrame:
    """``cycle`` rows of each source in turn; ``__block``, ``__src``, ``__local`` order them."""
    if cycle < 1:
        raise ValueError("cycle must be at least 1")
    same_schema(sources)
    return _union(sources).withColumn("__block", F.floor(F.col("__local") / cycle))
