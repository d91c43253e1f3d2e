"""Statistics of batches and tables, fitted transforms, metric roll-ups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """mean, population std, min and max of each field, over all rows or by group."""
    parts = [(F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max")]
    return df.groupBy(*(by or [])).agg(*[fn(c).alias(f"{c}_{what}") for c in names for fn, what in parts])


def describe_array(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """The same for each place of an array field, one row a place; combined before it shuffles."""
    d = df.select(*(by or []), F.posexplode(name).alias("place", "v"))
    return d.groupBy(*(by or []), "place").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def masked_mean(x: str, valid: str = "valid") -> Column:
    """Mean over rows that count; null where none does."""
    return F.sum(F.when(F.col(valid), F.col(x))) / F.sum(F.when(F.col(valid) & F.col(x).isNotNull(), 1))


def reduce_by(df: DataFrame, reductions: dict[str, str | Callable[[Column], Column]], default: str = "mean") -> DataFrame:
    """One row: each field reduced by name (mean, sum, max, min) or by an aggregate function of the column."""
    named = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    return df.agg(*[(named[h](c) if isinstance(h := how or default, str) else h(F.col(c))).alias(c) for c, how in reductions.items()])


@dataclass(frozen=True)
class Standardize:
    """(x - mean) / std with statistics fitted on a table, or given; std 0 leaves x - mean."""

    names: tuple[str, ...]
    statistics: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame) -> Standardize:
        """One pass; one row of results reaches the driver."""
        row = describe(df, list(self.names)).first()
        return Standardize(self.names, {c: (row[f"{c}_mean"], row[f"{c}_std"]) for c in self.names})

    def reset(self) -> Standardize:
        return Standardize(self.names)

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.statistics is None:
            raise ValueError("fit first, or give statistics")
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in self.statistics.items()})


def roll_up(metrics: DataFrame, by: list[str], value: str, seconds: Column) -> DataFrame:
    """avg, min, max, sum, count and rate of each metric; rate is count / (last - first), null under two or without a span."""
    t = metrics.withColumn("__t", seconds)
    span = F.max("__t") - F.min("__t")
    rate = F.when((F.count("*") >= 2) & (span > 0), F.count("*") / span)
    return t.groupBy(*by).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count("*").alias("count"), rate.alias("rate"))


def goodput(timings: DataFrame, wall: str = "wall", parts: tuple[str, ...] = ("source", "transform", "transfer")) -> DataFrame:
    """Sums of the parts of the wall time, what is over, and the share that was not."""
    total = sum((F.sum(p) for p in parts[1:]), F.sum(parts[0]))
    over = F.greatest(F.lit(0.0), F.sum(wall) - total)
    return timings.agg(F.sum(wall).alias("wall"), *[F.sum(p).alias(p) for p in parts], over.alias("overhead"), F.when(F.sum(wall) > 0, (F.sum(wall) - over) / F.sum(wall)).otherwise(0.0).alias("ratio"))


def applied_counts(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows a conditional operator applies to, and skips."""
    hit = F.coalesce(condition, F.lit(False))
    return df.agg(F.sum(hit.cast("long")).alias("applied"), F.sum((~hit).cast("long")).alias("skipped"))
