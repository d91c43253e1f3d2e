"""Metadata of records as one struct column: counters, place, key and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.base import IDX

KEY_LENGTH = 128
FIELDS = ("index", "epoch", "global_step", "batch_idx", "shard_id", "record_key", "source_info")


def of(index: Column, length: int, epoch: int | Column = 0, batch_size: int | None = None, shards: int | None = None, key: Column | None = None, info: dict[str, str] | None = None) -> Column:
    """global_step counts over epochs; batch, shard and key are null where not given; keys over 128 bytes are an error."""
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    none = lambda kind: F.lit(None).cast(kind)
    named = none("string") if key is None else F.when(F.octet_length(key) <= KEY_LENGTH, key).otherwise(F.raise_error(F.lit(f"record keys are at most {KEY_LENGTH} bytes")))
    pairs = [F.lit(x) for kv in (info or {}).items() for x in kv]
    return F.struct(
        index.cast("long").alias("index"),
        e.cast("int").alias("epoch"),
        (e * length + index).cast("long").alias("global_step"),
        (F.floor(index / batch_size).cast("int") if batch_size else none("int")).alias("batch_idx"),
        (F.pmod(index, F.lit(shards)).cast("int") if shards else none("int")).alias("shard_id"),
        named.alias("record_key"),
        (F.create_map(*pairs) if pairs else none("map<string,string>")).alias("source_info"),
    )


def with_metadata(df: DataFrame, length: int, **options) -> DataFrame:
    return df.withColumn("meta", of(F.col(IDX), length, **options))


def merged(a: Column, b: Column) -> Column:
    """Field by field b, where it is neither null nor 0, else a."""
    def pick(name: str) -> Column:
        x, y = a.getField(name), b.getField(name)
        return F.coalesce(F.nullif(y, F.lit(0)) if name in FIELDS[:3] else y, x).alias(name)

    return F.struct(*map(pick, FIELDS))


def of_batch(df: DataFrame, by: str = "batch_id") -> DataFrame:
    """One struct a batch: the largest step and epoch, the first row's index, key and origin, the first batch and shard that are known."""
    first = lambda name, nulls=False: F.min_by(f"meta.{name}", F.when(F.col(f"meta.{name}").isNotNull() | F.lit(not nulls), F.col("meta.index"))).alias(name)
    return df.groupBy(by).agg(first("index"), F.max("meta.epoch").alias("epoch"), F.max("meta.global_step").alias("global_step"), first("batch_idx", True), first("shard_id", True), first("record_key"))
