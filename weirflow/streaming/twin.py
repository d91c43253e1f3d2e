"""Streams: the same operators over unbounded tables, stateful buffers, event-time roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weirflow.operators.base import IDX


def apply(stream: DataFrame, *ops: Callable[[DataFrame], DataFrame], index: str | None = None) -> DataFrame:
    """Operators on a stream. Keyed randomness needs the records' own index, for arrival order is no contract."""
    d = stream.withColumn(IDX, F.col(index).cast("long")) if index else stream
    for op in ops:
        d = op(d)
    return d


def run_once(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append", trigger: dict | None = None) -> DataFrame:
    """Everything that is there now, through a memory sink: for tests and small results."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True}))
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, through a file sink below ``folder`` (of any store), and read again.

    In the modes ``update`` and ``complete`` each micro-batch is written with its number ``__batch``.
    """
    spark = stream.sparkSession
    out, state = f"{folder.rstrip('/')}/out", f"{folder.rstrip('/')}/state"
    if mode == "append":
        write(stream, out, state).awaitTermination()
    else:
        put = lambda df, k: df.withColumn("__batch", F.lit(k).cast("long")).write.mode("append").parquet(out)
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def write(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", **trigger):
    """A file sink: exactly once with its checkpoint folder."""
    return stream.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def for_each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_roll_up(stream: DataFrame, time: str, value: str, by: list[str], window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """count, sum, min and max in event-time windows; rows later than ``late`` are left out."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    d = t.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "sum", "min", "max")


def reservoirs(stream: DataFrame, index: str, by: str, capacity: int, seed: int = 0) -> DataFrame:
    """A uniform sample of at most ``capacity`` indices of each group, kept as rows arrive.

    A row's draw is keyed by its index, and the rows of the least draws stay, so the sample is the same
    however the rows are cut into micro-batches. State is bounded by ``capacity`` a group.
    """
    kind = dict(stream.dtypes)[by]
    draw = F.xxhash64(F.lit(seed), F.lit("reservoir"), F.col(index))
    slim = stream.select(F.col(by).alias("group"), F.col(index).cast("long").alias("idx"), draw.alias("draw"))

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = list(zip(*state.get)) if state.exists else []
        for c in chunks:
            have = sorted({*have, *zip(c["draw"].tolist(), c["idx"].tolist())})[:capacity]
        state.update(tuple(list(x) for x in zip(*have)))
        yield pd.DataFrame({"group": [key[0]] * len(have), "idx": [i for _, i in have]})

    return slim.groupBy("group").applyInPandasWithState(update, f"group {kind}, idx long", "draws array<long>, idxs array<long>", "update", GroupStateTimeout.NoTimeout)
