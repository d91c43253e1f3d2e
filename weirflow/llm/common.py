"""Shared pieces of the llm operators: word pattern, table access, lineage cuts, Arrow helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Character translation of the 26 ASCII capitals; other capitals stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session in one process may go without; there a temporary one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "weirflow-checkpoint")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder that spark.checkpoint.dir names, which all executors share.

    Spark removes what is no longer referred to where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and checkpoints that nothing refers to any more, without waiting for the driver's heap to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shelf:
    """A compressed table in the shared folder; with a key, in as many buckets as there are shuffle partitions.

    Joins on the key read it where it is, without shuffling it again. ``drop`` removes it and its files.
    """

    def __init__(self, df: DataFrame, key: list[str] | None = None) -> None:
        self.spark = df.sparkSession
        self.name = f"weirflow_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark).rstrip('/')}/{self.name}"
        w = df.write.format("parquet").option("compression", "zstd").option("path", self.path)
        (w.bucketBy(partitions(self.spark), *key) if key else w).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` plus a column that is computed once a row, whatever is asked of it later.

    A filter on an ordinary column moves below the projections that compute it, and each mention of a column
    becomes a copy of its expression; long chains of costly expressions then never end. A filter does not
    move below the generator of its column.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
