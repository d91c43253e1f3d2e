"""Registered queries of sources, streams, adapters, specifications and saved state, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import keyed, specs
from weirflow.lineage import shared_folder
from weirflow.operators import batching, sketches
from weirflow.operators.base import IDX, Map, PandasFn, Record, branch_on, iterate_while
from weirflow.operators.compose import Parallel, Probabilistic, Sequential, When
from weirflow.plans import caching
from weirflow.plans.catalog import query
from weirflow.plans.checkpoints import Checkpoints
from weirflow.plans.observed import Recorder, observed
from weirflow.plans.pipeline import Pipeline
from weirflow.sources import arrays as npy
from weirflow.sources import exports, records, tfrecords
from weirflow.sources.indexed import Source, as_dataframe, from_memory, from_path, stream, with_index
from weirflow.streaming import replay, twin

U = keyed.uniform_sql
#: Rows of a micro-batch at most: what a task holds follows it, the result does not.
AHEAD = 1 << 20


def _events(spark: SparkSession, d: str) -> DataFrame:
    return with_index(spark.read.parquet(f"{d}/events.parquet"), dense="event_id").select(IDX, F.col("value").alias("x"))


def _fresh(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/weirflow-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources


@query("SELECT n_nationkey AS i, n_name FROM nation")
def memory_source(spark: SparkSession, d: str) -> DataFrame:
    """A table that fits the driver as a dict of lists (here: the nations), one of its fields left out."""
    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").toPandas()
    s = from_memory(spark, {"n_name": rows["n_name"].tolist(), "other": rows["n_regionkey"].tolist()}, include=("n_name",))
    return s.epoch().select(F.col(IDX).alias("i"), "n_name")


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, item_id, text FROM benchmark")
def memory_records(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's items as a list of records, through the adapter that takes any finite source."""
    records = [r.asDict() for r in spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").collect()]
    return as_dataframe(records, spark).select(F.col(IDX).alias("i"), "item_id", "text")


@query("SELECT k, o_orderkey AS i, o_totalprice FROM (SELECT k, (k * 7919) % (SELECT count(*) FROM orders) AS j FROM range(2000) t(k)) JOIN orders ON o_orderkey = j")
def rows_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Rows for a list of indices, repeats included."""
    s = from_path(spark, f"{d}/orders.parquet", dense="o_orderkey", include=("o_totalprice",))
    want = spark.range(2000).select(F.col("id").alias("k"), F.pmod(F.col("id") * 7919, F.lit(len(s))).alias(IDX))
    return want.join(s.take_indices(want.distinct()).dropDuplicates([IDX]), IDX).select("k", F.col(IDX).alias("i"), "o_totalprice")


@query("SELECT o_orderkey AS i, o_totalprice FROM orders WHERE o_orderkey IN (0, (SELECT count(*) - 1 FROM orders))")
def row_at(spark: SparkSession, d: str) -> DataFrame:
    """The first row and, by a negative index, the last."""
    s = from_path(spark, f"{d}/orders.parquet", dense="o_orderkey", include=("o_totalprice",))
    return s.at(0).union(s.at(-1)).withColumnRenamed(IDX, "i")


@query("SELECT vec_id AS i, CAST(p AS INTEGER) AS place, embedding[p + 1] AS v FROM embeddings, range(64) t(p)")
def npy_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table of arrays written by its tasks as .npy files and read again by ranges of rows."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("__idx"), F.col("embedding").alias("data"))
    path = npy.saved(e, _fresh(spark), rows=300)
    got = spark.read.format("npy").option("rows", 128).load(path)
    return got.select(F.col("__idx").alias("i"), F.posexplode("data").alias("place", "v"))


@query(
    "SELECT 'all' AS part, o_orderkey AS i, o_custkey, o_totalprice, o_orderstatus FROM orders UNION ALL SELECT 'listed', o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey < 1500 AND o_orderkey % 97 = 5 "
    "UNION ALL SELECT 'range', o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 700 AND 899"
)
def record_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as record files: read whole, by a list of numbers and by a range, the latter two from their chunks alone."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias(IDX), "o_custkey", "o_totalprice", "o_orderstatus")
    at = records.saved(orders, _fresh(spark), chunk=512)
    parts = {"all": None, "listed": list(range(5, 1500, 97)), "range": range(700, 900)}
    out = None
    for name, wanted in parts.items():
        part = records.read(spark, at, wanted).select(F.lit(name).alias("part"), F.col(IDX).alias("i"), "o_custkey", "o_totalprice", "o_orderstatus")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id, text, CASE WHEN lang <> 'en' THEN lang END AS lang, string_split(text, ' ')[1:5] AS head, [doc_id, n_chars] AS numbers FROM documents"
)
def tfrecord_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Example records, with nulls and lists, and back in their order."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.select("doc_id", "text", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), F.slice(F.split("text", " "), 1, 5).alias("head"), F.array("doc_id", "n_chars").alias("numbers"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = tfrecords.saved(docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id"), _fresh(spark))
    return tfrecords.from_tfrecords(spark, at, docs.schema).df.withColumnRenamed(IDX, "i")


@query("SELECT e AS epoch, e * n + o_orderkey AS pos, o_orderkey AS i FROM orders, (SELECT count(*) AS n FROM orders), (SELECT unnest([5, 6]) AS e)")
def endless_piece(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of an endless repeat, from the fifth on."""
    s = from_path(spark, f"{d}/orders.parquet", dense="o_orderkey", include=("o_totalprice",))
    return s.repeated(2, first=5).select(F.col("__epoch").cast("int").alias("epoch"), F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


@query("SELECT o_orderkey AS i, o_totalprice AS input, o_orderstatus AS target FROM orders")
def exported_split(spark: SparkSession, d: str) -> DataFrame:
    """A split in three Parquet shards, as pairs of input and target."""
    at = _fresh(spark)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    n = orders.count()
    for k in range(3):
        part = orders.filter((F.col("o_orderkey") >= n * k // 3) & (F.col("o_orderkey") < n * (k + 1) // 3)).orderBy("o_orderkey").coalesce(1)
        part.write.parquet(f"{at}/orders-train-0000{k}-of-00003.parquet")
    s = exports.from_export(spark, at, "train", supervised=("o_totalprice", "o_orderstatus"))
    return s.epoch().select(F.col(IDX).alias("i"), "input", "target")


# ------------------------------------------------------------------ maps that adapt or decide


@query("SELECT event_id AS i, CAST(value AS FLOAT) AS x FROM events")
def cast_float(spark: SparkSession, d: str) -> DataFrame:
    return Map(lambda c: c.cast("float"))(_events(spark, d)).withColumnRenamed(IDX, "i")


@query("SELECT event_id AS i, round(sqrt(abs(value)), 6) AS x FROM events")
def outside_function(spark: SparkSession, d: str) -> DataFrame:
    """A function from outside, by Arrow batches."""
    op = PandasFn("x", lambda s: pd.Series(np.sqrt(np.abs(s))), "double")
    return op(_events(spark, d)).select(F.col(IDX).alias("i"), F.round("x", 6).alias("x"))


@query(
    "WITH RECURSIVE m AS (SELECT max(abs(value)) AS m, CAST(1 AS DOUBLE) AS f FROM events UNION ALL SELECT m, f * 2 FROM m WHERE m * f < 100000) SELECT event_id AS i, value * (SELECT max(f) FROM m) AS x FROM events"
)
def while_map(spark: SparkSession, d: str) -> DataFrame:
    """Doubled while the largest value is under a bound."""
    double = Map(lambda c: c * 2, ("x",))
    return iterate_while(_events(spark, d), lambda df: df.agg(F.max(F.abs("x"))).first()[0] < 100_000, double).withColumnRenamed(IDX, "i")


@query("SELECT event_id AS i, CASE WHEN (SELECT count(*) FROM events) > 10 THEN value * 2 ELSE value + 1 END AS x FROM events")
def conditional_map(spark: SparkSession, d: str) -> DataFrame:
    df = _events(spark, d)
    return branch_on(df, df.count() > 10, Map(lambda c: c * 2, ("x",)), Map(lambda c: c + 1, ("x",))).withColumnRenamed(IDX, "i")


@query("SELECT event_id AS i, round((value * 2) * (value + 1), 6) AS x FROM events")
def merged_by_function(spark: SparkSession, d: str) -> DataFrame:
    """A merge of one's own: the product of two branches."""
    product = lambda rs: Record({k: rs[0].fields[k] * rs[1].fields[k] for k in rs[0].fields})
    p = Parallel((Map(lambda c: c * 2, ("x",)), Map(lambda c: c + 1, ("x",))), product)
    return p(_events(spark, d)).select(F.col(IDX).alias("i"), F.round("x", 6).alias("x"))


@query("SELECT event_id // 64 AS batch_id, max(value) AS top, CAST(count(*) AS INTEGER) AS n, min_by(value, event_id) AS first FROM events GROUP BY 1")
def collated(spark: SparkSession, d: str) -> DataFrame:
    """Batches collated by a function of one's own."""
    df = _events(spark, d)
    return batching.Batcher(64).collate(df, df.count(), lambda f: {"top": F.array_max(f["x"]), "n": F.size(f["x"]), "first": F.get(f["x"], F.lit(0))})


@query("SELECT * FROM (VALUES ('__idx', '64', 'bigint'), ('x', '64', 'double'), ('image', '64x8x8x1', 'double'), ('valid', '64', 'boolean')) t(field, shape, kind)")
def batch_specification(spark: SparkSession, d: str) -> DataFrame:
    df = specs.with_shape(_events(spark, d).withColumn("image", F.array_repeat("x", 64)), "image", (8, 8, 1))
    spec = specs.batch_spec(df, 64, valid=True)
    return spark.createDataFrame([(k, "x".join(map(str, shape)), kind) for k, (shape, kind) in spec.items()], "field string, shape string, kind string")


# ------------------------------------------------------------------ saved state


@query("SELECT event_id AS i, value AS x FROM events WHERE event_id >= 64 * 5")
def restored_cursor(spark: SparkSession, d: str) -> DataFrame:
    """A cursor saved after five batches, in the shared folder, and what is left after restoring it."""
    df = _events(spark, d)
    p = Pipeline(Source(df, df.count()), [], 64)
    c = Checkpoints(spark, _fresh(spark))
    c.save(3, p.advanced(3))
    c.save_async(5, p.advanced(5)).result()
    return c.restore(p).rows().select(F.col(IDX).alias("i"), "x")


@query("SELECT event_id AS i, value AS x FROM events")
def kept_table(spark: SparkSession, d: str) -> DataFrame:
    """Written on the first call, read on the second."""
    at = caching.resolve(None, _fresh(spark), "events")
    caching.kept_at(_events(spark, d), at)
    return caching.kept_at(_events(spark, d).limit(0), at).withColumnRenamed(IDX, "i")


# ------------------------------------------------------------------ streams


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return stream(spark, d, schema, pathGlobFilter="events.parquet")


@query(f"SELECT event_id AS i, round(value * (0.8 + {U('event_id', 'scale/0', 9)} * 0.4), 6) AS x FROM events")
def stream_keyed_map(spark: SparkSession, d: str) -> DataFrame:
    """A keyed operator on a stream gives what it gives on a table."""
    from weirflow.operators.base import KeyedMap

    op = KeyedMap(lambda c, u: c * keyed.between(u, 0.8, 1.2), ("value",), 9, "scale")
    s = twin.apply(_stream(spark, d).select("event_id", "value"), op, index="event_id")
    return twin.drained(s, _fresh(spark)).select(F.col(IDX).alias("i"), F.round("value", 6).alias("x"))


@query(
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2)
SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n, total, low, high FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows that the watermark has closed."""
    r = twin.windowed_roll_up(_stream(spark, d), "ts", "value", ["event_type"], "1 hour", "10 minutes")
    out = twin.drained(r, _fresh(spark))
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("sum", 4).alias("total"), F.col("min").alias("low"), F.col("max").alias("high"))


@query("SELECT event_type, CAST(least(40, count(*)) AS BIGINT) AS n, CAST(count(*) FILTER (event_id < 0) AS BIGINT) AS strangers FROM events GROUP BY 1")
def stream_reservoirs(spark: SparkSession, d: str) -> DataFrame:
    """Stateful samples of each type: their sizes, and how many are not of the type."""
    s = twin.reservoirs(_stream(spark, d), "event_id", "event_type", 40, seed=2)
    out = twin.drained(s, _fresh(spark), "update")
    last = out.groupBy(F.col("group").alias("g")).agg(F.max("__batch").alias("b"))
    held = out.join(last, (F.col("group") == F.col("g")) & (F.col("__batch") == F.col("b")))
    known = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    met = held.join(known, held.idx == known.event_id, "left")
    strange = F.count_if(F.coalesce(F.col("event_type") != F.col("group"), F.lit(True)))
    return met.groupBy(F.col("group").alias("event_type")).agg(F.count_distinct("idx").alias("n"), strange.alias("strangers")).select("event_type", "n", "strangers")


@query(
    "WITH b AS (SELECT e, event_id // 256 AS block, event_id AS i, value FROM events, range(2) t(e)) SELECT CAST(e AS BIGINT) AS epoch, block, count(*) AS n, CAST(e * (SELECT count(*) FROM events) + min(i) AS BIGINT) AS first_pos, min(i) AS low, max(i) AS high, round(sum(value), 4) AS total FROM b GROUP BY e, block"
)
def stream_records(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of record files, two epochs mixed inside blocks: what each block of positions holds."""
    at = _fresh(spark)
    records.saved(_events(spark, d), f"{at}/set", chunk=128)
    got = twin.drained(records.stream(spark, f"{at}/set", buffer=256, seed=3, epochs=2), at)
    n = len(records.from_records(spark, f"{at}/set"))
    got = got.withColumn("block", F.floor((F.col("__pos") - F.col("__epoch") * n) / 256))
    return got.groupBy(F.col("__epoch").alias("epoch"), "block").agg(F.count("*").alias("n"), F.min("__pos").alias("first_pos"), F.min(IDX).alias("low"), F.max(IDX).alias("high"), F.round(F.sum("x"), 4).alias("total"))


@query(
    """SELECT t, k, i, value AS x FROM (SELECT t, k, CASE WHEN t < 16 THEN t WHEN t < 32 THEN {slot} ELSE t - (t - {slot}) % 32 END AS i
FROM (SELECT event_id AS t, k, least(event_id + 1, 32) AS held FROM events, range(3) r(k) WHERE event_id >= 16 OR k = 0)) JOIN events ON event_id = i""".format(
        slot="CAST(least(floor((CAST('0x' || substr(md5(concat_ws('|', '4', 'buffer/read/' || k, CAST(t AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0) * held), held - 1) AS BIGINT)"
    )
)
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """A replay buffer on a stream of record files, in micro-batches of a bounded look-ahead (a third of the rows, a million at most): three rows read at random after each write."""
    at = _fresh(spark)
    records.saved(_events(spark, d), f"{at}/set", chunk=128)
    n = len(records.from_records(spark, f"{at}/set"))
    s = records.stream(spark, f"{at}/set", ahead=min(max(500, n // 3 + 1), AHEAD), progress=f"{at}/progress").drop("__pos", "__epoch")
    read = replay.replayed(s, replay.Replay(32, 16, 3, read="at_random", seed=4), splits=4)
    with replay.state_partitions(spark, 4):
        q = read.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{at}/out").select(F.col("__t").alias("t"), F.col("__k").alias("k"), F.col(IDX).alias("i"), "x")


# ------------------------------------------------------------------ statistics


@query(
    f"""WITH a AS (SELECT event_id, value > 10 AS first, CASE WHEN value > 10 THEN value / 2 ELSE value END AS x FROM events),
b AS (SELECT first, {U('event_id', 'chain/1/0', 8)} < 0.25 AS second, CASE WHEN {U('event_id', 'chain/1/0', 8)} < 0.25 THEN x + 1 ELSE x END > 20 AS third FROM a)
SELECT '0 When' AS operator, count(*) AS rows, count(*) FILTER (first) AS applied, count(*) - count(*) FILTER (first) AS skipped FROM b
UNION ALL SELECT '1 Probabilistic', count(*), count(*) FILTER (second), count(*) - count(*) FILTER (second) FROM b
UNION ALL SELECT '2 When', count(*), count(*) FILTER (third), count(*) - count(*) FILTER (third) FROM b"""
)
def observed_chain(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each operator of a chain applied to and skipped, from the run that wrote them."""
    steps = (When(lambda f: f["x"] > 10, Map(lambda c: c / 2, ("x",))), Probabilistic(Map(lambda c: c + 1, ("x",)), 0.25), When(lambda f: f["x"] > 20, Map(lambda c: c * 0, ("x",))))
    r = Recorder()
    observed(Sequential(steps, 8, "chain"), r)(_events(spark, d)).write.parquet(f"{_fresh(spark)}/out")
    rows = [(k, m["rows"], m["applied"], m["skipped"]) for k, m in r.results().items()]
    return spark.createDataFrame(rows, "operator string, rows long, applied long, skipped long")


@query("SELECT label, CAST(p AS INTEGER) AS place, CAST(greatest(0, least(15, floor((embedding[p + 1] + 0.5) * 16))) AS INTEGER) AS bin, count(*) AS n FROM embeddings, range(64) t(p) GROUP BY 1, 2, 3")
def array_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of each place of the embeddings by label, folded in the tasks and merged."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return sketches.summarize(e, sketches.Histogram("embedding", -0.5, 0.5, 16), ["label"])


@query("SELECT CAST(p AS INTEGER) AS place, count(*) AS n, round(avg(CAST(embedding[p + 1] AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(embedding[p + 1] AS DOUBLE)), 6) AS std FROM embeddings, range(64) t(p) GROUP BY 1")
def array_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of each place of the embeddings by merged states."""
    m = sketches.summarize(spark.read.parquet(f"{d}/embeddings.parquet"), sketches.Moments("embedding"))
    return m.select("place", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
