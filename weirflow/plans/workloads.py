"""Registered queries: one for each operator of the library, over the driver's tables, with DuckDB SQL for the same rows.

Keys: o_orderkey, event_id, doc_id and vec_id are dense and serve as the index; lineitem is numbered by
seven columns that identify its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import arrays, audio, keyed
from weirflow.operators import augment, batching, sampling, scan, statistics
from weirflow.operators.base import IDX, CrossModal, ElementFn, KeyedMap, KeyFilter, Map, Record, Remap, SelectRows, SplitField, clamp, iterate
from weirflow.operators.compose import Branching, ConditionalParallel, ConditionalSequential, DynamicSequential, Ensemble, Parallel, Probabilistic, Selector, Sequential, WeightedParallel
from weirflow.plans.catalog import query
from weirflow.plans.pipeline import Cursor, Pipeline, merge_mean
from weirflow.sources import metadata, mixture
from weirflow.sources.indexed import Source, from_path, limited, with_index

U = keyed.uniform_sql
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
_LINES = f"(SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS i FROM lineitem)"


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _orders(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return with_index(_read(spark, d, "orders"), dense="o_orderkey").select(IDX, *(names or ("o_totalprice",)))


def _out(df: DataFrame, **columns) -> DataFrame:
    """The index as ``i`` and the given columns, doubles rounded to 6 places."""
    return df.select(F.col(IDX).alias("i"), *[c.alias(k) for k, c in columns.items()])


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------------ scans, sources


@query(
    f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS i FROM lineitem WHERE l_discount > 0.01),
b AS (SELECT i // 256 AS batch_id, l_extendedprice / 100000.0 AS x, greatest(0.0, least(1.0, l_quantity / 50.0)) AS q FROM l)
SELECT batch_id, count(*) AS n, round(avg(x), 4) AS x_mean, round(stddev_pop(x), 4) AS x_std, round(min(x), 4) AS x_min, round(max(x), 4) AS x_max,
round(avg(q), 4) AS q_mean, round(stddev_pop(q), 4) AS q_std, round(min(q), 4) AS q_min, round(max(q), 4) AS q_max FROM b GROUP BY batch_id"""
)
def pipeline_batch_stats(spark: SparkSession, d: str) -> DataFrame:
    """Filter, index, scale, clip, batch, statistics."""
    lines = SelectRows(lambda f: f["l_discount"] > 0.01)(_read(spark, d, "lineitem").select(*LINE_KEY, "l_discount"))
    x = with_index(lines, LINE_KEY)
    x = x.select(IDX, (F.col("l_extendedprice") / 100000.0).alias("x"), clamp(F.col("l_quantity") / 50.0, 0.0, 1.0).alias("q"))
    b = x.withColumn("batch_id", F.floor(F.col(IDX) / 256))
    s = b.groupBy("batch_id").agg(F.count("*").alias("n"), *[fn(c).alias(f"{c}_{w}") for c in ("x", "q") for fn, w in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))])
    return s.select("batch_id", "n", *[F.round(f"{c}_{w}", 4).alias(f"{c}_{w}") for c in ("x", "q") for w in ("mean", "std", "min", "max")])


@query("SELECT i % 1000 AS slot, (i + 4900) % n AS i, o_totalprice FROM (SELECT unnest(range(1000)) AS i), (SELECT count(*) AS n FROM orders), LATERAL (SELECT o_totalprice FROM orders WHERE o_orderkey = (i + 4900) % n)")
def batch_at_wrap(spark: SparkSession, d: str) -> DataFrame:
    """A batch by position that may pass the end and wrap."""
    df = _orders(spark, d)
    return Source(df, df.count()).batch_at(4900, 1000).select(F.col("__slot").alias("slot"), F.col(IDX).alias("i"), "o_totalprice")


@query(f"SELECT o_orderkey AS i, o_totalprice FROM orders ORDER BY {U('o_orderkey', 'reservoir', 3)}, o_orderkey LIMIT 100")
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    return _out(sampling.reservoir(_orders(spark, d), 100, seed=3), o_totalprice=F.col("o_totalprice"))


@query("SELECT e AS epoch, e * n + o_orderkey AS pos, o_orderkey AS i FROM orders, (SELECT count(*) AS n FROM orders), (SELECT unnest(range(3)) AS e)")
def repeat_epochs(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return Source(df, df.count()).repeated(3).select(F.col("__epoch").cast("long").alias("epoch"), F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


@query("SELECT o_orderkey AS i, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def limit_records(spark: SparkSession, d: str) -> DataFrame:
    return _out(limited(_orders(spark, d), 500), o_totalprice=F.col("o_totalprice"))


@query(
    f"""WITH p AS (SELECT unnest(range((SELECT count(*) FROM orders) + (SELECT count(*) FROM events))) AS pos),
s AS (SELECT pos, CASE WHEN {U('pos', 'mix/source', 5)} < 0.7 THEN 0 ELSE 1 END AS src FROM p),
k AS (SELECT pos, src, CASE src WHEN 0 THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM events) END AS n FROM s),
x AS (SELECT pos, src, CAST(least(floor({U('pos', 'mix/row', 5)} * n), n - 1) AS BIGINT) AS local FROM k),
t AS (SELECT 0 AS src, o_orderkey AS local, o_totalprice AS value FROM orders UNION ALL SELECT 1, event_id, value FROM events)
SELECT pos, CAST(x.src AS INTEGER) AS src, x.local, value FROM x JOIN t ON x.src = t.src AND x.local = t.local"""
)
def mix_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two sources by weight 7 to 3, with replacement."""
    a = _orders(spark, d).withColumnRenamed("o_totalprice", "value")
    b = with_index(_read(spark, d, "events"), dense="event_id").select(IDX, "value")
    got = mixture.sample([Source(a, a.count()), Source(b, b.count())], [0.7, 0.3], seed=5)
    return got.select(F.col("__pos").alias("pos"), F.col("__src").alias("src"), F.col("__local").alias("local"), "value")


@query(
    """WITH t AS (SELECT 0 AS src, o_orderkey AS local, o_totalprice AS value, CAST(3 AS DOUBLE) AS w FROM orders UNION ALL SELECT 1, event_id, value, CAST(1 AS DOUBLE) FROM events)
SELECT row_number() OVER (ORDER BY (local + 0.5) / w, src) - 1 AS pos, CAST(src AS INTEGER) AS src, local, value FROM t"""
)
def mix_interleave(spark: SparkSession, d: str) -> DataFrame:
    a = _orders(spark, d).withColumnRenamed("o_totalprice", "value")
    b = with_index(_read(spark, d, "events"), dense="event_id").select(IDX, "value")
    got = mixture.interleave([Source(a, a.count()), Source(b, b.count())], [3.0, 1.0])
    return with_index(got, ["__key", "__src"]).select(F.col(IDX).alias("pos"), F.col("__src").alias("src"), F.col("__local").alias("local"), "value")


@query(
    """WITH t AS (SELECT 0 AS src, o_orderkey AS local FROM orders UNION ALL SELECT 1, event_id FROM events)
SELECT row_number() OVER (ORDER BY local // 4, src, local) - 1 AS pos, CAST(src AS INTEGER) AS src, local FROM t"""
)
def mix_round_robin(spark: SparkSession, d: str) -> DataFrame:
    a, b = _orders(spark, d).select(IDX), with_index(_read(spark, d, "events"), dense="event_id").select(IDX)
    got = mixture.round_robin([Source(a, a.count()), Source(b, b.count())], 4)
    return with_index(got, ["__block", "__src", "__local"]).select(F.col(IDX).alias("pos"), F.col("__src").alias("src"), F.col("__local").alias("local"))


@query("SELECT o_orderkey AS i FROM orders WHERE o_orderkey % 4 = 1")
def shard_strided(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return Source(df, df.count()).shard(1, 4).select(F.col(IDX).alias("i"))


@query("SELECT o_orderkey AS i FROM orders, (SELECT count(*) AS n FROM orders) WHERE o_orderkey >= 2 * (n // 7) AND o_orderkey < 3 * (n // 7)")
def shard_contiguous_drop(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return batching.shard(df, df.count(), 2, 7).select(F.col(IDX).alias("i"))


@query("SELECT o_orderkey AS i FROM orders, (SELECT count(*) AS n FROM orders) WHERE o_orderkey >= 2 * (n // 7) + least(2, n % 7) AND o_orderkey < 3 * (n // 7) + least(3, n % 7)")
def shard_contiguous_keep(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return batching.shard(df, df.count(), 2, 7, drop_remainder=False).select(F.col(IDX).alias("i"))


# ------------------------------------------------------------------ maps


@query("SELECT o_orderkey AS i, round(o_totalprice * 2, 6) AS o_totalprice, CAST(o_custkey * 2 AS BIGINT) AS o_custkey FROM orders")
def map_full(spark: SparkSession, d: str) -> DataFrame:
    m = Map(lambda c: c * 2)(_orders(spark, d, "o_totalprice", "o_custkey"))
    return _out(m, o_totalprice=_r("o_totalprice"), o_custkey=F.col("o_custkey"))


@query("SELECT o_orderkey AS i, round(o_totalprice / 1000.0, 6) AS o_totalprice, o_custkey FROM orders")
def map_subtree(spark: SparkSession, d: str) -> DataFrame:
    m = Map(lambda c: c / 1000.0, ("data.o_totalprice",))(_orders(spark, d, "o_totalprice", "o_custkey").select(IDX, F.struct("o_totalprice", "o_custkey").alias("data")))
    return m.select(F.col(IDX).alias("i"), _r("data.o_totalprice").alias("o_totalprice"), "data.o_custkey")


@query("SELECT o_orderkey AS i, o_totalprice FROM orders WHERE o_totalprice > 200000")
def select_rows(spark: SparkSession, d: str) -> DataFrame:
    return _out(SelectRows(lambda f: f["o_totalprice"] > 200000)(_orders(spark, d)), o_totalprice=F.col("o_totalprice"))


@query("SELECT o_orderkey AS i, o_custkey, o_orderstatus FROM orders")
def split_field(spark: SparkSession, d: str) -> DataFrame:
    s = SplitField(("o_custkey", "o_orderstatus", "absent"))(_orders(spark, d, "o_totalprice", "o_custkey", "o_orderstatus"))
    return s.withColumnRenamed(IDX, "i")


@query("SELECT o_orderkey AS i, o_custkey FROM orders")
def key_filter(spark: SparkSession, d: str) -> DataFrame:
    return KeyFilter(exclude=("o_totalprice",))(_orders(spark, d, "o_totalprice", "o_custkey")).withColumnRenamed(IDX, "i")


@query("SELECT o_orderkey AS i, o_totalprice AS price, greatest(50000.0, least(300000.0, o_totalprice)) AS clipped FROM orders")
def clip_and_remap(spark: SparkSession, d: str) -> DataFrame:
    return Remap("price", target="clipped", clip=(50000.0, 300000.0))(_orders(spark, d).withColumnRenamed("o_totalprice", "price")).withColumnRenamed(IDX, "i")


@query("SELECT event_id AS i, round(ln(1 + abs(value)), 6) AS x FROM events")
def log_transform(spark: SparkSession, d: str) -> DataFrame:
    e = with_index(_read(spark, d, "events"), dense="event_id").select(IDX, "value")
    return _out(e, x=_r(F.log1p(F.abs("value"))))


@query("SELECT o_orderkey AS i, CAST(abs(o_custkey * 7919) % 10000 AS BIGINT) AS bucket FROM orders")
def hash_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _out(_orders(spark, d, "o_custkey"), bucket=F.pmod(F.abs(F.col("o_custkey") * 7919), F.lit(10000)))


@query("SELECT event_id AS i, value * 0.9 * 0.9 * 0.9 * 0.9 * 0.9 AS value FROM events")
def iterated_map(spark: SparkSession, d: str) -> DataFrame:
    e = with_index(_read(spark, d, "events"), dense="event_id").select(IDX, "value")
    return _out(iterate(e, Map(lambda c: c * 0.9, ("value",)), 5), value=F.col("value"))


@query("SELECT o_orderkey AS i, o_totalprice + o_custkey AS total, o_totalprice - o_custkey AS diff FROM orders")
def cross_modal(spark: SparkSession, d: str) -> DataFrame:
    m = CrossModal(("o_totalprice", "o_custkey"), ("total", "diff"), lambda a, b: (a + b, a - b))(_orders(spark, d, "o_totalprice", "o_custkey"))
    return _out(m, total=F.col("total"), diff=F.col("diff"))


_EXPENSIVE = "(SELECT event_id, value AS v FROM events)"
for _ in range(8):
    _EXPENSIVE = f"(SELECT event_id, sin(v) + cos(v) AS v FROM {_EXPENSIVE})"


@query(f"SELECT event_id AS i, round(v + 0.1, 6) AS x FROM {_EXPENSIVE}")
def expensive_cheap(spark: SparkSession, d: str) -> DataFrame:
    e = with_index(_read(spark, d, "events"), dense="event_id").select(IDX, "value")
    heavy = Map(lambda c: F.sin(c) + F.cos(c), ("value",))
    for _ in range(8):  # each round a step of its own: as one expression it would double eight times
        e = heavy(e)
    return _out(Map(lambda c: c + 0.1, ("value",))(e), x=_r("value"))


def _crc32(words: str) -> str:
    """SQL of (x, crc32 of its UTF-8 bytes) for a table of distinct x: after each byte come eight shifts, marked -1."""
    h = "hex(encode(x))"
    steps = f"flatten(list_transform(range(length({h}) // 2), lambda k: list_concat([CAST(instr('0123456789ABCDEF', {h}[2 * k + 1]) * 16 + instr('0123456789ABCDEF', {h}[2 * k + 2]) - 17 AS BIGINT)], list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))"
    fold = f"list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"
    return f"SELECT x, xor({fold}, CAST(4294967295 AS BIGINT)) AS crc FROM ({words})"


def _tokens(source: str, size: int) -> str:
    """SQL CTEs that end in g: (i, list of the hash tokens of a text)."""
    return f"""WITH d AS ({source}), w AS (SELECT i, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM (SELECT i, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM d)),
c AS ({_crc32('SELECT DISTINCT x FROM w')}), t AS (SELECT i, list(crc % {size} ORDER BY k) AS t FROM w JOIN c USING (x) GROUP BY i), g AS (SELECT d.i, coalesce(t, []) AS t FROM d LEFT JOIN t ON d.i = t.i)"""


@query(_tokens("SELECT doc_id AS i, text FROM documents", 32000) + """
SELECT i, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(t) + (128 - len(t) % 128) % 128 AS INTEGER) AS padded,
md5(array_to_string(list_concat(t, list_transform(range((128 - len(t) % 128) % 128), lambda z: CAST(0 AS BIGINT))), ',')) AS digest FROM g""")
def tokens_padded(spark: SparkSession, d: str) -> DataFrame:
    """Hash tokens of the whole text, padded to a multiple of 128."""
    t = with_index(_read(spark, d, "documents"), dense="doc_id").select(IDX, arrays.hash_tokens(F.col("text"), 32000).alias("tokens"))
    padded = arrays.pad_to_multiple(F.col("tokens"))
    return _out(t, n_tokens=F.size("tokens"), padded=F.size(padded), digest=F.md5(F.array_join(F.transform(padded, lambda v: v.cast("string")), ",").cast("binary")))


@query(_tokens("SELECT conv_id * 1000 + turn AS i, text FROM conversations", 32000) + " SELECT i, CAST(p AS INTEGER) AS place, coalesce(t[p + 1], 0) AS token FROM g, range(64) r(p)")
def tokens_hashed(spark: SparkSession, d: str) -> DataFrame:
    """Captions of a fixed length: cutting them there is the operator's feature."""
    t = with_index(_read(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), dense="id")
    fixed = t.select(IDX, arrays.fixed_length(arrays.hash_tokens(F.col("text"), 32000), 64).alias("tokens"))
    return fixed.select(F.col(IDX).alias("i"), F.posexplode("tokens").alias("place", "token"))


@query("SELECT n_nationkey AS i, r AS row, c AS col, CAST(c <= r AS DOUBLE) AS on_ FROM nation, range(8) t(r), range(8) u(c)")
def causal_mask(spark: SparkSession, d: str) -> DataFrame:
    m = _read(spark, d, "nation").select("n_nationkey", F.posexplode(arrays.causal_mask(F.lit(8))).alias("row", "r"))
    return m.select(F.col("n_nationkey").alias("i"), F.col("row").cast("long").alias("row"), F.posexplode("r").alias("col", "on_")).select("i", "row", F.col("col").cast("long").alias("col"), F.col("on_").cast("double").alias("on_"))


@query("SELECT o_orderkey AS i, CAST(unnest(range(4)) AS BIGINT) AS place, CAST((o_custkey // CAST(pow(2, unnest(range(4))) AS BIGINT)) % 2 <> 0 AS DOUBLE) AS mask FROM orders")
def attention_mask(spark: SparkSession, d: str) -> DataFrame:
    t = F.array(*[F.pmod(F.floor(F.col("o_custkey") / (1 << k)), F.lit(2)) for k in range(4)])
    x = _orders(spark, d, "o_custkey").select(F.col(IDX).alias("i"), F.posexplode(arrays.attention_mask(t)).alias("place", "mask"))
    return x.select("i", F.col("place").cast("long").alias("place"), F.col("mask").cast("double").alias("mask"))


# ------------------------------------------------------------------ composition

_X2, _P1, _SQ = Map(lambda c: c * 2, ("x",)), Map(lambda c: c + 1, ("x",)), Map(lambda c: c * c, ("x",))


def _x(spark: SparkSession, d: str) -> DataFrame:
    return with_index(_read(spark, d, "events"), dense="event_id").select(IDX, F.col("value").alias("x"))


def _events(expression: str, name: str = "x") -> str:
    return f"SELECT event_id AS i, round({expression}, 6) AS {name} FROM (SELECT event_id, value AS x FROM events)"


@query(_events("(x * 2 + 1) * (x * 2 + 1)"))
def sequential(spark: SparkSession, d: str) -> DataFrame:
    return _out(Sequential((_X2, _P1, _SQ))(_x(spark, d)), x=_r("x"))


@query(_events("x * x * 2"))
def dynamic_sequential(spark: SparkSession, d: str) -> DataFrame:
    s = DynamicSequential([_X2, _P1]).add(_SQ, 0)
    s.remove(2)
    return _out(s(_x(spark, d)), x=_r("x"))


@query("WITH a AS (SELECT event_id, CASE WHEN value > 10 THEN value * 2 ELSE value END AS x FROM events) SELECT event_id AS i, round(CASE WHEN x > 30 THEN x + 1 ELSE x END, 6) AS x FROM a")
def conditional_sequential(spark: SparkSession, d: str) -> DataFrame:
    return _out(ConditionalSequential((_X2, _P1), (lambda f: f["x"] > 10, lambda f: f["x"] > 30))(_x(spark, d)), x=_r("x"))


@query("SELECT event_id AS i, CAST(k AS INTEGER) AS k, round(CASE k WHEN 0 THEN value * 2 ELSE value + 1 END, 6) AS x FROM events, range(2) t(k)")
def parallel_stack(spark: SparkSession, d: str) -> DataFrame:
    return Parallel((_X2, _P1), "stack")(_x(spark, d)).select(F.col(IDX).alias("i"), F.posexplode("x").alias("k", "x")).select("i", "k", _r("x").alias("x"))


@query("SELECT vec_id AS i, CAST(p AS INTEGER) AS place, round(CASE WHEN p < len(embedding) THEN CAST(embedding[p + 1] AS DOUBLE) * 2 ELSE embedding[p - len(embedding) + 1] END, 6) + 0.0 AS v FROM embeddings, range(128) t(p)")
def parallel_concat(spark: SparkSession, d: str) -> DataFrame:
    e = with_index(_read(spark, d, "embeddings"), dense="vec_id").select(IDX, F.col("embedding").cast("array<double>").alias("x"))
    two = Map(lambda c: F.transform(c, lambda v: v * 2), ("x",))
    c = Parallel((two, Map(lambda c: c, ("x",))), "concat")(e)
    return c.select(F.col(IDX).alias("i"), F.posexplode("x").alias("place", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query(_events("x * 2 + (x + 1) + x * x"))
def parallel_sum(spark: SparkSession, d: str) -> DataFrame:
    return _out(Parallel((_X2, _P1, _SQ), "sum")(_x(spark, d)), x=_r("x"))


@query(_events("(x * 2 + (x + 1) + x * x) / 3"))
def parallel_mean(spark: SparkSession, d: str) -> DataFrame:
    return _out(Parallel((_X2, _P1, _SQ), "mean")(_x(spark, d)), x=_r("x"))


@query("SELECT event_id AS i, round(value * 2, 6) AS operator_0, round(value + 1, 6) AS operator_1 FROM events")
def parallel_dict(spark: SparkSession, d: str) -> DataFrame:
    p = Parallel((_X2, _P1), "dict")(_x(spark, d))
    return _out(p, operator_0=_r("x.operator_0"), operator_1=_r("x.operator_1"))


_CONDS = (lambda f: f["x"] > 10, lambda f: f["x"] > 20)


@query(_events("CASE WHEN x > 10 THEN x * 2 ELSE 0 END + CASE WHEN x > 20 THEN x + 1 ELSE 0 END"))
def conditional_parallel_sum(spark: SparkSession, d: str) -> DataFrame:
    return _out(ConditionalParallel((_X2, _P1), _CONDS, "sum")(_x(spark, d)), x=_r("x"))


@query(_events("(CASE WHEN x > 10 THEN x * 2 ELSE 0 END + CASE WHEN x > 20 THEN x + 1 ELSE 0 END) / greatest(1, CAST(x > 10 AS INTEGER) + CAST(x > 20 AS INTEGER))"))
def conditional_parallel_mean(spark: SparkSession, d: str) -> DataFrame:
    return _out(ConditionalParallel((_X2, _P1), _CONDS, "mean")(_x(spark, d)), x=_r("x"))


@query(_events("0.25 * (x * 2) + 0.75 * (x * x)"))
def weighted_static(spark: SparkSession, d: str) -> DataFrame:
    return _out(WeightedParallel((_X2, _SQ), (0.25, 0.75))(_x(spark, d)), x=_r("x"))


@query("SELECT o_orderkey AS i, round((o_custkey % 3) * (o_totalprice * 2) + 0.5 * (o_totalprice + 1), 6) AS x FROM orders")
def weighted_by_key(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d, "o_totalprice", "o_custkey").select(IDX, F.col("o_totalprice").alias("x"), F.array(F.pmod("o_custkey", F.lit(3)).cast("double"), F.lit(0.5)).alias("w"))
    return _out(WeightedParallel((_X2, _P1), weight_key="w")(o), x=_r("x"))


def _ensemble(how: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _out(Ensemble((_X2, _P1, _SQ), how)(_x(spark, d)), x=_r("x"))

    run.__name__ = f"ensemble_{how}"
    return run


for _how, _sql in {"mean": "(x * 2 + (x + 1) + x * x) / 3", "sum": "x * 2 + (x + 1) + x * x", "max": "greatest(x * 2, x + 1, x * x)", "min": "least(x * 2, x + 1, x * x)"}.items():
    query(_events(_sql))(_ensemble(_how))


@query("SELECT o_orderkey AS i, CASE least(2, o_custkey % 5) WHEN 0 THEN o_totalprice * 2 WHEN 1 THEN o_totalprice + 1 ELSE o_totalprice * o_totalprice END AS x FROM orders")
def branching(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d, "o_totalprice", "o_custkey").withColumnRenamed("o_totalprice", "x")
    return _out(Branching((_X2, _P1, _SQ), lambda f: F.pmod(f["o_custkey"], F.lit(5)))(o), x=F.col("x"))


@query(_events(f"CASE WHEN {U('event_id', 'maybe/0', 7)} < 0.3 THEN x * 2 ELSE x END"))
def probabilistic(spark: SparkSession, d: str) -> DataFrame:
    return _out(Probabilistic(_X2, 0.3, seed=7)(_x(spark, d)), x=_r("x"))


@query(_events(f"CASE WHEN {U('event_id', 'select/0', 7)} < 0.2 THEN x * 2 WHEN {U('event_id', 'select/0', 7)} < 0.5 THEN x + 1 ELSE x * x END"))
def selector(spark: SparkSession, d: str) -> DataFrame:
    return _out(Selector((_X2, _P1, _SQ), (2.0, 3.0, 5.0), seed=7)(_x(spark, d)), x=_r("x"))


@query(_events(f"x * (0.8 + {U('event_id', 'scale/0', 9)} * 0.4)"))
def random_scale(spark: SparkSession, d: str) -> DataFrame:
    return _out(KeyedMap(lambda c, u: c * keyed.between(u, 0.8, 1.2), ("x",), 9, "scale")(_x(spark, d)), x=_r("x"))


@query(_events(f"x + (-0.2 + {U('event_id', 'bright/0', 9)} * 0.4)"))
def random_brightness(spark: SparkSession, d: str) -> DataFrame:
    return _out(KeyedMap(lambda c, u: c + keyed.between(u, -0.2, 0.2), ("x",), 9, "bright")(_x(spark, d)), x=_r("x"))


@query(
    f"SELECT event_id AS i, round(value + 0.05 * sqrt(-2.0 * ln(1.0 - {U('event_id', 'noise/n/r', 9)})) * cos({2 * math.pi!r} * {U('event_id', 'noise/n/a', 9)}), 5) AS x FROM events"
)
def gaussian_noise(spark: SparkSession, d: str) -> DataFrame:
    rec = Record({"x": F.col("x")}, F.col(IDX), 9, "noise")
    return _out(_x(spark, d).select(IDX, (F.col("x") + 0.05 * rec.normal("n")).alias("x")), x=F.round("x", 5))


@query(_events(f"CASE WHEN {U('event_id', 'drop/x', 9)} >= 0.1 THEN x ELSE 0.0 END"))
def dropout_scalar(spark: SparkSession, d: str) -> DataFrame:
    return _out(ElementFn(lambda f, draw: {"x": F.when(draw("x") >= 0.1, f["x"]).otherwise(0.0)}, 9, "drop")(_x(spark, d)), x=_r("x"))


@query(_events(f"CASE WHEN {U('event_id', 'sp/x', 9)} < 0.02 THEN 255.0 WHEN {U('event_id', 'sp/x', 9)} < 0.05 THEN 0.0 ELSE x END"))
def salt_pepper_scalar(spark: SparkSession, d: str) -> DataFrame:
    fn = lambda f, draw: {"x": F.when(draw("x") < 0.02, 255.0).when(draw("x") < 0.05, 0.0).otherwise(f["x"])}
    return _out(ElementFn(fn, 9, "sp")(_x(spark, d)), x=_r("x"))


@query("SELECT event_id AS i, round((value * 2 + value * value) / 2, 6) AS x FROM events")
def dag_merge(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    p = Pipeline(Source(df, df.count()), {"double": _X2, "square": _SQ, "mean": lambda a, b: merge_mean(a, b, ["x"])}, 64, {"double": ["source"], "square": ["source"], "mean": ["double", "square"]}, "mean")
    return _out(p.rows(), x=_r("x"))


# ------------------------------------------------------------------ samplers, windows


@query("SELECT CAST(e AS BIGINT) AS epoch, e * n + o_orderkey AS pos, o_orderkey AS i FROM orders, (SELECT count(*) AS n FROM orders), range(2) t(e)")
def sequential_epochs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sequential(spark, _orders(spark, d).count(), 2).select(F.col("__epoch").alias("epoch"), F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


@query("SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS pos, CAST(v AS BIGINT) AS i FROM range(10, (SELECT count(*) FROM orders), 7) t(v)")
def range_sampler(spark: SparkSession, d: str) -> DataFrame:
    return sampling.arithmetic(spark, 10, _orders(spark, d).count(), 7).select(F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


@query(f"SELECT row_number() OVER (ORDER BY {U('o_orderkey', 'perm|0', 4)}, o_orderkey) - 1 AS pos, o_orderkey AS i FROM orders")
def shuffle_rank(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled(spark, _orders(spark, d).count(), 4, method="rank").select(F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


def _feistel(rows: str, seed: str) -> str:
    """Recursive SQL of (i, e, x): rows (i, e, n) walked under the keyed permutation of [0, n) until they are inside."""
    half = "((length(bin(CAST(n - 1 AS BIGINT))) + 1) // 2)"
    round_ = lambda r: f"CAST(floor((CAST('0x' || substr(md5(concat_ws('|', '0', 'feistel', {seed}, '{r}', CAST(b AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0) * (1 << h)) AS BIGINT)"
    step = "SELECT i, e, n, h, x >> h AS a, x & ((1 << h) - 1) AS b FROM walk WHERE x >= n OR first"
    for r in range(1, 5):
        step = f"SELECT i, e, n, h, b AS a, xor(a, {round_(r)}) AS b FROM ({step})"
    return f"""WITH RECURSIVE walk AS (SELECT i, e, n, {half} AS h, i AS x, true AS first FROM ({rows})
UNION ALL SELECT i, e, n, h, (a << h) + b AS x, false AS first FROM ({step}))
SELECT i, e, n, x FROM walk WHERE x < n AND NOT first"""


@query(f"SELECT i, x AS pos FROM ({_feistel('SELECT o_orderkey AS i, 0 AS e, (SELECT count(*) FROM orders) AS n FROM orders', repr('4'))})")
def shuffle_feistel(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled(spark, _orders(spark, d).count(), 4, method="feistel_exact").select(F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


@query(
    f"""SELECT ((x - 4900) % n + n) % n AS slot, i, o_totalprice FROM (SELECT w.*, (SELECT count(*) FROM orders) AS n
FROM ({_feistel('SELECT o_orderkey AS i, 0 AS e, (SELECT count(*) FROM orders) AS n FROM orders', repr('4'))}) w) JOIN orders ON o_orderkey = i WHERE ((x - 4900) % n + n) % n < 1000"""
)
def batch_at_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """A thousand positions of a shuffled epoch: their indices by the inverse permutation, then a scan that is pruned by them."""
    s = from_path(spark, f"{d}/orders.parquet", dense="o_orderkey", include=("o_totalprice",), shuffle_seed=4, exact=True)
    return s.batch_at(4900, 1000).select(F.col("__slot").alias("slot"), F.col(IDX).alias("i"), "o_totalprice")


_CARRY = """SELECT event_id AS i, round(sum(value) OVER o, 4) AS total, max(value) OVER o AS top, count(*) FILTER (event_type = 'purchase') OVER o AS purchases,
last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER o AS last_purchase FROM events WINDOW o AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""


@query(_CARRY)
def running_carry(spark: SparkSession, d: str) -> DataFrame:
    """Running sum, maximum, count and last known value over all events, block by block and then over the blocks."""
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    e = with_index(_read(spark, d, "events").select("event_id", "value", bought.alias("bought")), dense="event_id")
    out = scan.prefix(e, {"total": scan.running_sum("value"), "top": scan.running_max("value"), "purchases": scan.running_count("bought")})
    out = scan.prefix(out, {"last_purchase": scan.last_known("bought")}, block=256)
    return out.select(F.col(IDX).alias("i"), F.round("total", 4).alias("total"), "top", "purchases", "last_purchase")


@query(
    """WITH b AS (SELECT event_id // 64 AS batch_id, list(event_type = 'error' ORDER BY event_id) AS e, max(value) AS top FROM events GROUP BY 1)
SELECT batch_id, top, CAST(sum(len(list_filter(e, lambda x: x))) OVER (ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors FROM b"""
)
def carried_batches(spark: SparkSession, d: str) -> DataFrame:
    """A step of one's own over batches in order, the carry handed from range to range."""
    e = with_index(_read(spark, d, "events").select("event_id", "value", "event_type"), dense="event_id")

    def step(errors: int, batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        errors += pc.sum(pc.equal(batch["event_type"], "error")).as_py()
        return errors, pa.table({"batch_id": [batch[IDX][0].as_py() // 64], "top": [pc.max(batch["value"]).as_py()], "errors": [errors]})

    return scan.carried(e, step, 0, "batch_id long, top double, errors long", 64, per_range=1 << 15)[1]


@query()
def shuffle_feistel_fast(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled(spark, _orders(spark, d).count(), 4).select(F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


@query(f"SELECT CAST(e AS BIGINT) AS epoch, e * n + x AS pos, i FROM ({_feistel('SELECT o_orderkey AS i, e, (SELECT count(*) FROM orders) AS n FROM orders, range(3) t(e)', 'CAST(e + 4 AS VARCHAR)')})")
def epoch_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return sampling.epoch_shuffled(spark, _orders(spark, d).count(), 3, 4, exact=True).select(F.col("__epoch").alias("epoch"), F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


@query("SELECT p // n AS epoch, p AS pos, p % n AS i FROM (SELECT count(*) AS n FROM orders), LATERAL (SELECT unnest(range(n * 2 - 100, n * 2 + 900)) AS p)")
def endless_cursor(spark: SparkSession, d: str) -> DataFrame:
    """What an endless sampler gives next, from a restored state, across the end of an epoch."""
    n = _orders(spark, d).count()
    cursor = sampling.EpochCursor(n, seed=None)
    rows, _ = cursor.restored({"n": n, "position": n * 2 - 100}).take(spark, 1000)
    return rows.select(F.col("__epoch").alias("epoch"), F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


@query("SELECT w AS window, CAST(o AS BIGINT) AS offset_, w * 5 + o AS i, value FROM range(((SELECT count(*) FROM events) - 8) // 5 + 1) a(w), range(8) b(o) JOIN events ON event_id = w * 5 + o")
def sliding_window_drop(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    w = sampling.SlidingWindow(8, 5).over(df, df.count())
    return w.select(F.col("__window").alias("window"), F.col("__offset").cast("long").alias("offset_"), F.col(IDX).alias("i"), F.col("x").alias("value"))


@query("SELECT w AS window, CAST(o AS BIGINT) AS offset_, least(w * 5 + o, n - 1) AS i, value FROM (SELECT count(*) AS n FROM events), range(((SELECT count(*) FROM events) - 1) // 5 + 1) a(w), range(8) b(o) JOIN events ON event_id = least(w * 5 + o, n - 1)")
def sliding_window_pad(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    w = sampling.SlidingWindow(8, 5, drop_incomplete=False).over(df, df.count())
    return w.select(F.col("__window").alias("window"), F.col("__offset").cast("long").alias("offset_"), F.col(IDX).alias("i"), F.col("x").alias("value"))


@query("SELECT event_id AS i, round(sum(value) OVER w, 4) AS total, CAST(count(*) OVER w AS INTEGER) AS held FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)")
def fifo_buffer(spark: SparkSession, d: str) -> DataFrame:
    b = sampling.FifoBuffer(32).contents(_x(spark, d), "x")
    return _out(b, total=F.round(F.aggregate("__buffer", F.lit(0.0), lambda a, v: a + v), 4), held=F.size("__buffer"))


@query(
    f"""WITH j AS (SELECT event_id AS i, CAST(least(floor({U('event_id', 'reservoir/slot', 2)} * (event_id + 1)), event_id) AS BIGINT) AS j FROM events),
s AS (SELECT i, CASE WHEN i < 64 THEN i WHEN j < 64 THEN j END AS slot FROM j)
SELECT slot, max(i) AS i FROM s WHERE slot IS NOT NULL GROUP BY slot"""
)
def reservoir_buffer(spark: SparkSession, d: str) -> DataFrame:
    return sampling.reservoir_state(_x(spark, d), 64, 2).select(F.col("__slot").alias("slot"), F.col(IDX).alias("i"))


@query(f"SELECT event_id // 1000 * 1000 + row_number() OVER (PARTITION BY event_id // 1000 ORDER BY {U('event_id', 'buffer', 42)}, event_id) - 1 AS pos, event_id AS i FROM events")
def buffer_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return sampling.buffer_shuffled(_x(spark, d), 1000, 42).select(F.col("__pos").alias("pos"), F.col(IDX).alias("i"))


_READ = """SELECT t, k, CASE WHEN t < 16 THEN t WHEN t < 32 THEN {slot} ELSE t - (t - {slot}) % 32 END AS i
FROM (SELECT event_id AS t, k, least(event_id + 1, 32) AS held FROM events, range(3) r(k) WHERE event_id >= 16 OR k = 0)"""


@query(_READ.format(slot="(((t - 16) * 3 + k) % held)"))
def buffer_read_in_turn(spark: SparkSession, d: str) -> DataFrame:
    r = sampling.FifoBuffer(32, prefill=16).reads(_x(spark, d), 3)
    return r.select(F.col("__t").alias("t"), F.col("__k").alias("k"), F.col(IDX).alias("i"))


_DRAWN = "(CAST('0x' || substr(md5(concat_ws('|', '4', 'buffer/read/' || k, CAST(t AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0)"


@query(_READ.format(slot=f"CAST(least(floor({_DRAWN} * held), held - 1) AS BIGINT)"))
def buffer_read_at_random(spark: SparkSession, d: str) -> DataFrame:
    r = sampling.FifoBuffer(32, prefill=16).reads(_x(spark, d), 3, seed=4)
    return r.select(F.col("__t").alias("t"), F.col("__k").alias("k"), F.col(IDX).alias("i"))


# ------------------------------------------------------------------ batching

_B = "SELECT o_orderkey // 64 AS batch_id, o_orderkey % 64 AS slot, true AS valid, o_orderkey AS i FROM orders"


def _batched(spark: SparkSession, d: str, last: str) -> DataFrame:
    df = _orders(spark, d)
    return batching.Batcher(64, last).assign(df, df.count()).select("batch_id", "slot", "valid", F.col(IDX).alias("i"))


@query(_B)
def batch_keep(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d, "keep")


@query(f"{_B} WHERE o_orderkey < (SELECT count(*) - count(*) % 64 FROM orders)")
def batch_drop(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d, "drop")


@query(f"{_B} UNION ALL SELECT n // 64, n % 64 + k, false, n - 1 FROM (SELECT count(*) AS n FROM orders), range(64) t(k) WHERE n % 64 <> 0 AND k < 64 - n % 64")
def batch_pad(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d, "pad")


@query(f"{_B} UNION ALL SELECT n // 64, n % 64 + k, true, k % n FROM (SELECT count(*) AS n FROM orders), range(64) t(k) WHERE n % 64 <> 0 AND k < 64 - n % 64")
def batch_wrap(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d, "wrap")


@query("SELECT event_id // 100 AS batch_id, CAST(count(*) AS INTEGER) AS n, round(sum(value), 4) AS total FROM events WHERE event_id < (SELECT count(*) - count(*) % 100 FROM events) GROUP BY 1")
def rebatched(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    n = df.count()
    g = batching.rebatch(batching.slice_rows(df, 0, n - n % 100), 100, n - n % 100)
    return g.select("batch_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("SELECT event_id // 64 AS batch_id, CAST(event_id % 64 AS INTEGER) AS slot, value AS x FROM events")
def unbatched(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    return batching.unbatch(batching.Batcher(64).collate(df, df.count()).drop("valid"))


@query("SELECT o_orderkey AS i FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def slice_of_rows(spark: SparkSession, d: str) -> DataFrame:
    return batching.slice_rows(_orders(spark, d), 100, 900).select(F.col(IDX).alias("i"))


@query("SELECT o_orderkey AS i, o_orderkey // (n // 5) AS part FROM orders, (SELECT count(*) AS n FROM orders)")
def split_equal(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return batching.split_equal(df, 5, df.count()).select(F.col(IDX).alias("i"), "part")


@query("SELECT o_orderkey AS i, o_totalprice AS value FROM orders UNION ALL SELECT event_id + (SELECT count(*) FROM orders), value FROM events")
def concatenated(spark: SparkSession, d: str) -> DataFrame:
    a, b = _orders(spark, d).withColumnRenamed("o_totalprice", "value"), _x(spark, d).withColumnRenamed("x", "value")
    return _out(batching.concatenate([a, b], [a.count(), b.count()]), value=F.col("value"))


@query("SELECT vec_id AS i, CAST(p AS INTEGER) AS place, embedding[p // 3 + 1] AS v FROM embeddings, range(192) t(p) WHERE p < 3 * len(embedding)")
def multirate_align(spark: SparkSession, d: str) -> DataFrame:
    e = with_index(_read(spark, d, "embeddings"), dense="vec_id").select(IDX, "embedding")
    return batching.align(e, {"embedding": 3}).select(F.col(IDX).alias("i"), F.posexplode("embedding").alias("place", "v"))


@query("SELECT o_orderkey AS i, o_totalprice AS x FROM orders")
def batch_dimension(spark: SparkSession, d: str) -> DataFrame:
    x = batching.add_batch_dimension(_orders(spark, d).withColumnRenamed("o_totalprice", "x"), ["x"])
    return _out(batching.remove_batch_dimension(x, ["x"]), x=F.col("x"))


_MIX = f"""WITH b AS (SELECT event_id AS i, event_id // 64 AS batch_id, value AS x, {U('event_id', 'mix/perm', 1)} AS u FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY i) AS k, row_number() OVER (PARTITION BY batch_id ORDER BY u, i) AS r, count(*) OVER (PARTITION BY batch_id) AS n FROM b),
p AS (SELECT a.i, a.batch_id, a.x, o.x AS y, a.n, CASE WHEN a.n < 2 THEN 1.0 ELSE {U('a.batch_id', 'mix/lambda', 1)} END AS lam FROM k a JOIN k o ON a.batch_id = o.batch_id AND a.k = o.r)
"""


@query(f"{_MIX} SELECT i, batch_id, round(lam, 9) AS lam, round(y + lam * (x - y), 6) AS x FROM p")
def mixup(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    m = augment.mixup(batching.Batcher(64).assign(df, df.count()).select(IDX, "batch_id", "x"), ["x"], seed=1)
    return m.select(F.col(IDX).alias("i"), "batch_id", F.round("lam", 9).alias("lam"), _r("x").alias("x"))


_BOX = f"""c AS (SELECT *, floor(sqrt(1.0 - lam) * 8) AS ph, floor(sqrt(1.0 - lam) * 8) AS pw, least(floor({U('batch_id', 'mix/y', 1)} * 8), 7) AS cy, least(floor({U('batch_id', 'mix/x', 1)} * 8), 7) AS cx FROM p),
e AS (SELECT *, greatest(0, least(8, cy - floor(ph / 2))) AS t, greatest(0, least(8, cy + floor(ph / 2))) AS b, greatest(0, least(8, cx - floor(pw / 2))) AS l, greatest(0, least(8, cx + floor(pw / 2))) AS r FROM c)"""


@query(f"{_MIX}, {_BOX} SELECT i, batch_id, 1.0 - (b - t) * (r - l) / 64 AS lam, y + (1.0 - (b - t) * (r - l) / 64) * (x - y) AS x FROM e")
def cutmix_labels(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    b = batching.Batcher(64).assign(df, df.count()).select(IDX, "batch_id", "x", F.array_repeat("x", 64).alias("img"))
    m = augment.cutmix(b, ["img"], ["x"], (8, 8, 1), seed=1)
    return m.select(F.col(IDX).alias("i"), "batch_id", "lam", "x")


# ------------------------------------------------------------------ statistics


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def batch_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.describe(_read(spark, d, "orders"), ["o_totalprice"], ["o_orderstatus"])
    return s.select("o_orderstatus", F.round("o_totalprice_mean", 4).alias("mean"), F.round("o_totalprice_std", 4).alias("std"), F.col("o_totalprice_min").alias("min"), F.col("o_totalprice_max").alias("max"))


@query("SELECT CAST(p AS INTEGER) AS place, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, min(v) AS min, max(v) AS max FROM (SELECT unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1")
def array_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.describe_array(_read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("e")), "e")
    return s.select("place", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "min", "max")


@query("SELECT event_type, round(sum(CASE WHEN value > 10 THEN value END) / count(CASE WHEN value > 10 THEN value END), 5) AS mean FROM events GROUP BY 1")
def masked_mean(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").withColumn("valid", F.col("value") > 10)
    return e.groupBy("event_type").agg(F.round(statistics.masked_mean("value"), 5).alias("mean"))


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id AS i, round((value - m) / s, 5) AS x FROM events, s")
def fitted_standardize(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    return _out(statistics.Standardize(("x",)).fit(df)(df), x=F.round("x", 5))


@query(
    """SELECT event_type, round(avg(value), 5) AS avg, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(*) AS count,
round(CASE WHEN count(*) >= 2 AND max(epoch(ts)) > min(epoch(ts)) THEN count(*) / (max(epoch(ts)) - min(epoch(ts))) END, 6) AS rate FROM events GROUP BY 1"""
)
def metric_roll_up(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    r = statistics.roll_up(e, ["event_type"], "value", seconds)
    return r.select("event_type", F.round("avg", 5).alias("avg"), "min", "max", F.round("sum", 4).alias("sum"), "count", F.round("rate", 6).alias("rate"))


@query("SELECT round(avg(value), 5) AS value, count(DISTINCT user_id) AS user_id FROM events")
def custom_reduction(spark: SparkSession, d: str) -> DataFrame:
    return statistics.reduce_by(_read(spark, d, "events"), {"value": "mean", "user_id": F.count_distinct}).select(F.round("value", 5).alias("value"), "user_id")


@query(
    """WITH t AS (SELECT value / 10 AS wall, value / 40 AS source, value / 20 AS transform, value / 100 AS transfer FROM events)
SELECT round(sum(wall), 4) AS wall, round(greatest(0, sum(wall) - sum(source) - sum(transform) - sum(transfer)), 4) AS overhead,
round((sum(wall) - greatest(0, sum(wall) - sum(source) - sum(transform) - sum(transfer))) / sum(wall), 5) AS ratio FROM t"""
)
def goodput(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    t = _read(spark, d, "events").select((v / 10).alias("wall"), (v / 40).alias("source"), (v / 20).alias("transform"), (v / 100).alias("transfer"))
    return statistics.goodput(t).select(F.round("wall", 4).alias("wall"), F.round("overhead", 4).alias("overhead"), F.round("ratio", 5).alias("ratio"))


@query("SELECT CAST(count(*) FILTER (value > 10) AS BIGINT) AS applied, CAST(count(*) FILTER (NOT coalesce(value > 10, false)) AS BIGINT) AS skipped FROM events")
def applied_counts(spark: SparkSession, d: str) -> DataFrame:
    return statistics.applied_counts(_read(spark, d, "events"), F.col("value") > 10)


# ------------------------------------------------------------------ arrays, images, audio


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return with_index(_read(spark, d, "embeddings"), dense="vec_id").select(IDX, F.col("embedding").cast("array<double>").alias("x"))


@query("SELECT vec_id AS i, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 5) AS norm FROM embeddings")
def vector_norm(spark: SparkSession, d: str) -> DataFrame:
    return _out(_vectors(spark, d), norm=F.round(arrays.l2(F.col("x")), 5))


@query(
    """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS n FROM embeddings)
SELECT vec_id AS i, CAST(unnest(range(len(embedding))) AS INTEGER) AS place, round(CAST(unnest(embedding) AS DOUBLE) / n, 5) + 0.0 AS v FROM n"""
)
def vector_unit_length(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col(IDX).alias("i"), F.posexplode(arrays.unit_length(F.col("x"))).alias("place", "v")).withColumn("v", F.round("v", 5) + 0.0)


@query(
    f"""WITH f AS (SELECT event_id, 20.0 + value * 100 AS hz FROM events), g AS (SELECT event_id, hz * hz AS q FROM f)
SELECT event_id AS i, round(2.0 + 20.0 * log10((q * q * {audio.A_CORNERS[3] ** 2!r}) / ((q + {audio.A_CORNERS[0] ** 2!r}) * sqrt((q + {audio.A_CORNERS[1] ** 2!r}) * (q + {audio.A_CORNERS[2] ** 2!r})) * (q + {audio.A_CORNERS[3] ** 2!r}))), 5) AS db FROM g"""
)
def a_weighting(spark: SparkSession, d: str) -> DataFrame:
    return _out(_x(spark, d), db=F.round(audio.a_weighting(F.lit(20.0) + F.col("x") * 100), 5))


@query("SELECT vec_id AS i, CAST(p AS INTEGER) AS place, list_max(embedding[p * 4 + 1 : p * 4 + 4]) AS v FROM embeddings, range(16) t(p) WHERE p < len(embedding) // 4")
def max_pool(spark: SparkSession, d: str) -> DataFrame:
    return with_index(_read(spark, d, "embeddings"), dense="vec_id").select(F.col(IDX).alias("i"), F.posexplode(arrays.max_pool(F.col("embedding"), 4)).alias("place", "v"))


# ------------------------------------------------------------------ position, resume, streams


@query("SELECT event_id AS i, round(value * 2, 6) AS x FROM events WHERE event_id >= 777")
def resume_tail(spark: SparkSession, d: str) -> DataFrame:
    """What is left after a cursor."""
    df = _x(spark, d)
    return _out(Pipeline(Source(df, df.count()), [_X2], 64).resumed(Cursor(777)).rows(), x=_r("x"))


@query("SELECT event_id AS i, event_id // 64 AS batch_id, round(value * value + 1, 6) AS x FROM events")
def pipeline_batches(spark: SparkSession, d: str) -> DataFrame:
    df = _x(spark, d)
    return Pipeline(Source(df, df.count()), [_SQ, _P1], 64).batched().select(F.col(IDX).alias("i"), "batch_id", _r("x").alias("x"))


@query(f"SELECT i, round(l_extendedprice / 1000.0 * (0.9 + {U('i', 'lines/0', 8)} * 0.2), 6) AS price FROM {_LINES}")
def line_augment(spark: SparkSession, d: str) -> DataFrame:
    """Index a table without a dense key, then scale each row by its own draw."""
    lines = with_index(_read(spark, d, "lineitem").select(*LINE_KEY), LINE_KEY).select(IDX, "l_extendedprice")
    chain = KeyedMap(lambda c, u: c / 1000.0 * keyed.between(u, 0.9, 1.1), ("l_extendedprice",), 8, "lines")
    return _out(chain(lines), price=_r("l_extendedprice"))


@query("SELECT o_orderkey AS i, CAST(1 AS INTEGER) AS epoch, n + o_orderkey AS global_step, CAST(o_orderkey // 64 AS INTEGER) AS batch_idx, CAST(o_orderkey % 4 AS INTEGER) AS shard_id, 'order-' || o_orderkey AS record_key FROM orders, (SELECT count(*) AS n FROM orders)")
def record_metadata(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    m = metadata.with_metadata(df, df.count(), epoch=1, batch_size=64, shards=4, key=F.concat(F.lit("order-"), F.col(IDX)), info={"table": "orders"})
    return m.select(F.col("meta.index").alias("i"), "meta.epoch", "meta.global_step", "meta.batch_idx", "meta.shard_id", "meta.record_key")


@query("SELECT o_orderkey // 64 AS batch_id, min(o_orderkey) AS i, max(o_orderkey) AS global_step, 'k' || min(o_orderkey) AS record_key FROM orders GROUP BY 1")
def batch_metadata(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    n = df.count()
    m = metadata.with_metadata(batching.Batcher(64).assign(df, n), n, key=F.concat(F.lit("k"), F.col(IDX)))
    return metadata.of_batch(m).select("batch_id", F.col("index").alias("i"), "global_step", "record_key")


from weirflow.plans import inputs, signals  # noqa: E402, F401  register their queries
