"""Running values along an index: an associative carry in two passes, and a sequential one handed from range to range.

Associative carries (:func:`prefix`): rows fall into blocks of positions. The first pass folds each block to one value,
the values are scanned themselves (again in blocks, as often as it takes), the second pass continues every block from what
lies before it. Inside a block of bounded size a carry is a window where it is an aggregate that Spark has, else a scan
by doubled strides over an array. No task holds more than a block, and nothing but counts reaches the driver.

Other carries (:func:`carried`): a step of one's own over batches in order. That is sequential by nature: ranges of positions
run one after the other, each in one task that streams its batches; the carry (small, pickled) and nothing else goes from one
range to the next, rows go to files in the shared folder.

Nulls enter as they are: what they do is up to the merge (sums and extrema skip them). Indices must differ; gaps are no matter. An empty table gives an empty
result (and the start as the last carry).
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from weirflow.lineage import cut, shared_folder
from weirflow.operators.base import IDX

#: Positions of a block.
BLOCK = 1024


@dataclass(frozen=True)
class Carry:
    """``lift`` makes a state of a row, ``merge`` joins an earlier and a later state (associative, any order of rows is kept).

    With ``aggregate``, Spark's own function for the same fold of single states, blocks are folded by it.
    """

    lift: Callable[[], Column]
    merge: Callable[[Column, Column], Column]
    aggregate: Callable[[Column], Column] | None = None


def running_sum(c: str) -> Carry:
    return Carry(lambda: F.col(c), lambda a, b: F.coalesce(a + b, a, b), F.sum)


def running_max(c: str) -> Carry:
    return Carry(lambda: F.col(c), lambda a, b: F.greatest(a, b), F.max)


def running_min(c: str) -> Carry:
    return Carry(lambda: F.col(c), lambda a, b: F.least(a, b), F.min)


def running_count(c: str) -> Carry:
    return Carry(lambda: F.col(c).isNotNull().cast("long"), lambda a, b: a + b, F.sum)


def last_known(c: str) -> Carry:
    """The value of the last row that has one."""
    return Carry(lambda: F.col(c), lambda a, b: F.coalesce(b, a))


def recurrence(scale: Callable[[], Column], shift: Callable[[], Column]) -> Carry:
    """Pairs (scale, shift) of x -> scale * x + shift, composed in order; from x the result is ``scale * x + shift``."""
    return Carry(
        lambda: F.struct(scale().cast("double").alias("scale"), shift().cast("double").alias("shift")),
        lambda a, b: F.struct((a["scale"] * b["scale"]).alias("scale"), (a["shift"] * b["scale"] + b["shift"]).alias("shift")),
    )


def prefix(df: DataFrame, carries: dict[str, Carry], index: str = IDX, block: int = BLOCK) -> DataFrame:
    """``df`` plus, for each name, the carry over all rows up to and with its own, in the order of ``index``."""
    if block < 2:
        raise ValueError("a block has two positions at least")
    names = list(carries)
    lifted = df.withColumns({f"__s_{k}": c.lift() for k, c in carries.items()}).withColumn("__b", F.floor(F.col(index) / block))
    return _scanned(lifted, carries, names, index, block).drop("__b", *[f"__s_{k}" for k in names])


def _scanned(lifted: DataFrame, carries: dict[str, Carry], names: list[str], index: str, block: int) -> DataFrame:
    """``lifted`` plus the running values under their names."""
    native = all(carries[k].aggregate is not None for k in names)
    states = [f"__s_{k}" for k in names]
    if native:
        totals = lifted.groupBy("__b").agg(*[carries[k].aggregate(F.col(s)).alias(s) for k, s in zip(names, states)])
        over = Window.partitionBy("__b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
        inside = lifted.withColumns({k: carries[k].aggregate(F.col(s)).over(over) for k, s in zip(names, states)})
    else:
        totals = _strided(lifted.select("__b", F.col(index).alias("__i"), *states), carries, names, block, [])
        totals = totals.select("__b", *[F.element_at("__run", -1)[k].alias(s) for k, s in zip(names, states)])
        others = [c for c in lifted.columns if c not in ("__b", *states)]
        runs = _strided(lifted.withColumn("__i", F.col(index)), carries, names, block, others)
        inside = runs.select("__b", F.explode(F.arrays_zip("__run", "__row")).alias("__z")).select("__b", "__z.__row.*", *[F.col(f"__z.__run.{k}").alias(k) for k in names])
    totals = cut(totals)  # one row a block, used again below
    blocks = totals.agg(F.min("__b"), F.max("__b")).first()
    if blocks[0] is None or blocks[0] == blocks[1]:
        return inside
    # what lies before a block: the running value of the block before it
    above = totals.withColumnRenamed("__b", "__at").withColumn("__b", F.floor(F.col("__at") / block))
    above = _scanned(above, carries, names, "__at", block)
    ends = cut(above.select("__at", *[F.col(k).alias(f"__p_{k}") for k in names]))  # read three times
    # blocks may be missing, so each takes the last one before it
    before = F.lag(F.struct("*")).over(Window.partitionBy("__g").orderBy("__at"))
    ends = _shifted(ends, block, before).withColumnRenamed("__at", "__to")
    joined = inside.join(ends, F.col("__b") == F.col("__to"), "left").drop("__to")
    none = F.col("__known").isNull()
    done = {k: F.when(none, F.col(k)).otherwise(carries[k].merge(F.col(f"__p_{k}"), F.col(k))) for k in names}
    return joined.withColumns(done).drop("__known", *[f"__p_{k}" for k in names])


def _shifted(ends: DataFrame, block: int, before: Column) -> DataFrame:
    """Each block's values moved to the next block that is there: inside groups of blocks by a window, over their edges by the groups' last ones."""
    ends = ends.withColumn("__g", F.floor(F.col("__at") / block))
    columns = [c for c in ends.columns if c not in ("__at", "__g")]
    moved = ends.select("__at", "__g", before.alias("__v"))
    first, inner = moved.where("__v IS NULL").select("__at", "__g"), moved.where("__v IS NOT NULL").select("__at", *[F.col(f"__v.{c}").alias(c) for c in columns])
    lasts = ends.groupBy("__g").agg(F.max_by(F.struct(*columns), "__at").alias("__v"))
    # groups are fewer by the size of a block; the group before is found in one order of them, as bounded as their number
    groups = lasts.select("__g", F.lag("__v").over(Window.orderBy("__g")).alias("__v")).where("__v IS NOT NULL")
    edge = first.join(groups, "__g").select("__at", *[F.col(f"__v.{c}").alias(c) for c in columns])
    return inner.unionByName(edge).withColumn("__known", F.lit(True))


def _strided(rows: DataFrame, carries: dict[str, Carry], names: list[str], block: int, others: list[str]) -> DataFrame:
    """__b, __run (running states of the block's rows in order) and __row (their other columns)."""
    row = F.struct(*others) if others else F.lit(None).alias("__none")
    member = F.struct(F.col("__i").alias("i"), F.struct(*[F.col(f"__s_{k}").alias(k) for k in names]).alias("s"), row.alias("r"))
    df = rows.groupBy("__b").agg(F.array_sort(F.collect_list(member), lambda x, y: F.when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0)).alias("__m"))
    df = df.select("__b", F.transform("__m", lambda m: m["s"]).alias("__run"), F.transform("__m", lambda m: m["r"]).alias("__row"))

    def joined(stride: int) -> Callable[[Column, Column], Column]:
        def step(x: Column, i: Column) -> Column:
            earlier = F.get(F.col("__run"), i - stride)
            return F.when(i >= stride, F.struct(*[carries[k].merge(earlier[k], x[k]).alias(k) for k in names])).otherwise(x)

        return step

    stride = 1
    while stride < block:
        df = df.withColumn("__run", F.transform("__run", joined(stride)))
        stride *= 2
    return df


def carried(df: DataFrame, step: Callable[[object, pa.Table], tuple[object, pa.Table | None]], start: object, schema: str | StructType, batch: int, index: str = IDX, per_range: int = 1 << 20, folder: str | None = None) -> tuple[object, DataFrame]:
    """(last carry, rows that the steps gave): ``step`` over batches of ``batch`` positions (0 to N-1), in order.

    A step gets the carry and a batch as an Arrow table, and gives the next carry and rows of ``schema`` or None.
    """
    spark = df.sparkSession
    bounds = df.agg(F.min(index), F.max(index)).first()
    out = f"{(folder or shared_folder(spark)).rstrip('/')}/weirflow-{uuid.uuid4().hex}"
    wanted = spark.createDataFrame([], schema).schema
    if bounds[0] is None:
        return start, spark.createDataFrame([], wanted)
    full = StructType([*wanted.fields]).add("__carry", BinaryType())
    arrow = spark.createDataFrame([], full).toArrow().schema
    span = max(1, per_range // batch) * batch
    carry, parts = pickle.dumps(start), []
    for low in range(bounds[0] // batch * batch, bounds[1] + 1, span):
        rows = df.filter(F.col(index).between(low, low + span - 1)).coalesce(1).sortWithinPartitions(index)
        part = f"{out}/{len(parts):08d}"
        rows.mapInArrow(_steps(step, carry, batch, index, arrow), full).write.parquet(part)
        parts.append(part)
        carry = spark.read.schema(full).parquet(part).where("__carry IS NOT NULL").first()["__carry"]
    done = spark.read.schema(full).parquet(*parts).where("__carry IS NULL").drop("__carry")
    return pickle.loads(carry), done


def _steps(step, carry: bytes, batch: int, index: str, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own, number = pickle.loads(carry), [], None

        def made(rows: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if rows is not None and len(rows):
                rows = rows.select([c for c in arrow.names if c != "__carry"]).append_column("__carry", pa.nulls(len(rows), pa.binary()))
                yield from rows.cast(arrow).to_batches()

        for b in batches:
            numbers = b.column(b.schema.get_field_index(index)).to_numpy(zero_copy_only=False) // batch
            at = 0
            while at < b.num_rows:
                end = int((numbers[at:] > numbers[at]).argmax()) + at if numbers[-1] > numbers[at] else b.num_rows
                if number is not None and numbers[at] != number:
                    state, rows = step(state, pa.Table.from_batches(own))
                    yield from made(rows)
                    own = []
                number = numbers[at]
                own.append(b.slice(at, end - at))
                at = end
        if own:
            state, rows = step(state, pa.Table.from_batches(own))
            yield from made(rows)
        last = {c: pa.nulls(1, arrow.field(c).type) for c in arrow.names if c != "__carry"}
        yield pa.RecordBatch.from_arrays([*last.values(), pa.array([pickle.dumps(state)], pa.binary())], schema=pa.schema([f.with_nullable(True) for f in arrow]))

    return run
