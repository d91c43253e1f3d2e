"""Pipelines: a source, a graph of stages, and a cursor that resumes exactly.

A pipeline is declared once and is a DataFrame; nothing runs until Spark does. Position is a column, so any
range of it, on any number of partitions, gives the same rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.operators import scan
from weirflow.operators.batching import Batcher
from weirflow.operators.base import IDX
from weirflow.plans.prefetch import Prefetcher
from weirflow.sources.indexed import Source

Stage = Callable[..., DataFrame]


def order_of(edges: dict[str, list[str]], nodes: set[str], sink: str) -> list[str]:
    """Nodes in an order in which each follows its predecessors; all must lead to the sink."""
    unknown = {p for ps in edges.values() for p in ps} - nodes - {"source"} | set(edges) - nodes
    if unknown:
        raise ValueError(f"edges name unknown nodes: {sorted(unknown)}")
    missing = nodes - set(edges)
    if missing:
        raise ValueError(f"nodes without predecessors: {sorted(missing)}")
    done: list[str] = []
    left = dict(edges)
    while left:
        ready = sorted(n for n, ps in left.items() if all(p in done or p == "source" for p in ps))
        if not ready:
            raise ValueError(f"a cycle among {sorted(left)}")
        done += ready
        for n in ready:
            del left[n]
    used, todo = set(), [sink]
    while todo:
        n = todo.pop()
        if n not in used and n != "source":
            used.add(n)
            todo += edges[n]
    if used != nodes:
        raise ValueError(f"nodes that do not lead to {sink!r}: {sorted(nodes - used)}")
    return done


@dataclass(frozen=True)
class Cursor:
    """Where a run stands: positions before ``position`` of ``epoch`` are done."""

    position: int = 0
    epoch: int = 0
    seed: int = 0

    def to_json(self) -> str:
        return json.dumps({"position": self.position, "epoch": self.epoch, "seed": self.seed})

    @staticmethod
    def from_json(text: str) -> Cursor:
        d = json.loads(text)
        if set(d) != {"position", "epoch", "seed"}:
            raise ValueError(f"not a cursor: {sorted(d)}")
        return Cursor(**d)


@dataclass(frozen=True)
class Pipeline:
    """``stages``: a chain, or with ``edges`` a graph of named stages with one sink.

    A stage is a function of one DataFrame for each predecessor; ``source`` names the source.
    """

    source: Source
    stages: list[Stage] | dict[str, Stage]
    batch_size: int
    edges: dict[str, list[str]] | None = None
    sink: str | None = None
    last: str = "keep"
    cursor: Cursor = field(default_factory=Cursor)

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if isinstance(self.stages, dict):
            if self.edges is None or self.sink is None:
                raise ValueError("a graph needs edges and a sink")
            order_of(self.edges, set(self.stages), self.sink)

    @property
    def batches(self) -> int:
        return Batcher(self.batch_size, self.last).count(len(self.source))

    def rows(self) -> DataFrame:
        """The rest of the epoch, from the cursor on, through all stages."""
        df = self.source.epoch(self.cursor.epoch)
        return self._through(df.filter(F.col("__pos") >= self.cursor.position) if self.cursor.position else df)

    def _through(self, df: DataFrame) -> DataFrame:
        if not isinstance(self.stages, dict):
            for s in self.stages:
                df = s(df)
            return df
        made = {"source": df}
        for n in order_of(self.edges, set(self.stages), self.sink):
            made[n] = self.stages[n](*(made[p] for p in self.edges[n]))
        return made[self.sink]

    def batched(self) -> DataFrame:
        """``rows`` with batch_id, slot and valid."""
        n = len(self.source)
        d = self.rows().withColumn("__row", F.col(IDX)).withColumn(IDX, F.col("__pos"))
        b = Batcher(self.batch_size, self.last)
        return b.assign(d, n).withColumn(IDX, F.col("__row")).drop("__row")

    def at(self, batch: int) -> DataFrame:
        """One batch by number: a range of positions."""
        lo = batch * self.batch_size
        return self._through(self.source.batch_at(lo, min(self.batch_size, len(self.source) - lo), self.cursor.epoch))

    def __iter__(self) -> Iterator[DataFrame]:
        for b in range(self.cursor.position // self.batch_size, self.batches):
            yield self.at(b)

    def local_batches(self, ahead: int = 2, per_job: int = 8) -> Prefetcher:
        """Rows of each batch on the driver, in order: jobs over ranges of positions, started ahead (see :class:`Prefetcher`)."""
        return Prefetcher(self._range, self.cursor.position, len(self.source), self.batch_size, self.last, ahead, per_job)

    def _range(self, start: int, stop: int) -> list:
        rows = self._through(self.source.batch_at(start, stop - start, self.cursor.epoch))
        return sorted(rows.collect(), key=lambda r: r["__pos"])

    def advanced(self, batches: int = 1) -> Pipeline:
        """The same pipeline, so many batches on; past the end a new epoch begins."""
        pos = self.cursor.position + batches * self.batch_size
        if pos >= len(self.source):
            return replace(self, cursor=replace(self.cursor, position=0, epoch=self.cursor.epoch + 1))
        return replace(self, cursor=replace(self.cursor, position=pos))

    def resumed(self, cursor: Cursor) -> Pipeline:
        if not 0 <= cursor.position <= len(self.source):
            raise ValueError("the cursor is outside the source")
        return replace(self, cursor=cursor)

    def fingerprint(self) -> str:
        """Of what must be equal for a cursor to mean the same rows: schema, length, order, batch size."""
        what = [self.source.df.schema.json(), len(self.source), self.source.shuffle_seed, self.batch_size, self.last]
        return hashlib.sha256(json.dumps(what).encode()).hexdigest()

    def prefix(self, carries: dict[str, scan.Carry]) -> DataFrame:
        """``rows`` plus running values in the order of positions, by a scan in two passes."""
        return scan.prefix(self.rows(), carries, "__pos")

    def scan(self, step: Callable[[object, pa.Table], tuple[object, pa.Table | None]], start: object, schema: str | StructType, per_range: int = 1 << 20) -> tuple[object, DataFrame]:
        """(last carry, rows that the steps gave): any step over the batches in order, on executors, range after range."""
        carry, rows = scan.carried(self.rows(), step, start, schema, self.batch_size, "__pos", per_range)
        return carry, rows

    def fold(self, step: Callable[[object, list], object], start: object, per_range: int = 1 << 20) -> object:
        """``step`` over the rows of the batches in order, for the carry alone; rows stay on the executors."""

        def one(carry: object, batch: pa.Table) -> tuple[object, None]:
            return step(carry, [Row(**r) for r in batch.to_pylist()]), None

        return self.scan(one, start, "none int", per_range)[0]


def merge_mean(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Two branches of one source joined again by index, the named fields averaged."""
    r = right.select(F.col(IDX).alias("__i"), *[F.col(c).alias(f"__r_{c}") for c in names])
    d = left.join(r, F.col(IDX) == F.col("__i"))
    return d.withColumns({c: (F.col(c) + F.col(f"__r_{c}")) / 2 for c in names}).drop("__i", *[f"__r_{c}" for c in names])
