"""Statistics of a run from the run itself: how many rows each operator of a chain saw, applied to and skipped, and whatever else is asked for.

Metrics are aggregates that Spark collects while rows pass (``observe``): no second pass and no collect. A :class:`Recorder` holds
them; on batches they are there when the action has ended, on streams a listener adds up the micro-batches as they end.
Tasks that are run again after an executor is lost are counted by Spark once where they give a result, and may be counted again where they feed a
shuffle; place what is observed accordingly.

A row counts as applied where the operator decides to change it: the condition of a conditional one, the coin of a probabilistic one; other operators apply to all rows. A condition that is
null counts as skipped, for the operator skips it.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from weirflow.operators.base import IDX, Operator, Record
from weirflow.operators.compose import ConditionalSequential, Probabilistic, Sequential, When, _Tagged
from weirflow.plans.metrics import Collector


def decision(op: Operator, r: Record) -> Column:
    """Whether ``op`` applies to a record."""
    if isinstance(op, When):
        return F.coalesce(op.condition(r.fields), F.lit(False))
    if isinstance(op, Probabilistic):
        return F.lit(op.p == 1) if op.p in (0, 1) else r.uniform(0) < op.p
    return F.lit(True)


class _Listener(StreamingQueryListener):
    def __init__(self, recorder: Recorder) -> None:
        self.recorder = recorder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.recorder._add(name, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Recorder:
    """What operators report. ``tell(name, metrics)`` is called as reports come in; ``collector`` gets each number as a metric."""

    def __init__(self, tell: Callable[[str, dict], None] | None = None, collector: Collector | None = None) -> None:
        self._tell, self._collector = tell, collector
        self._mark = uuid.uuid4().hex[:8]
        self._batches: dict[str, Observation] = {}
        self._streams: dict[str, dict] = {}
        self._names: list[str] = []
        self._told: set[str] = set()
        self._lock = threading.Lock()
        self._listening = None

    def watch(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """``df``, with aggregates of its rows reported under ``name``. On streams these are added up over micro-batches: sums and counts."""
        if name in self._names:
            raise ValueError(f"{name!r} is watched already")
        self._names.append(name)
        exprs = [c.alias(k) for k, c in metrics.items()]
        if not df.isStreaming:
            self._batches[name] = Observation(f"{self._mark}/{name}")
            return df.observe(self._batches[name], *exprs)
        if self._listening is None:
            self._listening = (df.sparkSession, _Listener(self))
            df.sparkSession.streams.addListener(self._listening[1])
        return df.observe(f"{self._mark}/{name}", *exprs)

    def _add(self, full: str, values: dict) -> None:
        mark, _, name = full.partition("/")
        if mark != self._mark:
            return
        with self._lock:
            own = self._streams.setdefault(name, {})
            for k, v in values.items():
                own[k] = own.get(k, 0) + (v or 0)
        self._report(name, values)

    def _report(self, name: str, values: dict) -> None:
        if self._tell:
            self._tell(name, values)
        if self._collector:
            for k, v in values.items():
                if v is not None:
                    self._collector.record(name, k, v)

    def results(self) -> dict[str, dict]:
        """Reports by name, in the order of watching. Of batches: waits for the first action on what is watched."""
        out = {}
        for name in self._names:
            if name in self._batches:
                out[name] = self._batches[name].get
                if name not in self._told:
                    self._told.add(name)
                    self._report(name, out[name])
            else:
                with self._lock:
                    out[name] = dict(self._streams.get(name, {}))
        return out

    def close(self) -> None:
        if self._listening is not None:
            self._listening[0].streams.removeListener(self._listening[1])
            self._listening = None


def observed(op: Operator, recorder: Recorder, name: str = "") -> Callable[[DataFrame], DataFrame]:
    """``op`` as it is, reporting ``rows``, ``applied`` and ``skipped`` for itself, or for each child of a chain (``0 When``, ``1 Probabilistic``, ...)."""
    if isinstance(op, ConditionalSequential):
        op = op._chain()
    chain = isinstance(op, Sequential)
    parts = [_Tagged(c, op.seed, f"{op.stream}/{i}") for i, c in enumerate(op.children)] if chain else [op]

    def run(df: DataFrame) -> DataFrame:
        for i, part in enumerate(parts):
            own = part.of if chain else part
            fields = {c: F.col(f"`{c}`") for c in df.columns if c != IDX}
            hit = decision(own, Record(fields, F.col(IDX) if IDX in df.columns else None, part.seed, part.stream))
            label = f"{name + ' ' if name else ''}{i} {type(own).__name__}"
            df = part(recorder.watch(df, label, rows=F.count("*"), applied=F.count_if(hit), skipped=F.count_if(~hit)))
        return df

    return run
