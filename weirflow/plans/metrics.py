"""Metrics: timed records, observers, reports to console or file."""

from __future__ import annotations

import json
import sys
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import TextIO


@dataclass(frozen=True)
class Metric:
    component: str
    name: str
    value: float
    at: float


def summary(metrics: list[Metric]) -> dict[str, dict[str, float | None]]:
    """By component.name: avg, min, max, sum, count and rate (count over the span of times; None under two or without one)."""
    groups: dict[str, list[Metric]] = defaultdict(list)
    for m in metrics:
        groups[f"{m.component}.{m.name}"].append(m)
    out = {}
    for k, own in groups.items():
        v, t = [m.value for m in own], [m.at for m in own]
        span = max(t) - min(t)
        out[k] = {"avg": sum(v) / len(v), "min": min(v), "max": max(v), "sum": sum(v), "count": len(v), "rate": len(v) / span if len(v) > 1 and span > 0 else None}
    return out


@dataclass
class Collector:
    enabled: bool = True
    clock: Callable[[], float] = time.time
    metrics: list[Metric] = field(default_factory=list)
    observers: list[Callable[[Metric], None]] = field(default_factory=list)

    def record(self, component: str, name: str, value: float) -> None:
        if self.enabled:
            m = Metric(component, name, float(value), self.clock())
            self.metrics.append(m)
            for o in self.observers:
                o(m)

    @contextmanager
    def timed(self, component: str, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.record(component, name, time.perf_counter() - start)

    def clear(self) -> None:
        self.metrics.clear()


@dataclass
class Reporter:
    """An observer that writes a summary at most once in ``every`` seconds, to a stream or as JSON lines to a file."""

    collector: Collector
    every: float = 10.0
    to: TextIO | str = sys.stdout
    _last: float = float("-inf")

    def __call__(self, metric: Metric) -> None:
        if metric.at - self._last >= self.every:
            self._last = metric.at
            self.flush()

    def flush(self) -> None:
        s = summary(self.collector.metrics)
        if isinstance(self.to, str):
            with Path(self.to).open("a") as f:
                f.write(json.dumps(s) + "\n")
        else:
            for k, v in sorted(s.items()):
                print(f"{k}: avg {v['avg']:.4g}, count {v['count']}", file=self.to)

    def raw(self) -> list[dict]:
        return [asdict(m) for m in self.collector.metrics]
