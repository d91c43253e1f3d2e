"""Batches for the driver, in order, fetched ahead: no global sort, bounded memory, errors where they belong.

A job fetches the rows of some batches, a range of positions. ``ahead`` jobs run in threads while earlier batches are
consumed; a job is started only when one before it has been taken, so at most ``ahead`` + 1 ranges are in memory, however slow
the consumer. An error of a job is raised at the batch where its range begins, after all batches before it. ``close`` (or the end of
a ``with`` block) starts no more jobs, cancels those that run and lets the threads end; a second ``close`` does nothing.
"""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import InheritableThread, SparkContext


class Prefetcher:
    """Iterates over lists of rows; ``fetch(start, stop)`` gives the rows at these positions, in order."""

    def __init__(self, fetch: Callable[[int, int], list], start: int, stop: int, batch_size: int, last: str = "keep", ahead: int = 2, per_job: int = 8) -> None:
        if ahead < 1 or per_job < 1 or batch_size < 1:
            raise ValueError("ahead, per_job and batch_size must be at least 1")
        self._fetch, self._next, self._stop, self._size, self._last = fetch, start, stop, batch_size, last
        self._step = batch_size * per_job
        self._ahead, self._jobs = ahead, deque()
        self._pool = ThreadPoolExecutor(ahead, "prefetch")
        self._group, self._closed = f"prefetch-{uuid.uuid4().hex}", threading.Event()
        self._rows: deque = deque()
        #: Ranges whose job has been started.
        self.started = 0

    def _run(self, start: int, stop: int) -> list:
        if self._closed.is_set():
            return []
        sc = SparkContext._active_spark_context
        if sc is None:
            return self._fetch(start, stop)
        out: list = []

        def job() -> None:
            sc.setJobGroup(self._group, f"positions {start} to {stop - 1}", interruptOnCancel=True)
            try:
                out.append(self._fetch(start, stop))
            except BaseException as e:  # noqa: BLE001  raised again where the batch is taken
                out.append(e)

        t = InheritableThread(target=job)
        t.start()
        t.join()
        if isinstance(out[0], BaseException):
            raise out[0]
        return out[0]

    def _fill(self) -> None:
        while len(self._jobs) < self._ahead and self._next < self._stop and not self._closed.is_set():
            end = min(self._next + self._step, self._stop)
            self._jobs.append(self._pool.submit(self._run, self._next, end))
            self._next, self.started = end, self.started + 1

    def __iter__(self) -> Iterator[list]:
        return self

    def __next__(self) -> list:
        while not self._closed.is_set():
            self._fill()
            if not self._rows:
                if not self._jobs:
                    self.close()
                    break
                job: Future = self._jobs.popleft()
                try:
                    self._rows.extend(job.result())
                except BaseException:
                    self.close()
                    raise
                self._fill()
                continue
            own = [self._rows.popleft() for _ in range(min(self._size, len(self._rows)))]
            if len(own) == self._size or self._last != "drop":
                return own
        raise StopIteration

    def close(self) -> None:
        if not self._closed.is_set():
            self._closed.set()
            for job in self._jobs:
                job.cancel()
            sc = SparkContext._active_spark_context
            if sc is not None and any(not j.done() for j in self._jobs):
                sc.cancelJobGroup(self._group)
            self._jobs.clear()
            self._rows.clear()
            self._pool.shutdown(wait=False, cancel_futures=True)

    def __enter__(self) -> Prefetcher:
        return self

    def __exit__(self, *_) -> None:
        self.close()
