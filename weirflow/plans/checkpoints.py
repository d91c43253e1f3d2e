"""Cursors in shared storage: one JSON file a step, only the newest kept, refused for another pipeline.

Files go through the file systems that Spark knows, so a folder may be of any store that the cluster shares.
"""

from __future__ import annotations

import json
import re
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .pipeline import Cursor, Pipeline


class CheckpointMismatchError(ValueError):
    """The checkpoint is of another pipeline."""


class Folder:
    """Small files of a folder in any store that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self._fs.exists(self._at("")) else []

    def write(self, name: str, data: bytes) -> str:
        """Written aside, then renamed: a file is there whole or not at all."""
        aside = self._at(f".{name}.new")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(aside, self._at(name)):
            raise OSError(f"{self.path}/{name} could not be written")
        return f"{self.path}/{name}"

    def read(self, name: str) -> bytes:
        if not self._fs.exists(self._at(name)):
            raise FileNotFoundError(f"no {name} in {self.path}")
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Checkpoints:
    """``ckpt-<step>.json`` files below ``folder``, the newest ``keep`` of them."""

    spark: SparkSession
    folder: str
    keep: int = 5

    @property
    def _files(self) -> Folder:
        return Folder(self.spark, self.folder)

    def steps(self) -> list[int]:
        return sorted(int(m[1]) for n in self._files.names() if (m := re.fullmatch(r"ckpt-(\d+)\.json", n)))

    def latest(self) -> int | None:
        return max(self.steps(), default=None)

    def save(self, step: int, pipeline: Pipeline, metadata: dict | None = None) -> str:
        state = {"fingerprint": pipeline.fingerprint(), "cursor": json.loads(pipeline.cursor.to_json()), "metadata": metadata or {}}
        at = self._files.write(f"ckpt-{step}.json", json.dumps(state).encode())
        for old in self.steps()[: -self.keep]:
            self._files.delete(f"ckpt-{old}.json")
        return at

    def save_async(self, step: int, pipeline: Pipeline, metadata: dict | None = None) -> Future[str]:
        """Saved by a thread of its own; the result says where, or raises what went wrong. The cursor is that of the call."""
        pool = ThreadPoolExecutor(1, "checkpoint")
        try:
            return pool.submit(self.save, step, pipeline, metadata)
        finally:
            pool.shutdown(wait=False)

    def save_every(self, step: int, interval: int, pipeline: Pipeline) -> str | None:
        return self.save(step, pipeline) if step % interval == 0 else None

    def restore(self, pipeline: Pipeline, step: int | None = None) -> Pipeline:
        step = self.latest() if step is None else step
        if step is None:
            raise FileNotFoundError(f"no checkpoint in {self.folder}")
        state = json.loads(self._files.read(f"ckpt-{step}.json"))
        if state["fingerprint"] != pipeline.fingerprint():
            raise CheckpointMismatchError("the checkpoint is of a pipeline with another source, order or batch size")
        return pipeline.resumed(Cursor(**state["cursor"]))
