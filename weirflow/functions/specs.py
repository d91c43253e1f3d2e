"""Schemas as specifications of one record: shapes and types, checked before anything runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def leaves(kind: DataType, path: str = "") -> Iterator[tuple[str, DataType]]:
    """Dotted paths and types of all fields that hold values; arrays are one field."""
    if isinstance(kind, StructType):
        for f in kind:
            yield from leaves(f.dataType, f"{path}.{f.name}" if path else f.name)
    else:
        yield path, kind


def element_spec(df: DataFrame) -> dict[str, tuple[tuple[int | None, ...], str]]:
    """Path: (shape, type). Shapes come from the field's metadata (``shape``); dimensions of plain arrays are unknown (None)."""
    shapes = {f.name: tuple(f.metadata["shape"]) for f in df.schema if "shape" in f.metadata}
    out = {}
    for path, kind in leaves(df.schema):
        depth = 0
        while isinstance(kind, ArrayType):
            kind, depth = kind.elementType, depth + 1
        out[path] = (shapes.get(path, (None,) * depth), kind.simpleString())
    return out


def batch_spec(df: DataFrame, size: int, valid: bool = False) -> dict[str, tuple[tuple[int | None, ...], str]]:
    """The same with a leading axis, and a mask of rows that count."""
    out = {k: ((size, *shape), kind) for k, (shape, kind) in element_spec(df).items()}
    return out | ({"valid": ((size,), "boolean")} if valid else {})


def with_shape(df: DataFrame, name: str, shape: tuple[int, ...]) -> DataFrame:
    """A flattened array field declared to have a shape."""
    return df.withColumn(name, F.col(name).alias(name, metadata={"shape": list(shape)}))


def same_structure(a: DataFrame, b: DataFrame) -> None:
    x, y = element_spec(a), element_spec(b)
    if x != y:
        raise ValueError(f"fields differ: {sorted(set(x.items()) ^ set(y.items()), key=str)}")


@dataclass(frozen=True)
class TimeSeries:
    """A driver of ``length`` steps and a solution sampled at every ``factor``-th of them."""

    length: int
    factor: int = 1

    def __post_init__(self) -> None:
        if self.length < 1 or self.factor < 1 or self.length % self.factor:
            raise ValueError("length and factor are at least 1, and length a multiple of factor")

    @property
    def solution(self) -> int:
        return self.length // self.factor

    def holds(self, driver: Column, solution: Column) -> Column:
        """Whether a record's arrays have these lengths."""
        return (F.size(driver) == self.length) & (F.size(solution) == self.solution)
