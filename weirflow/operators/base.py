"""Records as named columns, and the base of all operators.

An operator maps a :class:`Record`, a bundle of Column expressions, to another. Called with a DataFrame it
becomes one ``select``, which Catalyst fuses with its neighbours. Randomness reaches an operator as
(seed, tag, index) through the record, so it does not depend on how the rows are laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import keyed

IDX = "__idx"


@dataclass(frozen=True)
class Record:
    """Field expressions, the index they are keyed by, and the path of operators down to here."""

    fields: dict[str, Column]
    idx: Column | None = None
    seed: int = 0
    tag: str = "op"

    def child(self, i: int | str) -> Record:
        return replace(self, tag=f"{self.tag}/{i}")

    def with_fields(self, **new: Column) -> Record:
        return replace(self, fields={**self.fields, **new})

    def uniform(self, what: int | str = 0) -> Column:
        if self.idx is None:
            raise ValueError(f"a random operator needs the index column {IDX!r}")
        return keyed.uniform(self.idx, f"{self.tag}/{what}", self.seed)

    def normal(self, what: int | str = 0) -> Column:
        if self.idx is None:
            raise ValueError(f"a random operator needs the index column {IDX!r}")
        return keyed.normal(self.idx, f"{self.tag}/{what}", self.seed)


class Operator:
    """Base: define ``apply``; ``stochastic`` ones need an index and have a seed and a stream name."""

    stochastic = False
    seed: int = 0
    stream: str = "op"

    def apply(self, record: Record) -> Record:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        idx = F.col(IDX) if IDX in df.columns else None
        fields = {c: F.col(f"`{c}`") for c in df.columns if c != IDX}
        out = self.apply(Record(fields, idx, self.seed, self.stream)).fields
        return df.select(*([idx] if idx is not None else []), *(v.alias(k) for k, v in out.items()))

    def then(self, other: Operator) -> Operator:
        from .compose import Sequential

        return Sequential((self, other))


@dataclass(frozen=True)
class Map(Operator):
    """``fn(column)`` on every field, or on those in ``only``; a dotted name is a field inside a struct."""

    fn: Callable[[Column], Column]
    only: tuple[str, ...] | None = None

    def apply(self, r: Record) -> Record:
        names = self.only if self.only is not None else tuple(r.fields)
        out = dict(r.fields)
        for n in names:
            top, _, rest = n.partition(".")
            if top not in out:
                raise KeyError(f"no field {n!r}; there are {sorted(out)}")
            out[top] = out[top].withField(rest, self.fn(out[top].getField(rest) if "." not in rest else _deep(out[top], rest))) if rest else self.fn(out[top])
        return replace(r, fields=out)


def _deep(c: Column, path: str) -> Column:
    for p in path.split("."):
        c = c.getField(p)
    return c


@dataclass(frozen=True)
class KeyedMap(Operator):
    """``fn(column, uniform)`` on every field in ``only``: each field has a draw of its own."""

    fn: Callable[[Column, Column], Column]
    only: tuple[str, ...]
    seed: int = 0
    stream: str = "map"
    stochastic = True

    def apply(self, r: Record) -> Record:
        return r.with_fields(**{n: self.fn(r.fields[n], r.uniform(i)) for i, n in enumerate(self.only)})


@dataclass(frozen=True)
class ElementFn(Operator):
    """``fn(fields, draw)`` gives new or changed fields of the record; ``draw(name)`` is a keyed uniform."""

    fn: Callable[[dict[str, Column], Callable[[str], Column]], dict[str, Column]]
    seed: int = 0
    stream: str = "element"

    def apply(self, r: Record) -> Record:
        return r.with_fields(**self.fn(dict(r.fields), r.uniform))


@dataclass(frozen=True)
class SplitField(Operator):
    """The named fields; ones that are not there are skipped."""

    names: tuple[str, ...]

    def apply(self, r: Record) -> Record:
        return replace(r, fields={n: r.fields[n] for n in self.names if n in r.fields})


@dataclass(frozen=True)
class KeyFilter(Operator):
    """Keep the fields of ``include``, or drop those of ``exclude``; not both."""

    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.include is not None and self.exclude is not None:
            raise ValueError("include and exclude exclude each other")

    def apply(self, r: Record) -> Record:
        if self.include is not None:
            return replace(r, fields={k: v for k, v in r.fields.items() if k in self.include})
        return replace(r, fields={k: v for k, v in r.fields.items() if k not in (self.exclude or ())})


@dataclass(frozen=True)
class Remap(Operator):
    """Write ``fn(fields[source])`` to ``target`` (default: in place), clamped to ``clip`` where given."""

    source: str
    fn: Callable[[Column], Column] = lambda c: c
    target: str | None = None
    clip: tuple[float, float] | None = None

    def apply(self, r: Record) -> Record:
        top, _, rest = self.source.partition(".")
        if top not in r.fields:
            raise KeyError(f"no field {self.source!r}; there are {sorted(r.fields)}")
        x = self.fn(_deep(r.fields[top], rest) if rest else r.fields[top])
        if self.clip is not None:
            x = clamp(x, *self.clip)
        return r.with_fields(**{self.target or top: x} if self.target or not rest else {top: r.fields[top].withField(rest, x)})


@dataclass(frozen=True)
class CrossModal(Operator):
    """``fn`` of several fields gives several: the fields in ``inputs``, in order, to those in ``outputs``."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    fn: Callable[..., Iterable[Column]]

    def apply(self, r: Record) -> Record:
        missing = [n for n in self.inputs if n not in r.fields]
        if missing:
            raise KeyError(f"no fields {missing}")
        got = list(self.fn(*(r.fields[n] for n in self.inputs)))
        if len(got) != len(self.outputs):
            raise ValueError(f"{len(got)} results for {len(self.outputs)} outputs")
        return r.with_fields(**dict(zip(self.outputs, got)))


@dataclass(frozen=True)
class PandasFn(Operator):
    """``fn(series, seeds)`` of one field by Arrow batches, for functions from outside; seeds are 64-bit, one a record."""

    source: str
    fn: Callable
    returns: str
    target: str | None = None
    seed: int = 0
    stream: str = "pandas"
    keyed: bool = False

    def apply(self, r: Record) -> Record:
        fn, with_key = self.fn, self.keyed

        def run(x: pd.Series, k: pd.Series) -> pd.Series:
            return fn(x, k) if with_key else fn(x)

        key = F.xxhash64(F.lit(self.seed), F.lit(r.tag), r.idx) if with_key else F.lit(0).cast("long")
        udf = F.pandas_udf(run, self.returns)
        return r.with_fields(**{self.target or self.source: udf(r.fields[self.source], key)})


@dataclass(frozen=True)
class SelectRows:
    """Rows where the condition over fields holds."""

    condition: Callable[[dict[str, Column]], Column]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition({c: F.col(f"`{c}`") for c in df.columns}))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def iterate(df: DataFrame, op: Callable[[DataFrame], DataFrame], n: int, cut_every: int = 50) -> DataFrame:
    """``op`` applied n times; long chains are cut by a checkpoint, for plans grow with them."""
    if n < 0:
        raise ValueError("n must not be negative")
    for i in range(n):
        df = op(df)
        if (i + 1) % cut_every == 0 and i + 1 < n and df.sparkSession.sparkContext.getCheckpointDir():
            df = df.checkpoint()
    return df


def iterate_while(df: DataFrame, holds: Callable[[DataFrame], bool], op: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """``op`` while ``holds(df)``, which is an action, at most ``most`` times."""
    for _ in range(most):
        if not holds(df):
            break
        df = op(df)
    return df


def branch_on(df: DataFrame, condition: bool, if_true: Callable[[DataFrame], DataFrame], if_false: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return if_true(df) if condition else if_false(df)
