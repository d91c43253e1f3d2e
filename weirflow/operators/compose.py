"""Composition: chains, parallel branches with a merge, routing by data or by keyed draws.

All of it is CASE algebra on columns. A chain called on a DataFrame is one ``select`` a child, so that a
child's result is computed once however often the next one mentions it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import keyed

from .base import Operator, Record

Fields = dict[str, Column]
Condition = Callable[[Fields], Column]


@dataclass(frozen=True)
class Sequential(Operator):
    children: tuple[Operator, ...]
    seed: int = 0
    stream: str = "seq"

    def apply(self, r: Record) -> Record:
        out = r
        for i, c in enumerate(self.children):
            out = replace(c.apply(replace(out, tag=f"{r.tag}/{i}")), tag=r.tag)
        return out

    def __call__(self, df: DataFrame) -> DataFrame:
        for i, c in enumerate(self.children):
            df = _Tagged(c, self.seed, f"{self.stream}/{i}")(df)
        return df


@dataclass(frozen=True)
class _Tagged(Operator):
    """A child under the seed and path of its parent."""

    of: Operator
    seed: int
    stream: str

    def apply(self, r: Record) -> Record:
        return self.of.apply(r)


@dataclass
class DynamicSequential(Operator):
    """A chain whose children can be changed between calls."""

    children: list[Operator] = field(default_factory=list)
    seed: int = 0
    stream: str = "seq"

    def add(self, op: Operator, at: int | None = None) -> DynamicSequential:
        self.children.insert(len(self.children) if at is None else at, op)
        return self

    def remove(self, at: int) -> Operator:
        return self.children.pop(at)

    def reorder(self, order: list[int]) -> DynamicSequential:
        if sorted(order) != list(range(len(self.children))):
            raise ValueError("order must name each child once")
        self.children = [self.children[i] for i in order]
        return self

    def clear(self) -> DynamicSequential:
        self.children.clear()
        return self

    def apply(self, r: Record) -> Record:
        return Sequential(tuple(self.children)).apply(r)

    def __call__(self, df: DataFrame) -> DataFrame:
        return Sequential(tuple(self.children), self.seed, self.stream)(df)


def _where(condition: Column, new: Record, old: Record) -> Record:
    """Field by field, ``new`` where the condition holds, else ``old``; fields must be the same."""
    if set(new.fields) != set(old.fields):
        raise ValueError(f"a conditional operator must keep the fields: {sorted(set(new.fields) ^ set(old.fields))}")
    same = {k: v if v is old.fields[k] else F.when(condition, v).otherwise(old.fields[k]) for k, v in new.fields.items()}
    return replace(old, fields=same)


@dataclass(frozen=True)
class When(Operator):
    """The child where the condition over the record holds."""

    condition: Condition
    child: Operator

    def apply(self, r: Record) -> Record:
        return _where(F.coalesce(self.condition(r.fields), F.lit(False)), self.child.apply(r), r)


@dataclass(frozen=True)
class ConditionalSequential(Operator):
    """Child i applies where condition i holds on what the ones before made."""

    children: tuple[Operator, ...]
    conditions: tuple[Condition, ...]
    seed: int = 0
    stream: str = "cond"

    def __post_init__(self) -> None:
        if len(self.children) != len(self.conditions):
            raise ValueError("one condition for each child")

    def _chain(self) -> Sequential:
        return Sequential(tuple(When(k, c) for k, c in zip(self.conditions, self.children)), self.seed, self.stream)

    def apply(self, r: Record) -> Record:
        return self._chain().apply(r)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self._chain()(df)


Merge = Callable[[list[Record], list[Column] | None], Record]


def _zip(records: list[Record], fn: Callable[[list[Column]], Column]) -> Record:
    names = [n for n in records[0].fields if all(n in r.fields for r in records)]
    return replace(records[0], fields={n: fn([r.fields[n] for r in records]) for n in names})


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def merge_concat(records: list[Record], applied: list[Column] | None = None) -> Record:
    """Arrays laid end to end; scalars become an array."""
    return _zip(records, lambda xs: F.concat(*xs))


def merge_stack(records: list[Record], applied: list[Column] | None = None) -> Record:
    return _zip(records, lambda xs: F.array(*xs))


def merge_dict(records: list[Record], applied: list[Column] | None = None) -> Record:
    return _zip(records, lambda xs: F.struct(*(x.alias(f"operator_{i}") for i, x in enumerate(xs))))


def merge_sum(records: list[Record], applied: list[Column] | None = None) -> Record:
    """Sum of the branches; under conditions, of those that apply (0 where none does)."""
    if applied is None:
        return _zip(records, _sum)
    return _zip(records, lambda xs: _sum([F.when(a, x).otherwise(F.lit(0.0)) for a, x in zip(applied, xs)]))


def merge_mean(records: list[Record], applied: list[Column] | None = None) -> Record:
    """Mean of the branches; under conditions, of those that apply, over at least one."""
    if applied is None:
        return _zip(records, lambda xs: _sum(xs) / len(xs))
    n = F.greatest(F.lit(1), _sum([a.cast("int") for a in applied]))
    total = merge_sum(records, applied)
    return replace(total, fields={k: v / n for k, v in total.fields.items()})


MERGES: dict[str, Merge] = {"concat": merge_concat, "stack": merge_stack, "sum": merge_sum, "mean": merge_mean, "dict": merge_dict}


@dataclass(frozen=True)
class Parallel(Operator):
    """All children on the same input, then a merge: a name of :data:`MERGES` or a function of the records."""

    children: tuple[Operator, ...]
    merge: str | Callable[[list[Record]], Record] = "concat"
    seed: int = 0
    stream: str = "par"

    def branches(self, r: Record) -> list[Record]:
        return [c.apply(r.child(i)) for i, c in enumerate(self.children)]

    def apply(self, r: Record) -> Record:
        own = self.branches(r)
        out = MERGES[self.merge](own, None) if isinstance(self.merge, str) else self.merge(own)
        return replace(r, fields=out.fields)


@dataclass(frozen=True)
class ConditionalParallel(Operator):
    """Children on the same input; where its condition fails, a branch passes its input through.

    A sum or mean counts only branches that apply; other merges see the inputs passed through.
    """

    children: tuple[Operator, ...]
    conditions: tuple[Condition, ...]
    merge: str | Callable[[list[Record]], Record] = "mean"
    seed: int = 0
    stream: str = "condpar"

    def apply(self, r: Record) -> Record:
        applied = [F.coalesce(c(r.fields), F.lit(False)) for c in self.conditions]
        own = [c.apply(r.child(i)) for i, c in enumerate(self.children)]
        if self.merge in ("sum", "mean"):
            out = MERGES[self.merge](own, applied)
        else:
            own = [_where(a, x, r) for a, x in zip(applied, own)]
            out = MERGES[self.merge](own, None) if isinstance(self.merge, str) else self.merge(own)
        return replace(r, fields=out.fields)


@dataclass(frozen=True)
class WeightedParallel(Operator):
    """Sum of the branches by weight: given numbers, or entry i of the array field ``weight_key``, which the branches do not see."""

    children: tuple[Operator, ...]
    weights: tuple[float, ...] | None = None
    weight_key: str | None = None
    seed: int = 0
    stream: str = "weighted"

    def __post_init__(self) -> None:
        if (self.weights is None) == (self.weight_key is None):
            raise ValueError("either weights or weight_key")
        if self.weights is not None and len(self.weights) != len(self.children):
            raise ValueError("one weight for each child")

    def apply(self, r: Record) -> Record:
        inner = replace(r, fields={k: v for k, v in r.fields.items() if k != self.weight_key})
        w = [F.lit(x) for x in self.weights] if self.weights is not None else [F.get(r.fields[self.weight_key], F.lit(i)) for i in range(len(self.children))]
        own = [c.apply(inner.child(i)) for i, c in enumerate(self.children)]
        return replace(r, fields=_zip(own, lambda xs: _sum([a * x for a, x in zip(w, xs)])).fields)


@dataclass(frozen=True)
class Ensemble(Operator):
    """Field by field mean, sum, max or min of the children."""

    children: tuple[Operator, ...]
    how: str = "mean"
    seed: int = 0
    stream: str = "ensemble"

    def apply(self, r: Record) -> Record:
        fn = {"mean": lambda xs: _sum(xs) / len(xs), "sum": _sum, "max": lambda xs: F.greatest(*xs), "min": lambda xs: F.least(*xs)}[self.how]
        return replace(r, fields=_zip([c.apply(r.child(i)) for i, c in enumerate(self.children)], fn).fields)


@dataclass(frozen=True)
class Branching(Operator):
    """The child that ``router`` numbers; numbers outside are taken to the nearest child, null to ``default``."""

    children: tuple[Operator, ...]
    router: Callable[[Fields], Column]
    default: int = 0
    seed: int = 0
    stream: str = "branch"

    def apply(self, r: Record) -> Record:
        n = len(self.children)
        number = self.router(r.fields)
        at = F.when(number.isNull(), F.lit(self.default)).otherwise(F.greatest(F.lit(0), F.least(F.lit(n - 1), number)))
        own = [c.apply(r.child(i)) for i, c in enumerate(self.children)]
        if any(set(o.fields) != set(own[0].fields) for o in own):
            raise ValueError("branches must give the same fields")

        def choose(name: str) -> Column:
            out = own[-1].fields[name]
            for i in reversed(range(n - 1)):
                out = F.when(at == i, own[i].fields[name]).otherwise(out)
            return out

        return replace(r, fields={k: choose(k) for k in own[0].fields})


@dataclass(frozen=True)
class Probabilistic(Operator):
    """The child with chance p; its own randomness is independent of the coin."""

    child: Operator
    p: float
    seed: int = 0
    stream: str = "maybe"
    stochastic = True

    def __post_init__(self) -> None:
        if not 0 <= self.p <= 1:
            raise ValueError("p must be in [0, 1]")

    def apply(self, r: Record) -> Record:
        if self.p == 0:
            return r
        new = replace(self.child.apply(r.child(1)), tag=r.tag)
        return new if self.p == 1 else _where(r.uniform(0) < self.p, new, r)


@dataclass(frozen=True)
class Selector(Operator):
    """One child a record, drawn by weight (equal ones by default)."""

    children: tuple[Operator, ...]
    weights: tuple[float, ...] | None = None
    seed: int = 0
    stream: str = "select"
    stochastic = True

    def __post_init__(self) -> None:
        w = self.weights
        if not self.children or w is not None and (len(w) != len(self.children) or min(w) < 0 or sum(w) <= 0):
            raise ValueError("children, and as many weights, not negative and not all 0")

    def apply(self, r: Record) -> Record:
        at = keyed.pick(r.uniform(0), list(self.weights or [1.0] * len(self.children)))
        children = tuple(_Tagged(c, r.seed, r.tag) for c in self.children)
        shifted = [c.apply(r.child(i + 1)) for i, c in enumerate(children)]
        return Branching(tuple(_Fixed(s) for s in shifted), lambda _: at).apply(r)


@dataclass(frozen=True)
class _Fixed(Operator):
    """An operator whose result is known."""

    result: Record

    def apply(self, r: Record) -> Record:
        return self.result
