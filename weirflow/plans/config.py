"""Configuration: TOML with includes, overrides from the environment, typed schemas, a registry of components."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, tables merged entry by entry."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path, _open: tuple[Path, ...] = ()) -> dict:
    """A TOML file; files named by its ``include`` are read first, and it goes on top. A cycle is an error."""
    path = Path(path).resolve()
    if path in _open:
        raise RecursionError(f"includes in a circle: {' -> '.join(map(str, (*_open, path)))}")
    own = tomllib.loads(path.read_text())
    named = own.pop("include", [])
    out: dict = {}
    for other in [named] if isinstance(named, str) else named:
        out = merged(out, load(path.parent / other, (*_open, path)))
    return merged(out, own)


def scalar(text: str):
    """true/false, whole and decimal numbers, else the text."""
    low = text.strip().lower()
    if low in ("true", "yes", "on"):
        return True
    if low in ("false", "no", "off"):
        return False
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def from_environment(config: dict, prefix: str, env: dict[str, str] | None = None) -> dict:
    """``PREFIX_A__B=x`` sets config["a"]["b"]."""
    out = config
    for k, v in sorted((os.environ if env is None else env).items()):
        if k.startswith(f"{prefix}_"):
            one: object = scalar(v)
            for part in reversed(k[len(prefix) + 1 :].lower().split("__")):
                one = {part: one}
            out = merged(out, one)
    return out


@dataclass(frozen=True)
class Field:
    kind: type | tuple[type, ...]
    default: object = None
    required: bool = False
    check: Callable[[object], bool] | None = None


@dataclass(frozen=True)
class Schema:
    fields: dict[str, Field]

    def validate(self, config: dict) -> dict:
        """The config with defaults; unknown, missing and mistyped fields are named in one error."""
        wrong = [f"unknown: {k}" for k in sorted(set(config) - set(self.fields))]
        out = {}
        for name, f in self.fields.items():
            if name not in config:
                if f.required:
                    wrong.append(f"missing: {name}")
                out[name] = f.default
            else:
                v = out[name] = config[name]
                if not isinstance(v, f.kind) or isinstance(v, bool) and f.kind in (int, float):
                    wrong.append(f"{name}: {type(v).__name__} is not {f.kind}")
                elif f.check is not None and not f.check(v):
                    wrong.append(f"{name}: {v!r} is not allowed")
        if wrong:
            raise ValueError("; ".join(wrong))
        return out


PIPELINE = Schema({"source": Field(dict, required=True), "stages": Field(list, []), "batch_size": Field(int, 32, check=lambda n: n > 0), "last": Field(str, "keep"), "seed": Field(int, 0)})


@dataclass
class Registry:
    """Components by ``type.name``."""

    entries: dict[str, Callable] = field(default_factory=dict)

    def register(self, kind: str, name: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            key = f"{kind}.{name}"
            if key in self.entries:
                raise ValueError(f"{key} is registered already")
            self.entries[key] = f
            return f

        return add

    def get(self, key: str) -> Callable:
        if key not in self.entries:
            raise KeyError(f"no component {key!r}; there are {sorted(self.entries)}")
        return self.entries[key]

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(k for k in self.entries if kind is None or k.startswith(f"{kind}."))

    def create(self, key: str, **options):
        return self.get(key)(**options)

    def info(self, key: str) -> dict[str, str]:
        f = self.get(key)
        return {"name": key, "object": f"{f.__module__}.{f.__qualname__}", "doc": (f.__doc__ or "").strip().split("\n")[0]}


REGISTRY = Registry()
