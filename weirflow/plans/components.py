"""Built-in components under names, and pipelines built from a configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weirflow.operators import augment, base, compose
from weirflow.sources.indexed import from_memory, from_path

from .config import PIPELINE, REGISTRY
from .pipeline import Cursor, Pipeline

for _name in ("Brightness", "Contrast", "Scale", "Noise", "Dropout", "PatchDropout", "Flip", "Crop", "Grayscale", "Solarize", "QuarterTurns", "Rotation", "ColorJitter", "Blur", "ResizedCrop", "ChannelAffine"):
    REGISTRY.register("operator", _name.lower())(getattr(augment, _name))
for _name in ("SplitField", "KeyFilter"):
    REGISTRY.register("operator", _name.lower())(getattr(base, _name))
REGISTRY.register("operator", "probabilistic")(compose.Probabilistic)
REGISTRY.register("source", "file")(from_path)
REGISTRY.register("source", "memory")(from_memory)


@REGISTRY.register("operator", "sql")
def sql(**columns: str):
    """New or changed fields by SQL expressions."""
    return lambda df: df.withColumns({k: F.expr(v) for k, v in columns.items()})


@REGISTRY.register("operator", "where")
def where(condition: str):
    """Rows where a SQL condition holds."""
    return lambda df: df.filter(condition)


def build(spark: SparkSession, config: dict) -> Pipeline:
    """A pipeline from a validated configuration: source {type, ...} and stages [{type, ...}]."""
    c = PIPELINE.validate(config)

    def listed(v):
        return tuple(map(listed, v)) if isinstance(v, list) else v

    source = dict(c["source"])
    src = REGISTRY.create(f"source.{source.pop('type')}", spark=spark, **source)
    stages = []
    for s in c["stages"]:
        s = dict(s)
        stages.append(REGISTRY.create(f"operator.{s.pop('type')}", **{k: listed(v) for k, v in s.items()}))
    return Pipeline(src, stages, c["batch_size"], last=c["last"], cursor=Cursor(seed=c["seed"]))
