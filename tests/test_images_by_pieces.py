"""Image functions work on pieces of a batch, and once an image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.functions import image
from weirflow.plans import catalog, workloads  # noqa: F401


def test_pieces_and_nulls(spark):
    """No call sees more than the bound of entries, whatever the batch; nulls, and batches of nulls alone, stay."""
    n, shape = 4000, (8, 8, 3)
    df = spark.range(0, n, 1, 1).select("id", F.when(F.col("id") % 7 != 3, F.transform(F.sequence(F.lit(1), F.lit(192)), lambda k: (k * F.col("id")).cast("double"))).alias("x"))
    most = image.ENTRIES

    def seen(x, u):
        assert x.shape[1:] == shape and x.shape[0] == len(u)
        return np.stack([np.full(len(u), float(x.size)), x.sum(axis=(1, 2, 3)) + u], 1)

    got = df.select("id", image.over(seen, shape)("x", "id").alias("y")).collect()
    assert len(got) == n and max(r["y"][0] for r in got if r["y"]) <= most
    assert all(r["y"] is None if r["id"] % 7 == 3 else r["y"][1] == 192 * 193 / 2 * r["id"] + r["id"] for r in got)
    none = df.where("id % 7 = 3").select(image.over(seen, shape)("x", "id").alias("y")).collect()
    assert none and all(r["y"] is None for r in none)
    assert df.where("id < 0").select(image.over(seen, shape)("x", "id").alias("y")).collect() == []


@pytest.mark.parametrize("name", ["image_poisson", "image_resized_crop", "image_rotation_fixed", "image_blur"])
def test_made_once(spark, small, name):
    plan = catalog.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
