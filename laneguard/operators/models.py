"""Fitted pipelines kept by what they were fitted on, so that a data set is trained on once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneguard.session import scratch_root
from laneguard.sources.news import path_exists


def fingerprint(data: DataFrame) -> str:
    """Number of rows and an order-free sum of row hashes, in one pass without a shuffle of rows."""
    row = F.xxhash64(*[F.col(c) for c in sorted(data.columns)]).cast("decimal(38,0)")
    n, total = data.agg(F.count(F.lit(1)), F.sum(row)).first()
    return f"{n}:{total}:{','.join(f'{f.name} {f.dataType.simpleString()}' for f in sorted(data.schema, key=lambda f: f.name))}"


def fit_once(name: str, data: DataFrame, settings: dict, fit: Callable[[DataFrame], PipelineModel], folder: str | None = None) -> PipelineModel:
    """``fit(data)``, or the model that an earlier call saved for the same rows and settings.

    Models are saved whole (``Pipeline`` persistence) in ``folder``, the shared scratch area by default. A save that broke
    off has no pipeline metadata and is replaced.
    """
    spark = data.sparkSession
    key = hashlib.sha256(json.dumps([name, settings, fingerprint(data)], sort_keys=True).encode()).hexdigest()[:32]
    path = f"{folder or scratch_root(spark) + '/laneguard/models'}/{name}-{key}"
    if path_exists(spark, f"{path}/_COMPLETE"):
        return PipelineModel.load(path)
    model = fit(data)
    model.write().overwrite().save(path)
    spark.range(1).select(F.lit(key).alias("value")).write.mode("overwrite").text(f"{path}/_COMPLETE")
    return model
