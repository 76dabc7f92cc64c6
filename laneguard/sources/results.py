"""Replay specification, per-day extraction store and run results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard.operators.replay import Disruption, Params, Spec

SPEC = (
    "params struct<lookback_days: int, threshold: double, window_before_days: int, window_after_days: int>, primary_lane string, "
    "secondary_lane_focus array<string>, disruptions array<struct<id: string, name: string, onset: date, "
    "secondary_reference: struct<label: string, date: date>, target_nodes: array<string>>>, control_windows array<struct<start: date, end: date>>"
)


def load_spec(spark: SparkSession, path: str) -> Spec:
    """A replay specification from its JSON document (a handful of windows)."""
    doc = spark.read.schema(SPEC).option("multiLine", "true").json(path).first()
    disruptions = tuple(
        Disruption(x.id, x.onset, tuple(x.target_nodes or ()), x.name or "", x.secondary_reference and x.secondary_reference.label,
                   x.secondary_reference and x.secondary_reference.date)
        for x in doc.disruptions or ()
    )
    windows = tuple((w.start, w.end) for w in doc.control_windows or ())
    return Spec(Params(**doc.params.asDict()), disruptions, windows, doc.primary_lane, tuple(doc.secondary_lane_focus or ()))


def save_run(rows: DataFrame, path: str, run: str) -> None:
    rows.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def load_runs(spark: SparkSession, path: str, drop: tuple[str, ...] = ("signals",)) -> DataFrame:
    """Saved run results without the daily series."""
    runs = spark.read.parquet(path)
    return runs.drop(*[c for c in drop if c in runs.columns])
