"""Ranks over whole listings without a window that grows with a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneguard.session import materialize


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", salt: Column | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in the order of their key; without ``keys`` in one order of all rows.

    Rows are range-partitioned by keys and order, so a key with half of all rows lies in many parts. Counts per key and
    part give each part's first rank, and rows are ranked inside their part only. Rows equal in keys and order could
    not be told apart by ranges: a ``salt`` (any column of theirs) splits many such rows. Null keys are a key.
    """
    ends = [*order, *([salt] if salt is not None else [])]
    cols = [F.col(k) for k in keys]
    parts = materialize(rows.repartitionByRange(*cols, *ends).withColumn("__part", F.spark_partition_id()), "rank-parts")
    counts = parts.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    first = counts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*ends))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = parts.withColumn("__inside", inside).join(first, same)
    return out.select(*rows.columns, (F.col("__first") + F.col("__inside")).cast("long").alias(name))
