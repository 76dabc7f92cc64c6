"""Stored tables: extraction records, gold labels, labelling sheets, reference data, run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard import schemas
from laneguard.session import scratch_path

TS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def round_trip(df: DataFrame, fmt: str) -> DataFrame:
    """Write and read back in the given format with the same schema."""
    path = scratch_path(df.sparkSession, "table")
    df.write.format(fmt).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").mode("overwrite").save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).option("timestampNTZFormat", TS).load(path)


def save_records(records: DataFrame, path: str) -> None:
    """One folder per model and prompt version."""
    (
        records.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .partitionBy("model", "prompt_version").json(path)
    )


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RECORD).option("timestampNTZFormat", TS).json(path)


def save_gold(gold: DataFrame, path: str) -> None:
    gold.write.mode("overwrite").json(path)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GOLD).json(path)


_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}


def save_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**{k: v for k, v in _CSV.items() if k != "multiLine"}).option("emptyValue", '""').csv(path)


def load_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Sheet rows; columns an older sheet lacks come back empty, and a byte-order mark is dropped."""
    raw = spark.read.options(**_CSV).csv(path)
    named = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns])
    have = set(named.columns)
    return named.select(*[(F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")).alias(c) for c in schemas.SHEET_COLUMNS])
