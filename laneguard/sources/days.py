"""Day store: extraction records in one partition per day, with a manifest of what became of every day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard import schemas
from laneguard.session import materialize
from laneguard.sources.news import path_exists

RECORDS, MANIFEST = "records", "manifest"
RECORD_COLUMNS = ("news_id", "model", "prompt_version", "status", "is_disruption", "events", "error")
STATUS = "status string, items bigint, events bigint, failed bigint, day date"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """day, status (ok / missing / no_items), items, events, failed of every day that was asked for so far."""
    own = f"{path}/{MANIFEST}"
    return spark.read.schema(STATUS).parquet(own) if path_exists(spark, own) else spark.createDataFrame([], STATUS)


def load_days(spark: SparkSession, path: str) -> DataFrame:
    """Stored records with their day, those of finished days only."""
    own = f"{path}/{RECORDS}"
    schema = f"{schemas.RECORD}, day date"
    rows = spark.read.schema(schema).parquet(own) if path_exists(spark, own) else spark.createDataFrame([], schema)
    return rows.join(load_manifest(spark, path).filter("status = 'ok'").select("day"), "day", "left_semi")


def _replace_days(rows: DataFrame, path: str) -> None:
    """Writes whole days over whatever an interrupted run left of them; other days stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def finish_days(items: DataFrame, days: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Runs ``extract`` for the asked days that the store has not finished and returns the days it worked on.

    ``items`` are news with a ``day``; ``days(day, landed)`` are the days asked for, and whether their export is there.
    A day that has not landed is ``missing`` and tried again by the next run; one without items is ``no_items`` and
    done, as one with records is. Records are written before the manifest and replace their whole day, so a run that
    stops in between repeats its days and leaves nothing twice. A second run over finished days reads the manifest only.
    """
    spark = items.sparkSession
    done = load_manifest(spark, path).filter("status != 'missing'").select("day")
    todo = materialize(days.join(done, "day", "left_anti"), "days-todo")
    if todo.isEmpty():
        return todo.select("day")
    news = items.join(todo.filter("landed").select("day"), "day", "left_semi")
    of_news = news.groupBy(F.col("id").alias("news_id")).agg(F.min("day").alias("day"))  # an item belongs to its first day
    made = extract(news.drop("day").dropDuplicates(["id"])).join(of_news, "news_id")
    _replace_days(made.select(*RECORD_COLUMNS, "day"), f"{path}/{RECORDS}")
    stored = spark.read.schema(f"{schemas.RECORD}, day date").parquet(f"{path}/{RECORDS}").join(todo.filter("landed").select("day"), "day", "left_semi")
    counted = stored.groupBy("day").agg(F.count(F.lit(1)).alias("items"), F.sum(F.when(F.col("status") == "ok", F.size("events")).otherwise(0)).alias("events"),
                                        F.count_if(F.col("status") == "failed").alias("failed"))
    status = F.when(~F.col("landed"), "missing").when(F.col("items").isNull(), "no_items").otherwise("ok")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("items", "events", "failed")]
    _replace_days(todo.join(counted, "day", "left").select(status.alias("status"), *zero, "day"), f"{path}/{MANIFEST}")
    return todo.select("day")


def day_totals(manifest: DataFrame) -> DataFrame:
    """One row for the head of a replay: days asked for, those that are not ok, items, events and failed records."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return manifest.agg(F.count(F.lit(1)).alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.col("day").cast("string")))), ",").alias("missing"),
                        total("items"), total("events"), total("failed"))
