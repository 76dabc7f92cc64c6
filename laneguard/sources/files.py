"""Text and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneguard.session import scratch_path


def write_report(lines: DataFrame, path: str) -> None:
    """section, pos, line -> text files, one folder per section, lines in order within it."""
    (
        lines.repartitionByRange("section", "pos")
        .sortWithinPartitions("section", "pos")
        .select("section", F.concat_ws("\t", "pos", "line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("section")
        .text(path)
    )


def read_report(spark, path: str) -> DataFrame:
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select("section", F.get(parts, F.lit(0)).alias("pos"), F.get(parts, F.lit(1)).alias("line"))


def round_trip_text(lines: DataFrame) -> DataFrame:
    path = scratch_path(lines.sparkSession, "report")
    write_report(lines, path)
    return read_report(lines.sparkSession, path)
