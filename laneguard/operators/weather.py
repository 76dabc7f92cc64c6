"""Weather risk per place from daily maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed thresholds.
GALE_KMH, STRONG_KMH, HEAVY_RAIN_MM = 62.0, 39.0, 50.0


def unpack_days(raw: DataFrame) -> DataFrame:
    """node_id + parallel arrays time, wind, gust, rain -> one row per day."""
    return raw.select("node_id", F.inline(F.arrays_zip("time", "wind", "gust", "rain"))).select(
        "node_id", F.col("time").alias("date"), F.col("wind").alias("wind_max_kmh"), F.col("gust").alias("gust_max_kmh"),
        F.col("rain").alias("precipitation_mm"),
    )


def classify(days: DataFrame) -> DataFrame:
    """node_id, level, reason from the windiest and wettest day (missing = 0, ties: the later date)."""
    top = lambda c: F.max(F.struct(F.coalesce(c, F.lit(0.0)).alias("v"), F.col("date").alias("date")))
    per = days.groupBy("node_id").agg(top("wind_max_kmh").alias("w"), top("precipitation_mm").alias("r"))
    wind, rain = F.col("w.v"), F.col("r.v")
    return per.select(
        "node_id",
        F.when((wind >= GALE_KMH) | (rain >= HEAVY_RAIN_MM), "high").when(wind >= STRONG_KMH, "elevated").otherwise("low").alias("level"),
        F.when(wind >= GALE_KMH, F.format_string("gale-force wind %.0f km/h on %s", wind, F.col("w.date").cast("string")))
        .when(rain >= HEAVY_RAIN_MM, F.format_string("heavy rain %.0f mm on %s", rain, F.col("r.date").cast("string")))
        .when(wind >= STRONG_KMH, F.format_string("strong wind %.0f km/h on %s", wind, F.col("w.date").cast("string")))
        .otherwise(F.format_string("max wind %.0f km/h, max rain %.0f mm", wind, rain)).alias("reason"),
    )
