"""Order history export (latin-1 CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard.schemas import ORDER_COLUMNS

NUMBERS = {"days_real": "int", "days_scheduled": "int", "late": "int", "quantity": "double", "unit_price": "double", "discount_rate": "double",
           "sales": "double"}
# Export date formats: month first, 24 hours.
ORDER_TIME = "M/d/yyyy H:mm"


def load_orders(spark: SparkSession, path: str) -> DataFrame:
    """Only the columns in use are read from the export, renamed and typed."""
    raw = spark.read.option("header", "true").option("encoding", "ISO-8859-1").option("quote", '"').option("escape", '"').csv(path)
    kept = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in ORDER_COLUMNS.items()])
    typed = {c: F.col(c).try_cast(t) for c, t in NUMBERS.items()}
    typed["order_date"] = F.try_to_timestamp("order_date", F.lit(ORDER_TIME)).cast("timestamp_ntz")
    return kept.select(*[(typed[c] if c in typed else F.col(c)).alias(c) for c in kept.columns])


def save_export(orders: DataFrame, path: str) -> None:
    """The inverse of load_orders, in the export's layout."""
    cols = [
        (F.date_format("order_date", ORDER_TIME) if new == "order_date" else F.col(new).cast("string")).alias(old) for old, new in ORDER_COLUMNS.items()
    ]
    orders.select(*cols, F.lit("Paid").alias("Order Status")).write.mode("overwrite").option("header", "true").option("encoding", "ISO-8859-1").csv(path)
