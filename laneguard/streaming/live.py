"""The same operators on a stream of disruption events (optional: the batch replay needs none of this)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneguard.functions.numeric import stable_round, survival
from laneguard.functions.text import link_name
from laneguard.operators.exposure import country_weight, direct_weight
from laneguard.operators.linking import MIN_WITHIN_LEN, runs_of


def dedupe(items: DataFrame, key: str = "id", time: str = "published", delay: str = "2 days") -> DataFrame:
    """First delivery of every key within the watermark."""
    return items.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sliding_exposure(events: DataFrame, hits: DataFrame, lookback: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Noisy-OR per lane and sliding window; ``hits`` is the static table of touched lanes per node list."""
    weight = F.when(F.col("kind") == "country", country_weight()).otherwise(direct_weight())
    touched = events.withWatermark("published", delay).join(hits, "node_ids").withColumn("weight", weight)
    scored = touched.groupBy("lane_id", F.window("published", lookback, slide).alias("w")).agg(
        survival(F.col("weight")).alias("s"), F.count(F.lit(1)).alias("n_events")
    )
    return scored.select(
        "lane_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), stable_round(F.lit(1.0) - F.col("s"), 3).alias("score"), "n_events"
    )


def link_stream(mentions: DataFrame, aliases: DataFrame, words: list[int]) -> DataFrame:
    """Places on a stream of ``mention_id, location``, linked to ``aliases(alias, node_id, pos)`` by exact name or by the
    longest alias inside the text: mention_id, node_id, method, matched_alias; unlinked ones are not given.

    A stream-static join without state: every mention becomes the word runs that aliases can equal (``words``: the
    numbers of words that aliases have), runs meet the alias table by equality inside the micro-batch, and the best hit
    is chosen per mention and batch (``link_batches`` runs it that way). The same functions serve the batch rules, so
    both agree.
    """
    named = mentions.select("mention_id", link_name(F.coalesce("location", F.lit(""))).alias("loc")).filter("loc <> ''")
    runs = named.select("mention_id", "loc", F.explode(runs_of(F.col("loc"), words)).alias("alias"))
    usable = (F.length("alias") >= MIN_WITHIN_LEN) | (F.col("alias") == F.col("loc"))
    hits = runs.filter(usable).join(aliases, "alias")
    exact = F.col("alias") == F.col("loc")
    best = F.max_by(F.struct("node_id", "alias", exact.alias("exact")), F.struct(exact, F.length("alias"), *[-F.col(f"pos.{c}") for c in ("tier", "pos", "at")]))
    return hits.groupBy("mention_id").agg(best.alias("b")).select(
        "mention_id", "b.node_id", F.when(F.col("b.exact"), "alias_exact").otherwise("alias_within").alias("method"), F.col("b.alias").alias("matched_alias"))


def link_batches(mentions: DataFrame, aliases: DataFrame, path: str, checkpoint: str):
    """Starts the linking of a stream into ``path``, one folder per micro-batch, for all that is there (``availableNow``).

    A batch that is repeated after a failure overwrites its own folder, so nothing is linked twice.
    """
    counts = aliases.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect()  # lengths of names in words
    words = sorted(r["n"] for r in counts)

    def write(batch: DataFrame, number: int) -> None:
        link_stream(batch, aliases, words).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return mentions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
