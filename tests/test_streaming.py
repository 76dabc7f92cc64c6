from pyspark.sql import functions as F

from laneguard.operators import exposure
from laneguard.streaming import live
from tests.net import Net


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def events(spark, tmp_path):
    rows = [(f"e{i}", ["CANAL"] if i % 2 else ["CTRY:AA"], 1 + i % 5, 0.4, f"2024-01-{1 + i:02d} 12:00:00") for i in range(28)]
    df = spark.createDataFrame(rows, "event_id string, node_ids array<string>, severity int, confidence double, t string").select(
        "event_id", "node_ids", "severity", "confidence", F.to_timestamp("t").alias("published"))
    df.unionByName(df).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), df


def test_stream_dedupe_and_sliding_exposure(spark, tmp_path):
    stream, batch = events(spark, tmp_path)
    net = Net(spark)
    hits = exposure.signature_hits(batch, net.reach)
    assert run(live.dedupe(stream, "event_id"), "deduped").count() == 28
    doubled = batch.unionByName(batch)
    w = F.when(F.col("kind") == "country", exposure.country_weight()).otherwise(exposure.direct_weight())
    want = doubled.join(hits, "node_ids").withColumn("w", w).groupBy("lane_id", F.window("published", "7 days", "1 day").alias("x")).agg(
        exposure.stable_round(F.lit(1.0) - exposure.survival(F.col("w")), 3).alias("score"))
    expected = {(r.lane_id, r.x.end): r.score for r in want.collect()}
    got = {(r.lane_id, r.end): r.score for r in run(live.sliding_exposure(stream, hits), "sliding").collect()}
    assert len(got) > 20 and all(expected[k] == v for k, v in got.items())
