"""Which lanes an event touches, and how the touches combine into one score per lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laneguard.functions.numeric import risk_level, stable_round, survival
from laneguard.operators.network import COUNTRY_PREFIX, country_node

# How strongly each kind of match counts.
DIRECT_WEIGHT, COUNTRY_WEIGHT = 1.0, 0.5


def base_weight() -> Column:
    return F.col("severity") / F.lit(5.0) * F.col("confidence")


def direct_weight() -> Column:
    return stable_round(base_weight() * DIRECT_WEIGHT, 3)


def country_weight() -> Column:
    return stable_round(base_weight() * COUNTRY_WEIGHT, 3)


def lane_nodes(lanes: DataFrame, routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lane_id, node, kind): the nodes through which an event can reach a lane."""
    ends = F.array("origin", "destination")
    direct = routes.select("lane_id", "origin", "destination", F.explode("path").alias("node")).select(
        "lane_id",
        "node",
        F.when(F.array_contains(ends, F.col("node")), "endpoint").otherwise("on_route").alias("kind"),
    )
    owner = nodes.select(F.col("node_id").alias("port"), "country_code").filter("country_code IS NOT NULL")
    country = (
        lanes.select("lane_id", F.explode(ends).alias("port"))
        .join(owner, "port")
        .select("lane_id", country_node(F.col("country_code")).alias("node"), F.lit("country").alias("kind"))
        .distinct()
    )
    return direct.unionByName(country)


def signature_hits(events: DataFrame, reach: DataFrame) -> DataFrame:
    """For every distinct node list among the events: the lanes it touches and through which node.

    Which node decides depends only on the list, so it is settled once per distinct list (a small table)
    and not once per event: the first direct node of the list wins, otherwise the last country node.
    Result: node_ids, lane_id, via, kind.
    """
    place = F.struct(
        (F.col("kind") == "country").alias("weak"),
        F.when(F.col("kind") == "country", -F.col("pos")).otherwise(F.col("pos")).alias("rank"),
        F.col("node").alias("via"),
        F.col("kind").alias("kind"),
    )
    return (
        events.select("node_ids")
        .distinct()
        .select("node_ids", F.posexplode("node_ids").alias("pos", "node"))
        .join(reach, "node")
        .groupBy("node_ids", "lane_id")
        .agg(F.min(place).alias("m"))
        .select("node_ids", "lane_id", "m.via", "m.kind")
    )


def reason() -> Column:
    return (
        F.when(F.col("kind") == "endpoint", F.concat(F.lit("event at lane endpoint "), "via"))
        .when(F.col("kind") == "on_route", F.concat(F.lit("event on route at "), "via"))
        .otherwise(F.concat(F.lit("event in endpoint country "), F.substring_index("via", COUNTRY_PREFIX, -1)))
    )


def exposed_lanes(events: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per (event, lane) touched: via, kind, weight, reason. Events never move: hits are joined in."""
    weight = F.when(F.col("kind") == "country", country_weight()).otherwise(direct_weight())
    return events.join(hits, "node_ids").select(
        "event_id", "lane_id", "via", "kind", weight.alias("weight"), reason().alias("reason")
    )


def _top(weight: Column) -> Column:
    """Aggregate: the strongest event, the smallest id among equals."""
    return F.min(F.struct((-weight).alias("neg"), F.col("event_id").alias("event_id")))


def lane_exposure(events: DataFrame, hits: DataFrame, lanes: DataFrame) -> DataFrame:
    """Combined score per lane: 1 - prod(1 - w). Lanes nobody touches score 0.

    Events are first combined per node list (map-side), so what is shuffled and joined to the lanes does
    not grow with the number of events, and a node with a third of all events is one row per task.
    Result: lane_id, exposure_score, risk_level, n_events, top_event_id, top_reason.
    """
    per_list = (
        events.withColumn("dw", direct_weight())
        .withColumn("cw", country_weight())
        .groupBy("node_ids")
        .agg(
            survival(F.col("dw")).alias("direct_survival"),
            survival(F.col("cw")).alias("country_survival"),
            F.count(F.lit(1)).alias("n"),
            _top(F.col("dw")).alias("direct_top"),
            _top(F.col("cw")).alias("country_top"),
        )
    )
    is_country = F.col("kind") == "country"
    top = F.when(is_country, F.col("country_top")).otherwise(F.col("direct_top"))
    per_lane = (
        per_list.join(hits, "node_ids")
        .withColumn("s", F.when(is_country, F.col("country_survival")).otherwise(F.col("direct_survival")))
        .groupBy("lane_id")
        .agg(
            F.product("s").alias("s"),
            F.sum("n").alias("n_events"),
            F.min(F.struct(top.neg.alias("neg"), top.event_id.alias("event_id"), reason().alias("reason"))).alias("top"),
        )
    )
    score = stable_round(F.lit(1.0) - F.coalesce("s", F.lit(1.0)), 3)
    return (
        lanes.select("lane_id")
        .join(per_lane, "lane_id", "left")
        .select(
            "lane_id",
            score.alias("exposure_score"),
            risk_level(score).alias("risk_level"),
            F.coalesce("n_events", F.lit(0).cast("bigint")).alias("n_events"),
            F.col("top.event_id").alias("top_event_id"),
            F.col("top.reason").alias("top_reason"),
        )
    )


def top_contributions(events: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The k strongest contributions per lane: lane_id, event_id, via, weight, rank.

    On one lane all events of a node list match in the same way, so only the k strongest events of a list
    can be among the k strongest of a lane. Lists are cut to those first; Spark applies such a rank limit
    before its shuffle too, so a list with a third of all events sends k rows per task.
    """

    def strongest(weight: Column, matching: DataFrame) -> DataFrame:
        w = W.partitionBy("node_ids").orderBy(F.desc("weight"), "event_id")
        cut = events.select("node_ids", "event_id", weight.alias("weight")).withColumn("r", F.row_number().over(w))
        return cut.filter(F.col("r") <= k).join(matching, "node_ids").select("lane_id", "event_id", "via", "weight")

    direct = strongest(direct_weight(), hits.filter("kind <> 'country'"))
    country = strongest(country_weight(), hits.filter("kind = 'country'"))
    w = W.partitionBy("lane_id").orderBy(F.desc("weight"), "event_id")
    return direct.unionByName(country).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
