"""Reference data checks: one table of violations instead of an exception on the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed formats.
LOCODE = "^[A-Z]{2}[A-Z0-9]{3}$"
COUNTRY = "^[A-Z]{2}$"
WAYPOINT_ID = "^[A-Z_]+$"


def _rows(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.alias("key"), detail.alias("detail"))


def violations(ports: DataFrame, waypoints: DataFrame, legs: DataFrame, lanes: DataFrame) -> DataFrame:
    """rule, key, detail. ports: node_id, country_code, lat, lon; waypoints: node_id, kind, lat, lon;
    legs: from_node, to_node; lanes: lane_id, origin, destination."""
    node, none = F.col("node_id"), F.lit("")
    port_ids = ports.select("node_id").distinct()
    ids = port_ids.union(waypoints.select("node_id")).distinct()
    ends = legs.select(F.explode(F.array("from_node", "to_node")).alias("node_id"), F.concat_ws("-", "from_node", "to_node").alias("leg"))
    stops = lanes.select("lane_id", F.explode(F.array("origin", "destination")).alias("node_id"))
    out_of_range = "lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180"
    repeated = lambda df, key: df.groupBy(key).count().filter("count > 1")
    parts = [
        _rows(port_ids.join(waypoints.select("node_id"), "node_id", "left_semi"), "id_clash", node, none),
        _rows(ends.join(ids, "node_id", "left_anti").distinct(), "unknown_leg_node", node, F.col("leg")),
        _rows(legs.filter("from_node = to_node"), "self_loop", F.col("from_node"), none),
        _rows(stops.join(port_ids, "node_id", "left_anti").distinct(), "unknown_lane_port", F.col("lane_id"), node),
        _rows(port_ids.join(ends.select("node_id"), "node_id", "left_anti"), "orphan_port", node, none),
        _rows(repeated(ports, "node_id"), "duplicate_port", node, F.col("count").cast("string")),
        _rows(repeated(waypoints, "node_id"), "duplicate_waypoint", node, F.col("count").cast("string")),
        _rows(repeated(lanes, "lane_id"), "duplicate_lane", F.col("lane_id"), F.col("count").cast("string")),
        _rows(ports.filter(~node.rlike(LOCODE)).distinct(), "bad_locode", node, none),
        _rows(ports.filter(~F.col("country_code").rlike(COUNTRY)), "bad_country", node, F.col("country_code")),
        _rows(ports.filter(F.substring("node_id", 1, 2) != F.col("country_code")), "locode_country", node, F.col("country_code")),
        _rows(ports.filter(out_of_range), "port_position", node, none),
        _rows(waypoints.filter(out_of_range), "waypoint_position", node, none),
        _rows(waypoints.filter(~node.rlike(WAYPOINT_ID)), "bad_waypoint_id", node, none),
        _rows(waypoints.filter(~F.col("kind").isin("chokepoint", "sea_region")), "bad_kind", node, F.col("kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
