"""Sea network: nodes, edges, shortest and alternate routes for many requests at once.

Routes are found by label relaxation written as DataFrame rounds. Labels are hash-partitioned by
request once; each round joins the (small) neighbour dimension, extends every label by one leg and keeps
the best label per (request, node). Grouping by (request, node) is already satisfied by the partitioning
on the request, so all rounds of a pass run in one stage without a further shuffle, and the work grows
with the number of requests times the size of the network.

Leg lengths are whole tenths of a nautical mile, so that sums are exact and independent of order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneguard.functions.numeric import haversine_nm, sailing_days, stable_round
from laneguard.session import materialize

ROUTABLE_KINDS = ("port", "chokepoint", "sea_region")
COUNTRY_PREFIX = "CTRY:"
ROUNDS_PER_PASS = 8


def country_node(code: Column) -> Column:
    return F.concat(F.lit(COUNTRY_PREFIX), code)


def leg_lengths(nodes: DataFrame, legs: DataFrame) -> DataFrame:
    """legs(from_node, to_node) -> from_node, to_node, tenths (0.1 nm)."""
    end = lambda side: nodes.select(
        F.col("node_id").alias(f"{side}_node"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon")
    )
    nm = haversine_nm(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    return (
        legs.join(end("from"), "from_node")
        .join(end("to"), "to_node")
        .select("from_node", "to_node", F.floor(nm * 10.0 + 0.5000001).alias("tenths"))
    )


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """Ports and waypoints plus one node per country that owns a port."""
    countries = nodes.filter("country_code IS NOT NULL").select("country_code").distinct()
    return nodes.select("node_id", "kind", "name").unionByName(
        countries.select(
            country_node(F.col("country_code")).alias("node_id"),
            F.lit("country").alias("kind"),
            F.col("country_code").alias("name"),
        )
    )


def graph_edges(nodes: DataFrame, legs: DataFrame) -> DataFrame:
    """Undirected edges: ``sea`` legs with a length and ``in_country`` links without one."""
    sea = leg_lengths(nodes, legs).select(
        "from_node", "to_node", F.lit("sea").alias("kind"), (F.col("tenths") / 10.0).alias("distance_nm")
    )
    belongs = nodes.filter("country_code IS NOT NULL").select(
        F.col("node_id").alias("from_node"),
        country_node(F.col("country_code")).alias("to_node"),
        F.lit("in_country").alias("kind"),
        F.lit(None).cast("double").alias("distance_nm"),
    )
    return sea.unionByName(belongs)


def event_edges(events: DataFrame) -> DataFrame:
    """``affects`` edges, one per (event, node)."""
    return events.select("event_id", F.explode("node_ids").alias("node_id")).distinct().select(
        F.concat(F.lit("EVT:"), "event_id").alias("from_node"),
        F.col("node_id").alias("to_node"),
        F.lit("affects").alias("kind"),
    )


def unknown_event_nodes(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, node_id) pairs that point at nothing in the network."""
    named = events.select("event_id", F.explode("node_ids").alias("node_id")).distinct()
    return named.join(graph_nodes(nodes).select("node_id"), "node_id", "left_anti").select("event_id", "node_id")


def add_events(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """``affects`` edges, refusing events that link to unknown nodes."""
    bad = unknown_event_nodes(events, nodes).limit(1).collect()
    if bad:
        raise KeyError(f"event {bad[0].event_id} links to unknown node {bad[0].node_id}")
    return event_edges(events)


def sea_arcs(nodes: DataFrame, edges: DataFrame, avoid: list[str] | None = None) -> DataFrame:
    """Routable view: both directions of every sea edge whose two ends are routable and not avoided."""
    keep = nodes.filter(F.col("kind").isin(*ROUTABLE_KINDS))
    if avoid:
        keep = keep.filter(~F.col("node_id").isin(*avoid))
    keep = keep.select("node_id")
    sea = edges.filter("kind = 'sea'")
    both = sea.select("from_node", "to_node", "distance_nm").union(
        sea.select(F.col("to_node"), F.col("from_node"), "distance_nm")
    )
    return (
        both.join(keep.withColumnRenamed("node_id", "from_node"), "from_node", "left_semi")
        .join(keep.withColumnRenamed("node_id", "to_node"), "to_node", "left_semi")
        .select("from_node", "to_node", "distance_nm")
    )


def neighbour_table(nodes: DataFrame, legs: DataFrame) -> DataFrame:
    """node -> array of (to_node, tenths, choke), written once: the routing dimension."""
    lengths = leg_lengths(nodes, legs)
    both = lengths.unionByName(
        lengths.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "tenths")
    )
    chokes = nodes.select(F.col("node_id").alias("to_node"), (F.col("kind") == "chokepoint").alias("choke"))
    table = (
        both.join(chokes, "to_node")
        .groupBy(F.col("from_node").alias("node"))
        .agg(F.array_sort(F.collect_list(F.struct("to_node", "tenths", "choke"))).alias("next"))
    )
    return materialize(table, "neighbours")


def _label(tenths: Column, path: Column, chokes: Column, marks: Column) -> Column:
    """Comparable path label: length, then hops, then path. ``marks`` are the running lengths."""
    return F.struct(
        tenths.alias("tenths"), (F.size(path) - 1).alias("hops"), path.alias("path"), chokes.alias("chokes"),
        marks.alias("marks"),
    )


def _from_origin(origin: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return _label(zero, F.array(origin), F.array().cast("array<string>"), F.array(zero))


def best_labels(requests: DataFrame, neighbours: DataFrame, rounds: int = ROUNDS_PER_PASS) -> DataFrame:
    """Best path that continues each request's start label to every node it can reach.

    requests: req_id, start (a label), banned array<string> (nodes), banned_arcs array<string> ('a>b').
    Result: req_id, node, best (a label). Runs passes of ``rounds`` legs until no best path uses every
    round so far, i.e. until another round could not change anything.
    """
    labels = requests.select(
        "req_id",
        F.element_at("start.path", -1).alias("node"),
        F.struct(F.col("start.hops").alias("from_hops"), "banned", "banned_arcs").alias("ask"),
        F.col("start").alias("best"),
    )
    # A stated number of partitions: searches are few bytes but much work, and must not be coalesced.
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = 0
    while True:
        labels = labels.repartition(tasks, "req_id")
        for _ in range(rounds):
            labels = _relax(labels, neighbours)
        done += rounds
        labels = materialize(labels, "labels")
        deepest = labels.agg(F.max(F.col("best.hops") - F.col("ask.from_hops"))).first()[0]
        if deepest is None or deepest < done:
            return labels.select("req_id", "node", "best")


# One leg further from a label, unless the next node is on the path, banned, or behind a banned leg.
_MOVES = """
explode(concat(
  array(struct(node, best)),
  coalesce(transform(
    filter(next, n -> NOT (array_contains(best.path, n.to_node) OR array_contains(ask.banned, n.to_node)
                           OR array_contains(ask.banned_arcs, concat(node, '>', n.to_node)))),
    n -> struct(n.to_node AS node, struct(
      best.tenths + n.tenths AS tenths,
      best.hops + 1 AS hops,
      array_append(best.path, n.to_node) AS path,
      if(n.choke, array_append(best.chokes, n.to_node), best.chokes) AS chokes,
      array_append(best.marks, best.tenths + n.tenths) AS marks) AS best)),
  array()))) AS m"""


def _relax(labels: DataFrame, neighbours: DataFrame) -> DataFrame:
    return (
        labels.join(neighbours, "node", "left")
        .selectExpr("req_id", "ask", _MOVES)
        .select("req_id", "ask", "m.node", "m.best")
        .groupBy("req_id", "node")
        .agg(F.first("ask").alias("ask"), F.min("best").alias("best"))
    )


def _route_columns() -> list[Column]:
    best = F.col("best")
    nm = best["tenths"] / 10.0
    return [
        best["path"].alias("path"),
        nm.alias("distance_nm"),
        sailing_days(nm).alias("days"),
        best["hops"].alias("n_hops"),
        best["chokes"].alias("chokepoints"),
    ]


def lane_routes(lanes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Base route of every lane. One search per distinct origin, however many lanes start there."""
    none = F.array().cast("array<string>")
    requests = lanes.select("origin").distinct().select(
        F.col("origin").alias("req_id"), _from_origin(F.col("origin")).alias("start"), none.alias("banned"),
        none.alias("banned_arcs"),
    )
    labels = best_labels(requests, neighbours).select(
        F.col("req_id").alias("origin"), F.col("node").alias("destination"), "best"
    )
    return lanes.join(labels, ["origin", "destination"]).select(
        "lane_id", "origin", "destination", *_route_columns()
    )


def avoiding_routes(requests: DataFrame, neighbours: DataFrame, k: int = 3) -> DataFrame:
    """The k shortest simple routes per request that keep off its avoided nodes.

    requests: req_id, origin, destination, avoid array<string>. The two ends are never avoided. After the
    best route, each further one is found by leaving the previous route once at each of its nodes (the
    deviations of all requests are searched in one relaxation), so the answer is exact for any k without
    listing all paths. Requests without a route give no rows.
    Result: req_id, rank, path, distance_nm, days, n_hops, chokepoints.
    """
    asked = requests.select(
        "req_id", "origin", "destination",
        F.array_except("avoid", F.array("origin", "destination")).alias("banned"),
    )
    searches = asked.select(
        "req_id", _from_origin(F.col("origin")).alias("start"), "banned",
        F.array().cast("array<string>").alias("banned_arcs"),
    )
    first = (
        best_labels(searches, neighbours)
        .join(asked, "req_id")
        .filter("node = destination")
        .select("req_id", "best", F.lit(1).alias("rank"))
    )
    if k == 1:
        return first.select("req_id", "rank", *_route_columns())
    chosen = last = materialize(first, "routes")
    pool = None
    for rank in range(2, k + 1):
        spurs = _deviations(chosen, last, asked)
        fresh = (
            best_labels(spurs, neighbours)
            .withColumn("req_id", F.substring_index("req_id", "#", -1))
            .join(asked.select("req_id", "destination"), "req_id")
            .filter("node = destination")
            .select("req_id", "best")
        )
        pool = fresh if pool is None else pool.unionByName(fresh)
        taken = chosen.select("req_id", "best")
        last = materialize(
            pool.join(taken, ["req_id", "best"], "left_anti")
            .groupBy("req_id")
            .agg(F.min("best").alias("best"))
            .select("req_id", "best", F.lit(rank).alias("rank")),
            "routes",
        )
        chosen = chosen.unionByName(last)
    return chosen.select("req_id", "rank", *_route_columns())


def _deviations(chosen: DataFrame, last: DataFrame, asked: DataFrame) -> DataFrame:
    """One search per node of the last route: keep the part up to it, forbid the legs already used there."""
    best, at = F.col("best"), F.col("at")
    spur = last.select("req_id", "best", F.explode(F.sequence(F.lit(1), F.col("best.hops"))).alias("at")).select(
        "req_id", "at", F.slice(best["path"], 1, at).alias("root"), best["chokes"].alias("chokes"),
        F.slice(best["marks"], 1, at).alias("marks"),
    )
    used = chosen.groupBy("req_id").agg(F.collect_list("best.path").alias("routes"))  # at most k per request
    shares_root = lambda p: F.slice(p, 1, at) == F.col("root")
    next_arc = lambda p: F.concat(F.get(p, at - 1), F.lit(">"), F.get(p, at))
    root_chokes = F.filter("root", lambda n: F.array_contains(F.col("chokes"), n))
    return (
        spur.join(used, "req_id")
        .join(asked, "req_id")
        .select(
            F.concat_ws("#", at.cast("string"), "req_id").alias("req_id"),
            _label(F.element_at("marks", -1), F.col("root"), root_chokes, F.col("marks")).alias("start"),
            "banned",
            F.transform(F.filter("routes", shares_root), next_arc).alias("banned_arcs"),
        )
    )


def alternate_routes(requests: DataFrame, base: DataFrame, neighbours: DataFrame, k: int = 3) -> DataFrame:
    """Alternatives per lane with their cost over the base route.

    requests: lane_id, origin, destination, avoid. base: lane_routes(). ``extra_days`` is the difference
    of the rounded days.
    """
    alts = avoiding_routes(requests.withColumnRenamed("lane_id", "req_id"), neighbours, k)
    return (
        alts.withColumnRenamed("req_id", "lane_id")
        .join(base.select("lane_id", F.col("distance_nm").alias("base_nm"), F.col("days").alias("base_days")), "lane_id")
        .withColumn("extra_nm", stable_round(F.col("distance_nm") - F.col("base_nm"), 1))
        .withColumn("extra_days", stable_round(F.col("days") - F.col("base_days"), 1))
        .drop("base_nm", "base_days")
    )


def reroute_feasible(requests: DataFrame, neighbours: DataFrame) -> DataFrame:
    """requests + ``feasible``: an empty avoid list needs no detour, otherwise one must exist."""
    ids = requests.withColumnRenamed("lane_id", "req_id")
    routed = avoiding_routes(ids, neighbours, k=1).select(F.col("req_id").alias("lane_id"), F.lit(True).alias("found"))
    return requests.join(routed, "lane_id", "left").select(
        *requests.columns, ((F.size("avoid") == 0) | F.coalesce("found", F.lit(False))).alias("feasible")
    )
