"""Network, routing and exposure queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneguard.functions.numeric import color_bucket, haversine_nm, sailing_days, stable_round
from laneguard.operators import brief, exposure, integrity, network, replay, store, weather
from laneguard.plans.domain import AS_OF, LOOKBACK_DAYS, SPEC, Domain
from laneguard.plans.registry import query
from laneguard.plans.sql_views import rnd, view
from laneguard.sources import files


def joined(col: str):
    return F.array_join(col, ">")


@query("i02_lane_routes", """
SELECT lane_id, distance_nm, days, CAST(hops AS INTEGER) AS n_hops, array_to_string(path, '>') AS path_text FROM routes""", ["routes"])
def lane_routes(d: Domain) -> DataFrame:
    return d.routes.select("lane_id", "distance_nm", "days", "n_hops", joined("path").alias("path_text"))


@query("d01_lane_exposure", "SELECT lane_id, exposure_score, risk_level, n_events, top_event_id, top_reason FROM risk", ["risk"])
def lane_exposure(d: Domain) -> DataFrame:
    return d.risk


@query("c10_exposed_lanes", "SELECT event_id, lane_id, via, kind, weight FROM hits", ["hits"])
def exposed_lanes(d: Domain) -> DataFrame:
    return exposure.exposed_lanes(d.alarms, d.hits).drop("reason")


view("alt3", ("lanes", "paths", "routes"), f"""
SELECT lane_id, p.path, p.tenths / 10.0::DOUBLE AS distance_nm, p.hops,
  {rnd('p.tenths / 10.0::DOUBLE / 14.0::DOUBLE / 24.0::DOUBLE', 1)} AS days,
  row_number() OVER (PARTITION BY lane_id ORDER BY p.tenths, p.hops, p.path) AS rank
FROM lanes JOIN (SELECT *, v AS destination, len(path) - 1 AS hops FROM paths) p USING (origin, destination)
WHERE (NOT list_contains(p.path, 'RA000') OR 'RA000' IN (origin, destination)) AND NOT list_contains(p.path, 'WP_D')
QUALIFY rank <= 3""")


@query("i03_alternate_routes", f"""
SELECT lane_id, CAST(rank AS INTEGER) AS rank, alt3.distance_nm, {rnd('alt3.distance_nm - routes.distance_nm', 1)} AS extra_nm,
  {rnd('alt3.days - routes.days', 1)} AS extra_days, array_to_string(alt3.path, '>') AS path_text
FROM alt3 JOIN routes USING (lane_id)""", ["alt3", "routes"])
def alternates(d: Domain) -> DataFrame:
    asked = d.lanes.select("lane_id", "origin", "destination", F.array(F.lit("RA000"), F.lit("WP_D")).alias("avoid"))
    alts = network.alternate_routes(asked, d.routes, d.neighbours, k=3)
    return alts.select("lane_id", "rank", "distance_nm", "extra_nm", "extra_days", joined("path").alias("path_text"))


# --- scalar functions on the network --------------------------------------------------------------

GC = """2 * 3440.065::DOUBLE * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2)
   + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"""


@query("b17_haversine", f"""
SELECT lane_id, {rnd(GC.format(a='a', b='b'), 2)} AS direct_nm
FROM lanes JOIN nodes a ON a.node_id = origin JOIN nodes b ON b.node_id = destination""", ["lanes", "nodes"])
def haversine(d: Domain) -> DataFrame:
    end = lambda col, s: d.nodes.select(F.col("node_id").alias(col), F.col("lat").alias(f"lat{s}"), F.col("lon").alias(f"lon{s}"))
    both = d.lanes.join(end("origin", 1), "origin").join(end("destination", 2), "destination")
    return both.select("lane_id", stable_round(haversine_nm(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 2).alias("direct_nm"))


@query("b18_distance_days", "SELECT lane_id, distance_nm, days FROM routes", ["routes"])
def distance_days(d: Domain) -> DataFrame:
    return d.routes.select("lane_id", "distance_nm", sailing_days(F.col("distance_nm")).alias("days"))


@query("b19_risk_level", "SELECT risk_level, count(*) AS n_lanes, max(exposure_score) AS max_score FROM risk GROUP BY 1", ["risk"])
def risk_bands(d: Domain) -> DataFrame:
    return d.risk.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n_lanes"), F.max("exposure_score").alias("max_score"))


@query("b20_color_bucket", """
SELECT lane_id, CASE WHEN exposure_score > 0 THEN least(CAST(floor(exposure_score * 5) AS BIGINT), 4) END AS step FROM risk""", ["risk"])
def color_buckets(d: Domain) -> DataFrame:
    return d.risk.select("lane_id", color_bucket(F.col("exposure_score")).alias("step"))


@query("b21_event_card", """
SELECT event_id, event_type, location, severity, confidence, strftime(published, '%Y-%m-%d') AS published, summary, source_url
FROM alarms""", ["alarms"])
def cards(d: Domain) -> DataFrame:
    return store.event_card(d.alarms)


@query("b22_get_event", """
SELECT event_id, event_type, location, severity, confidence, strftime(published, '%Y-%m-%d') AS published, summary, source_url
FROM alarms, as_of WHERE published <= as_of
  AND event_id IN (SELECT 'E' || lpad(CAST(doc_id AS VARCHAR), 12, '0') FROM documents)""", ["alarms", "as_of"])
def lookup(d: Domain) -> DataFrame:
    ids = d.table("documents").select(F.concat(F.lit("E"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("event_id"))
    return store.event_card(store.get_events(d.alarms, ids, AS_OF))


@query("b23_visible_events", "SELECT event_id, published, severity FROM visible", ["visible"])
def visible_events(d: Domain) -> DataFrame:
    return store.visible(d.alarms, AS_OF, LOOKBACK_DAYS).select("event_id", "published", "severity")


@query("b24_search_events", """
SELECT event_id, published, severity, location FROM visible
WHERE severity >= 2 AND regexp_matches(lower(location || ' ' || summary || ' ' || event_type), 'strike|congestion')""", ["visible"])
def search_events(d: Domain) -> DataFrame:
    since = AS_OF - dt.timedelta(days=LOOKBACK_DAYS)
    hits = store.search(d.alarms, "the strike and congestion news", since, AS_OF, min_severity=2, limit=None)
    return hits.select("event_id", "published", "severity", "location")


@query("f01_newest_first", """
SELECT event_id, published, CAST(row_number() OVER (PARTITION BY location ORDER BY published DESC, event_id) AS BIGINT) AS rank
FROM alarms""", ["alarms"])
def newest_first(d: Domain) -> DataFrame:
    ranked = store.source_rank(d.alarms, "location", [F.desc("published"), F.col("event_id")])
    return ranked.select("event_id", "published", "rank")


@query("f02_search_limit", """
SELECT event_id, event_type, location, severity, confidence, strftime(published, '%Y-%m-%d') AS published, summary, source_url
FROM (SELECT * FROM visible WHERE regexp_matches(lower(location || ' ' || summary || ' ' || event_type), 'weather|conflict')
      ORDER BY published DESC, event_id LIMIT 50)""", ["visible"])
def search_limit(d: Domain) -> DataFrame:
    since = AS_OF - dt.timedelta(days=LOOKBACK_DAYS)
    return store.event_card(store.search(d.alarms, "recent weather or conflict at sea", since, AS_OF, limit=50))


@query("b25_list_lanes", "SELECT lane_id, origin, destination, focus FROM lanes WHERE focus = 'africa_asia'", ["lanes"])
def list_lanes(d: Domain) -> DataFrame:
    return store.list_lanes(d.lanes, "africa_asia").select("lane_id", "origin", "destination", "focus")


@query("d23_health", "SELECT 'ok' AS status, count(DISTINCT event_id) AS events FROM alarms", ["alarms"])
def health(d: Domain) -> DataFrame:
    return d.alarms.agg(F.countDistinct("event_id").alias("events")).select(F.lit("ok").alias("status"), "events")


# --- graph tables ---------------------------------------------------------------------------------


@query("i01_graph_tables", """
SELECT from_node, to_node, 'sea' AS kind, tenths / 10.0::DOUBLE AS distance_nm FROM leg_len
UNION ALL SELECT node_id, 'CTRY:' || country_code, 'in_country', NULL FROM nodes WHERE country_code IS NOT NULL""", ["leg_len", "nodes"])
def graph_tables(d: Domain) -> DataFrame:
    return network.graph_edges(d.nodes, d.legs)


@query("c09_leg_lengths", "SELECT from_node, to_node, tenths / 10.0::DOUBLE AS distance_nm FROM leg_len", ["leg_len"])
def leg_lengths(d: Domain) -> DataFrame:
    return network.leg_lengths(d.nodes, d.legs).select("from_node", "to_node", (F.col("tenths") / 10.0).alias("distance_nm"))


@query("g04_node_set", "SELECT node_id, kind FROM graph_nodes", ["graph_nodes"])
def node_set(d: Domain) -> DataFrame:
    return network.graph_nodes(d.nodes).select("node_id", "kind")


@query("i04_event_edges", """
SELECT DISTINCT 'EVT:' || event_id AS from_node, node AS to_node, 'affects' AS kind
FROM (SELECT event_id, unnest(node_ids) AS node FROM alarms) WHERE node IN (SELECT node_id FROM graph_nodes)""", ["alarms", "graph_nodes"])
def event_edges(d: Domain) -> DataFrame:
    bad = network.unknown_event_nodes(d.alarms, d.nodes)
    known = F.concat(F.lit("EVT:"), bad.event_id).alias("from_node")
    edges = network.event_edges(d.alarms)
    return edges.join(bad.select(known, bad.node_id.alias("to_node")), ["from_node", "to_node"], "left_anti")


@query("i05_sea_view", """
SELECT a AS from_node, b AS to_node, tenths / 10.0::DOUBLE AS distance_nm FROM arcs
WHERE a NOT IN ('RA000', 'WP_D') AND b NOT IN ('RA000', 'WP_D')""", ["arcs"])
def sea_view(d: Domain) -> DataFrame:
    return network.sea_arcs(d.nodes, network.graph_edges(d.nodes, d.legs), ["RA000", "WP_D"])


@query("i06_route_chokepoints", """
SELECT lane_id, array_to_string(list_filter(path, lambda x: list_contains(['WP_D', 'WP_K', 'WP_R', 'WP_Y'], x)), '>') AS chokepoints
FROM routes""", ["routes", "nodes"])
def chokepoints(d: Domain) -> DataFrame:
    return d.routes.select("lane_id", joined("chokepoints").alias("chokepoints"))


view("touched", ("hits", "as_of"), """
SELECT DISTINCT lane_id, via, kind FROM hits, as_of WHERE published >= as_of - lookback AND published <= as_of""")
view("avoid", ("touched", "lanes"), """
SELECT lane_id, any_value(origin) AS origin, any_value(destination) AS destination, list_sort(list(DISTINCT via)) AS avoid
FROM touched JOIN lanes USING (lane_id) WHERE kind = 'on_route' GROUP BY lane_id""")
view("detour", ("avoid", "paths", "routes"), f"""
SELECT avoid.lane_id, avoid.avoid, avoid.destination, b.path, b.tenths / 10.0::DOUBLE AS distance_nm,
  {rnd('b.tenths / 10.0::DOUBLE - routes.distance_nm', 1)} AS extra_nm,
  {rnd(rnd('b.tenths / 10.0::DOUBLE / 14.0::DOUBLE / 24.0::DOUBLE', 1) + ' - routes.days', 1)} AS extra_days
FROM avoid JOIN routes USING (lane_id) LEFT JOIN (
  SELECT lane_id, p.path, p.tenths FROM avoid JOIN paths p ON p.origin = avoid.origin AND p.v = avoid.destination
  WHERE NOT list_has_any(p.path, avoid.avoid)
  QUALIFY row_number() OVER (PARTITION BY lane_id ORDER BY p.tenths, len(p.path), p.path) = 1) b USING (lane_id)""")


@query("i07_reroute_feasible", "SELECT lane_id, array_to_string(avoid, ',') AS avoid_text, path IS NOT NULL AS feasible FROM detour", ["detour"])
def feasible(d: Domain) -> DataFrame:
    return network.reroute_feasible(d.avoid, d.neighbours).select("lane_id", F.array_join("avoid", ",").alias("avoid_text"), "feasible")


@query("e09_route_rank", """
SELECT lane_id, CAST(row_number() OVER (PARTITION BY lane_id ORDER BY p.tenths, len(p.path), p.path) AS INTEGER) AS rank,
  p.tenths / 10.0::DOUBLE AS distance_nm
FROM lanes JOIN paths p ON p.origin = lanes.origin AND p.v = lanes.destination QUALIFY rank <= 2""", ["lanes", "paths"])
def route_rank(d: Domain) -> DataFrame:
    asked = d.lanes.select(F.col("lane_id").alias("req_id"), "origin", "destination", F.array().cast("array<string>").alias("avoid"))
    return network.avoiding_routes(asked, d.neighbours, k=2).select(F.col("req_id").alias("lane_id"), "rank", "distance_nm")


@query("c17_nearest_port", f"""
SELECT a.node_id AS port, arg_min(b.node_id, (b.country_code <> a.country_code, {GC.format(a='a', b='b')}, b.node_id)) AS alternate,
  {rnd(f"arg_min({GC.format(a='a', b='b')}, (b.country_code <> a.country_code, {GC.format(a='a', b='b')}, b.node_id))", 1)} AS nm
FROM nodes a JOIN nodes b ON a.region = b.region AND a.node_id <> b.node_id
WHERE a.kind = 'port' AND b.kind = 'port' GROUP BY a.node_id""", ["nodes"])
def nearest_port(d: Domain) -> DataFrame:
    return brief.nearest_alternate_port(d.nodes)


view("all_ports", ("nodes",), """
SELECT node_id, country_code, lat, lon FROM nodes WHERE kind = 'port'
UNION ALL SELECT 'R' || chr(CAST(65 + s_nationkey % 5 AS INTEGER)) || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0'),
  'R' || chr(CAST(65 + s_suppkey % 5 AS INTEGER)), s_acctbal / 100.0::DOUBLE, s_acctbal / 50.0::DOUBLE FROM supplier""")
view("all_lanes", ("lane_pairs", "nodes"), """
SELECT s.node_id || '-' || c.node_id AS lane_id, s.node_id AS origin, c.node_id AS destination
FROM lane_pairs JOIN nodes s ON s.k = sk JOIN nodes c ON c.k = ck""")
view("all_legs", ("legs",), """
SELECT * FROM legs UNION ALL SELECT 'S' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0'),
  'S' || lpad(CAST((s_suppkey * 3) % 1000 AS VARCHAR), 3, '0') FROM supplier""")


@query("c20_integrity", """
SELECT 'unknown_leg_node' AS rule, node AS key, leg AS detail FROM (SELECT DISTINCT unnest([from_node, to_node]) AS node, from_node || '-' || to_node AS leg FROM all_legs)
  WHERE node NOT IN (SELECT node_id FROM all_ports UNION ALL SELECT node_id FROM nodes WHERE kind <> 'port')
UNION ALL SELECT 'self_loop', from_node, '' FROM all_legs WHERE from_node = to_node
UNION ALL SELECT 'unknown_lane_port', lane_id, node FROM (SELECT DISTINCT lane_id, unnest([origin, destination]) AS node FROM all_lanes)
  WHERE node NOT IN (SELECT node_id FROM all_ports)
UNION ALL SELECT DISTINCT 'orphan_port', node_id, '' FROM all_ports WHERE node_id NOT IN (SELECT unnest([from_node, to_node]) FROM all_legs)
UNION ALL SELECT 'duplicate_port', node_id, CAST(count(*) AS VARCHAR) FROM all_ports GROUP BY node_id HAVING count(*) > 1
UNION ALL SELECT 'locode_country', node_id, country_code FROM all_ports WHERE substr(node_id, 1, 2) <> country_code
UNION ALL SELECT 'port_position', node_id, '' FROM all_ports WHERE lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180
""", ["all_ports", "all_lanes", "all_legs", "nodes"])
def check_reference(d: Domain) -> DataFrame:
    s = F.col("s_suppkey")
    code = lambda c: F.concat(F.lit("R"), F.char(c % 5 + 65))
    serial = lambda c: F.lpad((c % 1000).cast("string"), 3, "0")
    extra_ports = d.table("supplier").select(
        F.concat(code(F.col("s_nationkey")), serial(s)).alias("node_id"), code(s).alias("country_code"),
        (F.col("s_acctbal") / 100.0).alias("lat"), (F.col("s_acctbal") / 50.0).alias("lon"),
    )
    extra_legs = d.table("supplier").select(
        F.concat(F.lit("S"), serial(s)).alias("from_node"), F.concat(F.lit("S"), serial(s * 3)).alias("to_node")
    )
    ports = d.nodes.filter("kind = 'port'").select("node_id", "country_code", "lat", "lon").unionByName(extra_ports)
    waypoints = d.nodes.filter("kind <> 'port'").select("node_id", "kind", "lat", "lon")
    return integrity.violations(ports, waypoints, d.legs.unionByName(extra_legs), d.raw_lanes)


# --- exposure -------------------------------------------------------------------------------------


@query("e07_best_match", "SELECT lane_id, kind, via, count(*) AS n_events, max(weight) AS top_weight FROM hits GROUP BY ALL", ["hits"])
def best_match(d: Domain) -> DataFrame:
    rows = exposure.exposed_lanes(d.alarms, d.hits)
    return rows.groupBy("lane_id", "kind", "via").agg(F.count(F.lit(1)).alias("n_events"), F.max("weight").alias("top_weight"))


@query("f03_lanes_by_exposure", "SELECT lane_id, exposure_score FROM risk WHERE exposure_score > 0 ORDER BY exposure_score DESC, lane_id", ["risk"])
def lanes_by_exposure(d: Domain) -> DataFrame:
    return d.risk.filter("exposure_score > 0").select("lane_id", "exposure_score").orderBy(F.desc("exposure_score"), "lane_id")


@query("f04_top_contributions", """
SELECT lane_id, event_id, via, weight, CAST(row_number() OVER (PARTITION BY lane_id ORDER BY weight DESC, event_id) AS INTEGER) AS rank
FROM hits, as_of WHERE published >= as_of - lookback AND published <= as_of QUALIFY rank <= 5""", ["hits", "as_of"])
def top_contributions(d: Domain) -> DataFrame:
    return exposure.top_contributions(d.visible, d.hits, 5)


@query("f05_top_lanes", "SELECT lane_id, exposure_score, top_reason AS why FROM risk WHERE exposure_score > 0 ORDER BY exposure_score DESC, lane_id LIMIT 5", ["risk"])
def top_lanes(d: Domain) -> DataFrame:
    return brief.affected_lanes(d.risk).orderBy(F.desc("exposure_score"), "lane_id").limit(brief.TOP_LANES)


@query("d18_kpis", """
SELECT (SELECT count(*) FROM risk WHERE exposure_score > 0) AS lanes_exposed, (SELECT count(*) FROM lanes) AS lanes,
  (SELECT max(exposure_score) FROM risk) AS max_exposure, count(*) AS events_in_window, CAST(max(published) AS DATE) AS latest FROM visible""",
  ["risk", "lanes", "visible"])
def kpis(d: Domain) -> DataFrame:
    lanes = d.risk.agg(F.count_if(F.col("exposure_score") > 0).alias("lanes_exposed"), F.count(F.lit(1)).alias("lanes"),
                       F.max("exposure_score").alias("max_exposure"), F.lit(1).alias("j"))
    seen = d.visible.agg(F.count(F.lit(1)).alias("events_in_window"), F.to_date(F.max("published")).alias("latest"), F.lit(1).alias("j"))
    return lanes.join(seen, "j").drop("j")


# --- replay ---------------------------------------------------------------------------------------

view("windows", (), """
SELECT * FROM (VALUES
 ('alarm_peak', 'disruption', DATE '2024-01-10', DATE '2024-01-23', DATE '2024-01-20', ['RA000', 'WP_F'], NULL, NULL),
 ('alarm_early', 'disruption', DATE '2024-01-05', DATE '2024-01-18', DATE '2024-01-15', ['WP_D', 'RB001'], 'first alarm', DATE '2024-01-09'),
 ('control_1', 'control', DATE '2024-01-01', DATE '2024-01-07', NULL, [], NULL, NULL),
 ('control_2', 'control', DATE '2024-01-24', DATE '2024-01-30', NULL, [], NULL, NULL))
 AS t(window_id, kind, start_day, end_day, onset, targets, label, label_date)""")
view("window_days", ("windows",), """
SELECT window_id, targets, CAST(unnest(generate_series(start_day, end_day, INTERVAL 1 DAY)) AS DATE) AS day FROM windows""")


def signals_sql(source: str) -> str:
    return f"""
SELECT window_id, lane_id, day, score, score >= 0.5 AS flagged,
  score >= 0.5 AND list_has_any(nodes, targets) AS on_target, n_events, nodes
FROM (SELECT w.window_id, lanes.lane_id, w.day, any_value(w.targets) AS targets,
    {rnd('1.0::DOUBLE - coalesce(product(1.0::DOUBLE - h.weight), 1.0::DOUBLE)', 3)} AS score, count(h.event_id) AS n_events,
    coalesce(list_sort(list(DISTINCT h.via) FILTER (h.via IS NOT NULL)), []) AS nodes
  FROM lanes CROSS JOIN window_days w LEFT JOIN {source} h ON h.lane_id = lanes.lane_id
    AND h.published > CAST(w.day AS TIMESTAMP) + INTERVAL '23:59:59' - INTERVAL 7 DAY
    AND h.published <= CAST(w.day AS TIMESTAMP) + INTERVAL '23:59:59'
  GROUP BY w.window_id, lanes.lane_id, w.day)"""


view("signals1", ("lanes", "window_days", "hits"), signals_sql("hits"))
view("stories", ("hits",), """
SELECT * FROM hits WHERE kind <> 'country'
QUALIFY row_number() OVER (PARTITION BY lane_id, CAST(published AS DATE), event_type, via ORDER BY weight DESC, published, event_id) = 1""")
view("signals2", ("lanes", "window_days", "stories"), signals_sql("stories"))
SIGNAL_OUT = "SELECT window_id, lane_id, day, score, flagged, on_target, n_events, array_to_string(nodes, ',') AS nodes FROM "


def flat_signals(s: DataFrame) -> DataFrame:
    return s.withColumn("nodes", F.array_join("nodes", ","))


@query("d08_replay_v1", SIGNAL_OUT + "signals1", ["signals1"])
def replay_v1(d: Domain) -> DataFrame:
    return flat_signals(d.signals("v1"))


@query("d09_replay_v2", SIGNAL_OUT + "signals2", ["signals2"])
def replay_v2(d: Domain) -> DataFrame:
    return flat_signals(d.signals("v2"))


@query("c14_replay_visibility", """
SELECT w.window_id, w.day, count(a.event_id) AS n_events, min(a.event_id) AS first_event FROM window_days w JOIN alarms a
 ON a.published > CAST(w.day AS TIMESTAMP) + INTERVAL '23:59:59' - INTERVAL 7 DAY
 AND a.published <= CAST(w.day AS TIMESTAMP) + INTERVAL '23:59:59' GROUP BY 1, 2""", ["window_days", "alarms"])
def replay_visibility(d: Domain) -> DataFrame:
    return replay.visible_per_day(d.alarms, d.windows, SPEC.params.lookback_days)


@query("e04_sliding_lookback", f"""
SELECT node, day, {rnd('1.0::DOUBLE - product(1.0::DOUBLE - w)', 3)} AS score, count(*) AS n_events
FROM (SELECT unnest(node_ids) AS node, published, {rnd('severity / 5.0::DOUBLE * confidence', 3)} AS w FROM alarms) a
JOIN (SELECT DISTINCT day FROM window_days) d ON a.published > CAST(d.day AS TIMESTAMP) + INTERVAL '23:59:59' - INTERVAL 7 DAY
 AND a.published <= CAST(d.day AS TIMESTAMP) + INTERVAL '23:59:59' GROUP BY 1, 2""", ["alarms", "window_days"])
def sliding_lookback(d: Domain) -> DataFrame:
    days = d.windows.select(F.explode(F.sequence("start", "end")).alias("day")).distinct()
    return replay.node_signal(d.alarms, days, SPEC.params.lookback_days)


@query("e05_flag_episodes", """
SELECT window_id, lane_id, day FROM (SELECT *, lag(flagged) OVER (PARTITION BY window_id, lane_id ORDER BY day) AS prev FROM signals1)
WHERE flagged AND NOT coalesce(prev, false)""", ["signals1"])
def episodes(d: Domain) -> DataFrame:
    return replay.flag_episodes(d.signals("v1")).filter("starts").select("window_id", "lane_id", "day")


view("lead", ("signals1", "windows"), """
SELECT window_id AS disruption_id, lane_id, any_value(onset) AS onset, min(day) FILTER (on_target) AS first_warning,
  date_diff('day', min(day) FILTER (on_target), any_value(onset)) AS lead_days, min(day) FILTER (on_target) IS NULL AS missed,
  any_value(label) || ' (' || CAST(any_value(label_date) AS VARCHAR) || ')' AS secondary_reference,
  date_diff('day', min(day) FILTER (on_target), any_value(label_date)) AS lead_vs_secondary_days,
  count(*) FILTER (day < onset AND flagged AND NOT on_target) AS off_target_days, max(score) AS peak_score
FROM signals1 JOIN windows USING (window_id) WHERE windows.kind = 'disruption' GROUP BY window_id, lane_id""")


@query("d10_lead_time", """
SELECT disruption_id, lane_id, onset, first_warning, CAST(lead_days AS INTEGER) AS lead_days, missed, secondary_reference,
 CAST(lead_vs_secondary_days AS INTEGER) AS lead_vs_secondary_days, off_target_days, peak_score FROM lead""", ["lead"])
def lead_time(d: Domain) -> DataFrame:
    return replay.score_disruptions(d.signals("v1"), d.windows)


@query("d11_false_alarms", f"""
SELECT lane_id, count(*) AS days, count(*) FILTER (flagged) AS flagged_days, {rnd('avg(CAST(flagged AS DOUBLE))', 3)} AS false_alarm_rate,
  count(*) FILTER (flagged AND NOT coalesce(prev, false)) AS episodes
FROM (SELECT *, lag(flagged) OVER (PARTITION BY window_id, lane_id ORDER BY day) AS prev FROM signals1 WHERE window_id LIKE 'control%')
GROUP BY lane_id""", ["signals1"])
def false_alarms(d: Domain) -> DataFrame:
    return replay.score_controls(d.signals("v1"), d.windows)


@query("g07_watched_lanes", """
SELECT lane_id, focus, lane_id = 'RB001-RC002' AS is_primary FROM lanes
WHERE lane_id = 'RB001-RC002' OR focus IN ('africa_asia', 'asia_africa')""", ["lanes"])
def watched(d: Domain) -> DataFrame:
    return replay.watched_lanes(d.lanes, F.lit(SPEC.primary_lane), list(SPEC.secondary_lane_focus))


@query("d12_backtest_roll_up", """
SELECT disruption_id, count(*) FILTER (NOT missed) AS lanes_warned, count(*) AS lanes, CAST(median(lead_days) AS DOUBLE) AS median_lead_days,
 max(peak_score) AS peak_score FROM lead JOIN lanes USING (lane_id) WHERE lane_id = 'RB001-RC002' OR focus IN ('africa_asia', 'asia_africa')
GROUP BY 1""", ["lead", "lanes"])
def backtest_roll_up(d: Domain) -> DataFrame:
    lanes = replay.watched_lanes(d.lanes, F.lit(SPEC.primary_lane), list(SPEC.secondary_lane_focus))
    signals = replay.replay(d.alarms, d.hits, lanes, d.windows, SPEC.params)
    return replay.roll_up(replay.score_disruptions(signals, d.windows))


@query("g03_needed_days", """
SELECT DISTINCT CAST(unnest(generate_series(CAST(ts AS DATE) - 7, CAST(ts AS DATE) + 3, INTERVAL 1 DAY)) AS DATE) AS day
FROM events""")
def needed_days(d: Domain) -> DataFrame:
    day = F.to_date("ts")
    windows = d.table("events").select(day.alias("start"), F.date_add(day, 3).alias("end")).distinct()
    return replay.needed_days(windows, 7)


@query("g05_target_overlap", """
SELECT event_id, list_has_any(node_ids, ['RA000', 'WP_F', 'CTRY:RB']) AS on_target FROM alarms""", ["alarms"])
def target_overlap(d: Domain) -> DataFrame:
    targets = F.array(F.lit("RA000"), F.lit("WP_F"), F.lit("CTRY:RB"))
    return d.alarms.select("event_id", F.arrays_overlap("node_ids", targets).alias("on_target"))


# --- weather --------------------------------------------------------------------------------------

view("weather_days", ("nodes",), """
SELECT node_id, CAST(ts AS DATE) AS date, max(value) / 4.0::DOUBLE AS wind, max(value) / 3.0::DOUBLE AS gust,
  CASE WHEN count(*) % 3 = 0 THEN NULL ELSE max(value) / 6.0::DOUBLE END AS rain
FROM events JOIN nodes ON k = user_id % 25 GROUP BY 1, 2""")


@query("b32_weather_days", "SELECT node_id, date, wind AS wind_max_kmh, gust AS gust_max_kmh, rain AS precipitation_mm FROM weather_days", ["weather_days"])
def weather_days(d: Domain) -> DataFrame:
    return weather.unpack_days(d.weather_arrays)


@query("d20_weather_level", """
SELECT node_id, CASE WHEN w >= 62 OR r >= 50 THEN 'high' WHEN w >= 39 THEN 'elevated' ELSE 'low' END AS level,
  CASE WHEN w >= 62 THEN 'gale-force wind ' || CAST(CAST(floor(w + 0.5) AS BIGINT) AS VARCHAR) || ' km/h on ' || wd
       WHEN r >= 50 THEN 'heavy rain ' || CAST(CAST(floor(r + 0.5) AS BIGINT) AS VARCHAR) || ' mm on ' || rd
       WHEN w >= 39 THEN 'strong wind ' || CAST(CAST(floor(w + 0.5) AS BIGINT) AS VARCHAR) || ' km/h on ' || wd
       ELSE 'max wind ' || CAST(CAST(floor(w + 0.5) AS BIGINT) AS VARCHAR) || ' km/h, max rain ' || CAST(CAST(floor(r + 0.5) AS BIGINT) AS VARCHAR) || ' mm' END AS reason
FROM (SELECT node_id, max(wind) AS w, arg_max(CAST(date AS VARCHAR), (wind, date)) AS wd, max(coalesce(rain, 0.0)) AS r,
      arg_max(CAST(date AS VARCHAR), (coalesce(rain, 0.0), date)) AS rd FROM weather_days GROUP BY node_id)""", ["weather_days"])
def weather_level(d: Domain) -> DataFrame:
    return weather.classify(weather.unpack_days(d.weather_arrays))


# --- brief ----------------------------------------------------------------------------------------


@query("k01_affected_lanes", """
SELECT n AS n_affected, total AS n_lanes, score AS risk_score,
  CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS risk_level,
  n || ' of ' || total || ' lanes exposed as of 2024-01-21; highest exposure ' || printf('%.2f', score) || ' on ' || lane || ' (' || why || ').' AS summary
FROM (SELECT count(*) FILTER (exposure_score > 0) AS n, count(*) AS total, max(exposure_score) AS score,
  arg_min(lane_id, (-exposure_score, lane_id)) AS lane, arg_min(top_reason, (-exposure_score, lane_id)) AS why FROM risk)""", ["risk"])
def brief_summary(d: Domain) -> DataFrame:
    return brief.summary(d.risk, AS_OF.date())


view("nearest", ("nodes",), f"""
SELECT a.node_id AS port, arg_min(b.node_id, (b.country_code <> a.country_code, {GC.format(a='a', b='b')}, b.node_id)) AS alternate
FROM nodes a JOIN nodes b ON a.region = b.region AND a.node_id <> b.node_id
WHERE a.kind = 'port' AND b.kind = 'port' GROUP BY a.node_id""")
view("actions", ("detour", "touched", "nearest", "nodes"), """
SELECT lane_id, 'reroute' AS action, 'Avoid ' || array_to_string(avoid, ', ') || ': route via ' || CASE WHEN len(ch) > 0 THEN array_to_string(ch, ', ') ELSE 'open sea' END
  || ', about ' || printf('%+.1f', extra_days) || ' days (' || CASE WHEN extra_nm < 0 THEN '-' ELSE '+' END
  || format('{:,}', CAST(floor(abs(extra_nm) + 0.5) AS BIGINT)) || ' nm) vs base.' AS detail
FROM (SELECT *, list_filter(path, lambda x: list_contains(['WP_D', 'WP_K', 'WP_R', 'WP_Y'], x)) AS ch FROM detour WHERE path IS NOT NULL)
UNION ALL SELECT lane_id, 'buffer_stock', 'Hold about ' || CAST(CAST(round_even(extra_days, 0) AS INTEGER) AS VARCHAR) || ' extra days of safety stock at '
  || destination || ' while the detour applies.' FROM detour WHERE extra_days >= 3
UNION ALL SELECT lane_id, 'hold_or_air', 'No sea route avoids ' || array_to_string(avoid, ', ') || '; consider delaying bookings or moving urgent cargo by air.'
  FROM detour WHERE path IS NULL
UNION ALL SELECT lane_id, 'divert_port', 'Disruption at ' || via || ': consider ' || alternate || ' (nearest alternative port).'
  FROM touched JOIN nearest ON port = via WHERE kind = 'endpoint'""")


@query("k02_mitigations", "SELECT lane_id, action, detail FROM actions", ["actions"])
def mitigations(d: Domain) -> DataFrame:
    return d.actions


view("cited", ("hits", "as_of"), """
SELECT event_id, arg_min(lane_id, (lane_id, -weight)) AS first_lane FROM hits, as_of
WHERE published >= as_of - lookback AND published <= as_of GROUP BY event_id""")
view("drivers", ("cited", "alarms"), """
SELECT event_id, first_lane, replace(event_type, '_', ' ') || ' at ' || location || ' (severity ' || severity || ', confidence '
  || printf('%.1f', floor(confidence * 10 + 0.5) / 10) || ', ' || strftime(published, '%Y-%m-%d') || ') [' || event_id || ']' AS driver
FROM cited JOIN alarms USING (event_id)""")


@query("k03_citations", "SELECT event_id, first_lane, driver FROM drivers", ["drivers"])
def citations(d: Domain) -> DataFrame:
    return brief.citations(d.hits, d.visible)


view("draft_lanes", ("lanes", "risk"), """
SELECT lane_id, CASE WHEN (a * b) % 5 = 1 THEN exposure_score + 0.1 ELSE exposure_score END AS exposure_score, rep AS pos
FROM (SELECT lane_id, exposure_score, CAST(substr(origin, 3) AS INTEGER) AS a, CAST(substr(destination, 3) AS INTEGER) AS b
      FROM lanes JOIN risk USING (lane_id)) JOIN (VALUES (1), (2)) r(rep) ON rep = 1 OR (a + 2 * b) % 7 = 0
WHERE (a + b) % 3 <> 0
UNION ALL SELECT 'XX-' || CAST(s_suppkey AS VARCHAR), 0.5::DOUBLE, 1 FROM supplier""")
view("grounded", ("draft_lanes", "risk", "lanes"), """
WITH f AS (SELECT d.lane_id, arg_min(d.exposure_score, d.pos) AS claimed, count(*) AS mentions, any_value(risk.exposure_score) AS computed
           FROM draft_lanes d LEFT JOIN risk USING (lane_id) GROUP BY d.lane_id)
SELECT lane_id, computed AS exposure_score,
  CASE WHEN computed IS NULL OR computed <= 0 THEN 'removed' WHEN abs(computed - claimed) > 1e-6 THEN 'replaced' ELSE 'kept' END AS status,
  CASE WHEN computed IS NULL THEN 'removed lane ' || lane_id || ': unknown lane'
       WHEN computed <= 0 THEN 'removed lane ' || lane_id || ': no visible event touches it'
       WHEN abs(computed - claimed) > 1e-6 THEN lane_id || ': exposure ' || printf('%.3f', claimed) || ' replaced by computed ' || printf('%.3f', computed) END AS note FROM f
UNION ALL SELECT lane_id, computed, 'duplicate', 'removed duplicate lane ' || lane_id FROM f WHERE mentions > 1
UNION ALL SELECT lane_id, exposure_score, 'added', 'added missing lane ' || lane_id || ' (exposure ' || printf('%.3f', exposure_score) || ')'
  FROM risk WHERE exposure_score > 0 AND lane_id NOT IN (SELECT lane_id FROM draft_lanes)""")


@query("k04_ground_brief", "SELECT lane_id, exposure_score, status, note FROM grounded", ["grounded"])
def ground_brief(d: Domain) -> DataFrame:
    return d.grounded


view("draft_actions", ("draft_lanes",), """
SELECT DISTINCT lane_id, unnest(['reroute', 'monitor']) AS action FROM draft_lanes WHERE lane_id NOT LIKE '%2'""")


@query("k04_ground_mitigations", """
WITH final AS (SELECT lane_id, status = 'added' AS added FROM grounded WHERE status IN ('kept', 'replaced', 'added')),
judged AS (SELECT d.lane_id, d.action, added IS NULL AS gone, d.action = 'reroute' AND NOT coalesce(path IS NOT NULL, true) AS blocked
  FROM draft_actions d LEFT JOIN final USING (lane_id) LEFT JOIN (SELECT lane_id, path, true AS asked FROM detour) t USING (lane_id)),
judged2 AS (SELECT j.lane_id, j.action, gone, j.action = 'reroute' AND j.lane_id IN (SELECT lane_id FROM detour WHERE path IS NULL) AS blocked FROM judged j)
SELECT lane_id, action, CASE WHEN gone OR blocked THEN 'removed' ELSE 'kept' END AS status,
  CASE WHEN gone THEN 'removed mitigation for unknown lane ' || lane_id
       WHEN blocked THEN 'removed reroute for ' || lane_id || ': no sea route avoids its disrupted nodes' END AS note FROM judged2
UNION ALL SELECT lane_id, action, 'added', 'added computed mitigations for ' || lane_id FROM actions WHERE lane_id IN (
  SELECT lane_id FROM final WHERE added OR lane_id NOT IN (SELECT lane_id FROM judged2 WHERE NOT gone AND NOT blocked))""",
  ["grounded", "draft_actions", "detour", "actions"])
def ground_mitigations(d: Domain) -> DataFrame:
    words = F.explode(F.array(F.lit("reroute"), F.lit("monitor"))).alias("action")
    draft = d.draft_lanes.filter("lane_id NOT LIKE '%2'").select("lane_id").distinct().select("lane_id", words)
    return brief.ground_mitigations(draft, d.grounded, d.actions, network.reroute_feasible(d.avoid, d.neighbours))


view("draft_cites", (), """
SELECT 'E' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id FROM events""")
view("judged_cites", ("draft_cites", "alarms", "as_of"), """
SELECT DISTINCT event_id, event_id IN (SELECT event_id FROM alarms, as_of WHERE published <= as_of) AS valid FROM draft_cites""")


@query("c18_citation_check", "SELECT event_id, valid FROM judged_cites", ["judged_cites"])
def citation_check(d: Domain) -> DataFrame:
    return brief.check_citations(d.draft_cites, d.alarms, AS_OF)


@query("g06_coverage", "SELECT lane_id, exposure_score FROM grounded WHERE status = 'added'", ["grounded"])
def coverage(d: Domain) -> DataFrame:
    return d.grounded.filter("status = 'added'").select("lane_id", "exposure_score")


@query("g08_lane_overlap", """
SELECT DISTINCT lane_id FROM draft_lanes WHERE lane_id IN (SELECT lane_id FROM risk WHERE exposure_score > 0)""", ["draft_lanes", "risk"])
def lane_overlap(d: Domain) -> DataFrame:
    return d.draft_lanes.select("lane_id").intersect(d.risk.filter("exposure_score > 0").select("lane_id"))


@query("d21_rubric", f"""
WITH l AS (SELECT count(*) FILTER (p) AS proposed, count(*) FILTER (e) AS expected, count(*) FILTER (p AND e) AS hit FROM (
   SELECT lane_id, bool_or(p) AS p, bool_or(e) AS e FROM (SELECT lane_id, true AS p, false AS e FROM draft_lanes
     UNION ALL SELECT lane_id, false, true FROM risk WHERE exposure_score > 0) GROUP BY lane_id)),
c AS (SELECT count(*) AS cited, count(*) FILTER (valid) AS valid, count(*) FILTER (valid AND event_id IN (SELECT event_id FROM cited)) AS relevant FROM judged_cites)
SELECT expected AS expected_lanes, proposed AS proposed_lanes, {rnd('hit / proposed::DOUBLE', 3)} AS lane_precision, {rnd('hit / expected::DOUBLE', 3)} AS lane_recall,
 {rnd('valid / cited::DOUBLE', 3)} AS citation_validity, {rnd('relevant / valid::DOUBLE', 3)} AS citation_relevance, true AS reroute_grounded, true AS completed
FROM l, c""", ["draft_lanes", "risk", "judged_cites", "cited"])
def rubric(d: Domain) -> DataFrame:
    cited = brief.check_citations(d.draft_cites, d.alarms, AS_OF)
    expected = d.risk.filter("exposure_score > 0")
    return brief.rubric(d.draft_lanes, expected, cited, d.contributions, reroutes=1, called_alternates=True, completed=True)


@query("a17_brief_text", """
SELECT section, pos, line FROM (
 SELECT '1 lanes' AS section, printf('%.3f', 1 - exposure_score) || ' ' || lane_id AS pos, '- ' || lane_id || ': exposure ' || printf('%.2f', floor(exposure_score * 100 + 0.5000001) / 100) || ' (' || top_reason || ')' AS line
   FROM risk WHERE exposure_score > 0
 UNION ALL SELECT '2 drivers', event_id, '- ' || driver FROM drivers
 UNION ALL SELECT '3 mitigations', lane_id || ' ' || action || ' ' || detail, '- [' || lane_id || '] ' || action || ': ' || detail FROM actions
 UNION ALL SELECT '4 cited', event_id, '- ' || event_id FROM drivers
 UNION ALL SELECT '1 lanes', '', '## Affected lanes' UNION ALL SELECT '2 drivers', '', '## Drivers'
 UNION ALL SELECT '3 mitigations', '', '## Mitigations' UNION ALL SELECT '4 cited', '', '## Cited events'
 UNION ALL SELECT '0 head', '1', '# Disruption brief (2024-01-21)'
 UNION ALL SELECT '0 head', '2', '**Risk:** ' || CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END
   || ' (' || printf('%.2f', floor(score * 100 + 0.5000001) / 100) || '). Generated by: deterministic.' FROM (SELECT max(exposure_score) AS score FROM risk)
 UNION ALL SELECT '0 head', '3', n || ' of ' || total || ' lanes exposed as of 2024-01-21; highest exposure ' || printf('%.2f', score) || ' on ' || lane || ' (' || why || ').'
   FROM (SELECT count(*) FILTER (exposure_score > 0) AS n, count(*) AS total, max(exposure_score) AS score,
     arg_min(lane_id, (-exposure_score, lane_id)) AS lane, arg_min(top_reason, (-exposure_score, lane_id)) AS why FROM risk))""", ["risk", "drivers", "actions"])
def brief_text(d: Domain) -> DataFrame:
    head = brief.summary(d.risk, AS_OF.date())
    drivers = brief.citations(d.hits, d.visible)
    lines = brief.markdown_lines(head, brief.affected_lanes(d.risk), drivers, d.actions, AS_OF.date())
    return files.round_trip_text(lines)
