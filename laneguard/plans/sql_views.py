"""DuckDB views that derive the domain tables, used only by the check SQL.

Independent of the Spark side on purpose: routes are found by listing every simple path, history by a
range join, and so on, so that agreement means something.
"""

from __future__ import annotations


def rnd(x: str, digits: int) -> str:
    scale = float(10**digits)
    return f"(floor(({x}) * {scale} + 0.5000001) / {scale})"


# name -> (views it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (needs, body)


def compose(needs, final: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return final
    ctes = ",\n".join(f"{n.split('(')[0]} AS ({VIEWS[n][1]})" for n in order)
    final = final.strip()
    if final.startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{final[5:]}"
    return f"WITH RECURSIVE {ctes}\n{final}"


# --- network ------------------------------------------------------------------------------------

view("nodes", (), """
SELECT n_nationkey AS k, n_name AS name,
  CASE WHEN n_nationkey % 7 IN (3, 5) THEN 'WP_' || chr(CAST(65 + n_nationkey AS INTEGER))
       ELSE 'R' || chr(CAST(65 + n_regionkey AS INTEGER)) || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') END AS node_id,
  CASE n_nationkey % 7 WHEN 3 THEN 'chokepoint' WHEN 5 THEN 'sea_region' ELSE 'port' END AS kind,
  CAST(-60 + 5 * n_nationkey AS DOUBLE) AS lat, CAST((37 * n_nationkey) % 360 - 180 AS DOUBLE) AS lon,
  CASE WHEN n_nationkey % 7 IN (3, 5) THEN NULL ELSE 'R' || chr(CAST(65 + n_regionkey AS INTEGER)) END AS country_code,
  CASE WHEN n_regionkey < 2 THEN 'WEST' ELSE 'EAST' END AS region, r_name AS region_name,
  'R' || chr(CAST(65 + n_regionkey AS INTEGER)) AS owner
FROM nation JOIN region ON n_regionkey = r_regionkey""")

view("legs", ("nodes",), """
SELECT a.node_id AS from_node, b.node_id AS to_node FROM nodes a JOIN nodes b ON b.k = (a.k + 1) % 25
UNION ALL
SELECT a.node_id, b.node_id FROM nodes a JOIN nodes b ON b.k = (a.k + 7) % 25 WHERE a.k % 3 = 0""")

view("leg_len", ("legs", "nodes"), """
SELECT from_node, to_node, CAST(floor(10.0 * 2 * 3440.065 * asin(sqrt(
   pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
   + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) + 0.5000001) AS BIGINT) AS tenths
FROM legs JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node""")

view("arcs", ("leg_len",), """
SELECT from_node AS a, to_node AS b, tenths FROM leg_len UNION ALL SELECT to_node, from_node, tenths FROM leg_len""")

view("lane_pairs", ("nodes",), """
SELECT DISTINCT s.k AS sk, c.k AS ck
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
JOIN nodes s ON s.k = s_nationkey JOIN nodes c ON c.k = c_nationkey""")

view("lanes", ("lane_pairs", "nodes"), """
SELECT s.node_id || '-' || c.node_id AS lane_id, s.node_id AS origin, c.node_id AS destination,
  lower(s.region_name) || '_' || lower(c.region_name) AS focus
FROM lane_pairs JOIN nodes s ON s.k = sk JOIN nodes c ON c.k = ck
WHERE sk <> ck AND s.kind = 'port' AND c.kind = 'port'""")

view("paths", ("nodes", "arcs"), """
SELECT node_id AS origin, node_id AS v, CAST(0 AS BIGINT) AS tenths, [node_id] AS path FROM nodes WHERE kind = 'port'
UNION ALL
SELECT p.origin, arcs.b, p.tenths + arcs.tenths, list_append(p.path, arcs.b)
FROM paths p JOIN arcs ON arcs.a = p.v WHERE NOT list_contains(p.path, arcs.b)""")

view("shortest", ("paths",), """
SELECT origin, v AS destination, tenths, path, len(path) - 1 AS hops FROM paths
QUALIFY row_number() OVER (PARTITION BY origin, v ORDER BY tenths, len(path), path) = 1""")

view("routes", ("lanes", "shortest"), f"""
SELECT lane_id, origin, destination, path, tenths, tenths / 10.0::DOUBLE AS distance_nm,
  {rnd('tenths / 10.0::DOUBLE / 14.0::DOUBLE / 24.0::DOUBLE', 1)} AS days, hops
FROM lanes JOIN shortest USING (origin, destination)""")

# --- disruption events --------------------------------------------------------------------------

view("alarms", ("nodes",), f"""
SELECT 'E' || lpad(CAST(e.event_id AS VARCHAR), 12, '0') AS event_id, e.ts AS published,
  CASE e.event_type WHEN 'purchase' THEN 'port_congestion' WHEN 'click' THEN 'labor_strike' WHEN 'view' THEN 'severe_weather' WHEN 'signup' THEN 'accident'
       ELSE CASE e.event_id % 4 WHEN 0 THEN 'conflict_or_attack' WHEN 1 THEN 'severe_weather' WHEN 2 THEN 'labor_strike' ELSE 'port_congestion' END END AS event_type,
  a.name AS location, CAST(1 + e.event_id % 5 AS INTEGER) AS severity,
  {rnd("e.value / 500.0::DOUBLE * (e.value / 500.0::DOUBLE) * CASE e.event_type WHEN 'purchase' THEN 0.2::DOUBLE WHEN 'click' THEN 0.1::DOUBLE WHEN 'view' THEN 0.05::DOUBLE WHEN 'signup' THEN 0.02::DOUBLE ELSE 1.0::DOUBLE END", 4)} AS confidence,
  CASE WHEN e.user_id % 10 = 0 AND e.event_id % 7 = 0 THEN ['CTRY:' || a.owner, b.node_id]
       WHEN e.user_id % 10 = 0 THEN ['CTRY:' || a.owner]
       WHEN e.event_id % 7 = 0 THEN [a.node_id, b.node_id] ELSE [a.node_id] END AS node_ids,
  a.country_code, 'signal ' || e.props AS summary, 'http://alerts.example.com/' || CAST(e.event_id AS VARCHAR) AS source_url
FROM events e JOIN nodes a ON a.k = e.user_id % 25 JOIN nodes b ON b.k = (e.user_id + 11) % 25""")

view("graph_nodes", ("nodes",), """
SELECT node_id, kind, name FROM nodes
UNION ALL SELECT DISTINCT 'CTRY:' || country_code, 'country', country_code FROM nodes WHERE country_code IS NOT NULL""")

view("reach", ("routes", "lanes", "nodes"), """
SELECT lane_id, node, CASE WHEN node IN (origin, destination) THEN 'endpoint' ELSE 'on_route' END AS kind
FROM (SELECT lane_id, origin, destination, unnest(path) AS node FROM routes)
UNION ALL
SELECT DISTINCT lane_id, 'CTRY:' || country_code, 'country' FROM lanes JOIN nodes
  ON node_id IN (origin, destination) WHERE country_code IS NOT NULL""")

view("hits", ("alarms", "reach"), f"""
SELECT event_id, lane_id, via, kind, published, event_type,
  {rnd("severity / 5.0::DOUBLE * confidence * CASE kind WHEN 'country' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END", 3)} AS weight
FROM (SELECT e.*, r.lane_id, r.node AS via, r.kind,
        row_number() OVER (PARTITION BY e.event_id, r.lane_id
          ORDER BY r.kind = 'country', CASE WHEN r.kind = 'country' THEN -pos ELSE pos END) AS rn
      FROM (SELECT *, unnest(node_ids) AS node, generate_subscripts(node_ids, 1) AS pos FROM alarms) e
      JOIN reach r ON r.node = e.node) WHERE rn = 1""")

view("as_of", (), "SELECT TIMESTAMP '2024-01-21 12:00:00' AS as_of, INTERVAL 14 DAY AS lookback")

view("visible", ("alarms", "as_of"), """
SELECT alarms.* FROM alarms, as_of WHERE published >= as_of - lookback AND published <= as_of""")

view("risk", ("hits", "lanes", "as_of"), f"""
SELECT lane_id, exposure_score,
  CASE WHEN exposure_score >= 0.6 THEN 'high' WHEN exposure_score >= 0.3 THEN 'medium'
       WHEN exposure_score > 0 THEN 'low' ELSE 'none' END AS risk_level, n_events, top_event_id, top_reason
FROM (SELECT lanes.lane_id, {rnd('1.0::DOUBLE - coalesce(product(1.0::DOUBLE - weight), 1.0::DOUBLE)', 3)} AS exposure_score,
        count(event_id) AS n_events, arg_min(event_id, (-weight, event_id)) AS top_event_id,
        arg_min(CASE kind WHEN 'endpoint' THEN 'event at lane endpoint ' || via WHEN 'on_route' THEN 'event on route at ' || via
                ELSE 'event in endpoint country ' || substr(via, 6) END, (-weight, event_id)) AS top_reason
      FROM lanes LEFT JOIN (SELECT hits.* FROM hits, as_of WHERE published >= as_of - lookback AND published <= as_of) USING (lane_id)
      GROUP BY lanes.lane_id)""")
