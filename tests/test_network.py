import pytest
from pyspark.sql import functions as F

from laneguard.operators import network
from tests.net import LANES, Net, all_paths


@pytest.fixture(scope="module")
def net(spark):
    return Net(spark)


@pytest.fixture(scope="module")
def lengths(net):
    return [(r.from_node, r.to_node, r.tenths) for r in network.leg_lengths(net.nodes, net.legs).collect()]


def test_base_routes_equal_brute_force(net, lengths):
    got = {r.lane_id: (round(r.distance_nm * 10), r.n_hops, tuple(r.path)) for r in net.routes.collect()}
    for lane, a, b, _ in LANES:
        assert got[lane] == all_paths(lengths, a, b)[0]


@pytest.mark.parametrize("avoid", [[], ["NARROW_SEA"], ["CANAL", "BBEAS"]])
def test_k_best_routes_equal_brute_force(spark, net, lengths, avoid):
    asked = net.lanes.select("lane_id", "origin", "destination", F.array(*[F.lit(a) for a in avoid]).cast("array<string>").alias("avoid"))
    got = {}
    for r in network.alternate_routes(asked, net.routes, net.neighbours, k=4).orderBy("rank").collect():
        got.setdefault(r.lane_id, []).append((round(r.distance_nm * 10), r.n_hops, tuple(r.path)))
    for lane, a, b, _ in LANES:
        assert got.get(lane, []) == all_paths(lengths, a, b, set(avoid) - {a, b})[:4]


def test_few_rounds_per_pass_reach_the_same_labels(net):
    none = F.array().cast("array<string>")
    req = net.lanes.select("origin").distinct().select(
        F.col("origin").alias("req_id"), network._from_origin(F.col("origin")).alias("start"), none.alias("banned"), none.alias("banned_arcs"))
    rows = lambda n: sorted((r.req_id, r.node, tuple(r.best.path)) for r in network.best_labels(req, net.neighbours, n).collect())
    assert rows(1) == rows(8)


def test_no_way_around_the_strait(net):
    asked = net.lanes.filter("lane_id = 'GULF-EAST'").select("lane_id", "origin", "destination", F.array(F.lit("STRAIT")).alias("avoid"))
    assert network.alternate_routes(asked, net.routes, net.neighbours).count() == 0
    assert network.reroute_feasible(asked, net.neighbours).first().feasible is False


def test_detour_cost_is_the_difference_of_rounded_values(net):
    asked = net.lanes.filter("lane_id = 'WEST-EAST'").select("lane_id", "origin", "destination", F.array(F.lit("CANAL")).alias("avoid"))
    alt = network.alternate_routes(asked, net.routes, net.neighbours, k=1).first()
    base = net.routes.filter("lane_id = 'WEST-EAST'").first()
    assert alt.chokepoints == ["SOUTH_CAPE"]
    assert alt.extra_days == pytest.approx(alt.days - base.days, abs=1e-9)
    assert alt.extra_nm > 0


def test_unknown_event_nodes_are_refused(spark, net):
    ev = spark.createDataFrame([("e", ["CANAL", "NOWHERE"])], "event_id string, node_ids array<string>")
    with pytest.raises(KeyError):
        network.add_events(ev, net.nodes)
    assert network.add_events(ev.select("event_id", F.array(F.lit("CTRY:AA")).alias("node_ids")), net.nodes).count() == 1
