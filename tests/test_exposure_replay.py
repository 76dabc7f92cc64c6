import datetime as dt

import pytest

from laneguard.operators import exposure, replay
from tests.net import Net

ONSET = dt.date(2024, 3, 20)
PARAMS = replay.Params(lookback_days=7, threshold=0.5, window_before_days=10, window_after_days=3)
SCHEMA = "event_id string, node_ids array<string>, severity int, confidence double, event_type string, published timestamp_ntz"


@pytest.fixture(scope="module")
def net(spark):
    return Net(spark)


def events(spark, rows):
    full = [(i, n, s, c, t, p if isinstance(p, dt.datetime) else dt.datetime(p.year, p.month, p.day, 12)) for i, n, s, c, t, p in rows]
    return spark.createDataFrame(full, SCHEMA)


def ev(i, node, day, severity=5, conf=1.0, kind="canal_or_strait_blockage"):
    return (i, [node] if isinstance(node, str) else node, severity, conf, kind, day)


def signals(spark, net, rows, windows=None, scoring="v1", lane="WEST-EAST"):
    spec = windows or replay.Spec(PARAMS, (replay.Disruption("d", ONSET, ("CANAL",)),))
    df = events(spark, rows)
    w = spec.windows(spark)
    s = replay.replay(df, exposure.signature_hits(df, net.reach), net.lanes.filter(f"lane_id = '{lane}'"), w, PARAMS, scoring)
    return s, w


def back(n):
    return ONSET - dt.timedelta(days=n)


def test_scores_combine_and_country_counts_half(spark, net):
    df = events(spark, [ev("a", "CANAL", ONSET, 5, 0.8), ev("b", "BBEAS", ONSET, 2, 1.0), ev("c", "CTRY:CC", ONSET, 5, 1.0)])
    rows = {r.lane_id: r for r in exposure.lane_exposure(df, exposure.signature_hits(df, net.reach), net.lanes).collect()}
    assert rows["WEST-EAST"].exposure_score == 0.88 and rows["WEST-EAST"].n_events == 2
    assert rows["WEST-EAST"].top_event_id == "a" and rows["WEST-EAST"].risk_level == "high"
    assert rows["GULF-EAST"].exposure_score == pytest.approx(0.7)  # 1 - (1 - 0.4)(1 - 0.5)


def test_first_direct_node_wins_else_last_country(spark, net):
    df = events(spark, [ev("a", ["CTRY:AA", "NARROW_SEA", "CANAL"], ONSET), ev("b", ["CTRY:BB", "CTRY:AA"], ONSET)])
    got = {(r.event_id, r.lane_id): (r.via, r.kind, r.weight) for r in exposure.exposed_lanes(df, exposure.signature_hits(df, net.reach)).collect()}
    assert got["a", "WEST-EAST"] == ("NARROW_SEA", "on_route", 1.0)
    assert got["b", "WEST-EAST"] == ("CTRY:AA", "country", 0.5)
    assert got["b", "GULF-EAST"] == ("CTRY:BB", "country", 0.5)


def test_top_contributions_equal_a_plain_ranking(spark, net):
    rows = [ev(f"e{i:02d}", ["CANAL", "CTRY:AA", "BBEAS", "CTRY:CC"][i % 4], ONSET, 1 + i % 5, 0.1 * (1 + i % 7)) for i in range(40)]
    df = events(spark, rows)
    hits = exposure.signature_hits(df, net.reach)
    plain = {}
    for r in exposure.exposed_lanes(df, hits).collect():
        plain.setdefault(r.lane_id, []).append((-r.weight, r.event_id))
    got = {}
    for r in exposure.top_contributions(df, hits, 3).collect():
        got.setdefault(r.lane_id, []).append((r["rank"], -r.weight, r.event_id))
    for lane, all_rows in plain.items():
        assert [x[1:] for x in sorted(got[lane])] == sorted(all_rows)[:3]


def test_early_late_and_missed_warnings(spark, net):
    s, w = signals(spark, net, [ev("e", "CANAL", back(4))])
    r = replay.score_disruptions(s, w).first()
    assert (r.first_warning, r.lead_days, r.missed) == (back(4), 4, False)
    s, w = signals(spark, net, [ev("e", "CANAL", ONSET + dt.timedelta(days=2))])
    assert replay.score_disruptions(s, w).first().lead_days == -2
    s, w = signals(spark, net, [ev("e", "BBEAS", back(5))])
    r = replay.score_disruptions(s, w).first()
    assert (r.missed, r.lead_days, r.off_target_days) == (True, None, 5)


def test_event_visible_for_exactly_the_lookback(spark, net):
    s, _ = signals(spark, net, [ev("e", "CANAL", back(10))])
    assert sorted(r.day for r in s.filter("flagged").collect()) == [back(10 - i) for i in range(7)]


def test_last_fraction_of_a_second_belongs_to_the_next_day(spark, net):
    at = lambda us: dt.datetime(2024, 3, 14, 23, 59, 59, us)
    s, _ = signals(spark, net, [ev("e", "CANAL", at(0))])
    assert min(r.day for r in s.filter("flagged").collect()) == dt.date(2024, 3, 14)
    s, _ = signals(spark, net, [ev("e", "CANAL", at(1))])
    assert min(r.day for r in s.filter("flagged").collect()) == dt.date(2024, 3, 15)


def test_weak_events_accumulate(spark, net):
    s, w = signals(spark, net, [ev(f"w{k}", "CANAL", back(k), 2, 0.5) for k in (6, 5, 4, 3)])
    assert replay.score_disruptions(s, w).first().first_warning == back(3)


def test_false_alarms_and_episodes(spark, net):
    spec = replay.Spec(PARAMS, (), ((dt.date(2022, 9, 1), dt.date(2022, 9, 10)), (dt.date(2019, 9, 1), dt.date(2019, 9, 10))))
    s, w = signals(spark, net, [ev("c1", "CANAL", dt.date(2022, 9, 9)), ev("c2", "CANAL", dt.date(2019, 9, 1))], spec)
    r = replay.score_controls(s, w).first()
    assert (r.days, r.flagged_days, r.episodes, r.false_alarm_rate) == (20, 9, 2, 0.45)


def test_v2_counts_a_story_once_and_drops_countries(spark, net):
    copies = [ev(f"d{i}", "CANAL", back(2), 2, 0.5) for i in range(5)]
    day = f"day = DATE '{back(2)}'"
    assert signals(spark, net, copies)[0].filter(day).first().score == pytest.approx(round(1 - 0.8**5, 3))
    one = signals(spark, net, copies, scoring="v2")[0].filter(day).first()
    assert (one.score, one.n_events, one.flagged) == (0.2, 1, False)
    spread = signals(spark, net, [ev(f"s{i}", "CANAL", back(i), 2, 0.5) for i in range(4)], scoring="v2")[0].filter(f"day = DATE '{ONSET}'").first()
    assert spread.score == pytest.approx(round(1 - 0.8**4, 3)) and spread.on_target
    country = [ev(f"c{i}", "CTRY:AA", back(3)) for i in range(2)]
    assert signals(spark, net, country)[0].filter("flagged").count() > 0
    assert signals(spark, net, country, scoring="v2")[0].filter("score > 0").count() == 0


def test_replay_equals_a_row_by_row_replay(spark, net):
    """Pre-aggregated replay against the definition, event by event and day by day."""
    import random

    rnd = random.Random(5)
    nodes = ["CANAL", "BBEAS", "CTRY:AA", "NARROW_SEA", "STRAIT", "CTRY:CC"]
    rows = [ev(f"e{i:03d}", rnd.sample(nodes, rnd.choice([1, 1, 2])), dt.datetime(2024, 3, rnd.randint(1, 24), rnd.randint(0, 23), 59, 59, rnd.choice([0, 5])),
               rnd.randint(1, 5), round(rnd.random() / 4, 3)) for i in range(120)]
    df = events(spark, rows)
    hits = {}
    for r in exposure.exposed_lanes(df, exposure.signature_hits(df, net.reach)).collect():
        hits.setdefault(r.lane_id, []).append((r.event_id, r.weight))
    when = {r[0]: r[5] for r in rows}
    for lane in ("WEST-EAST", "GULF-EAST"):
        s, _ = signals(spark, net, rows, lane=lane)
        for r in s.collect():
            end = dt.datetime(r.day.year, r.day.month, r.day.day, 23, 59, 59)
            seen = [w for e, w in hits[lane] if end - dt.timedelta(days=7) < when[e] <= end]
            alive = 1.0
            for w in seen:
                alive *= 1 - w
            assert r.n_events == len(seen) and r.score == pytest.approx(1 - alive, abs=6e-4)


def test_citations_multiply_no_event_by_its_lanes(spark):
    from laneguard.operators import brief

    cols = "event_id string, node_ids array<string>, event_type string, location string, severity int, confidence double, published timestamp_ntz"
    at = __import__("datetime").datetime(2024, 1, 2)
    rows = [(f"e{i}", ["A"] if i % 2 else ["A", "B"], "port_closure", "X", 3, 0.5, at) for i in range(6)] + [("none", ["Z"], "other", "Y", 1, 0.1, at)]
    hits = spark.createDataFrame([(["A"], lane) for lane in ("l3", "l2", "l9")] + [(["A", "B"], "l1"), (["A", "B"], "l2")], "node_ids array<string>, lane_id string")
    out = brief.citations(hits, spark.createDataFrame(rows, cols))
    got = {r["event_id"]: (r["first_lane"], r["driver"]) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {f"e{i}": "l2" if i % 2 else "l1" for i in range(6)} and out.count() == 6
    assert got["e1"][1] == "port closure at X (severity 3, confidence 0.5, 2024-01-02) [e1]"
