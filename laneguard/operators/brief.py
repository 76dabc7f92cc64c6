"""Risk brief as tables: affected lanes, mitigations, drivers, and the checks applied to any draft."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneguard.functions.numeric import risk_level, stable_round
from laneguard.operators import network
from laneguard.operators.spatial import nearest_in_group
from laneguard.operators.store import ntz

# Fixed values.
BUFFER_FROM_DAYS = 3
REROUTE_ACTIONS = ("reroute", "alternate_routes", "alternate_route", "divert", "reroute_via_cape")
SCORE_TOLERANCE = 1e-6
TOP_LANES = 5


def affected_lanes(risk: DataFrame) -> DataFrame:
    return risk.filter("exposure_score > 0").select(
        "lane_id", "exposure_score", F.col("top_reason").alias("why")
    )


def summary(risk: DataFrame, as_of: dt.date) -> DataFrame:
    """One row: n_affected, n_lanes, risk_score, risk_level, summary."""
    worst = F.min(F.struct((-F.col("exposure_score")).alias("neg"), F.col("lane_id").alias("lane_id"),
                           F.col("top_reason").alias("why")))
    one = risk.agg(F.count_if(F.col("exposure_score") > 0).alias("n_affected"),
                   F.count(F.lit(1)).alias("n_lanes"), worst.alias("w"))
    score = F.when(F.col("n_affected") > 0, -F.col("w.neg")).otherwise(F.lit(0.0))
    text = F.when(
        F.col("n_affected") > 0,
        F.format_string("%d of %d lanes exposed as of %s; highest exposure %.2f on %s (%s).", "n_affected", "n_lanes",
                        F.lit(as_of.isoformat()), score, "w.lane_id", "w.why"),
    ).otherwise(F.format_string("No exposure on %d lanes from events visible as of %s.", "n_lanes", F.lit(as_of.isoformat())))
    return one.select("n_affected", "n_lanes", score.alias("risk_score"), risk_level(score).alias("risk_level"),
                      text.alias("summary"))


def touched_nodes(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Distinct (lane_id, via, kind) over the events; works on distinct node lists, not on events."""
    return events.select("node_ids").distinct().join(hits, "node_ids").select("lane_id", "via", "kind").distinct()


def avoid_lists(touched: DataFrame, lanes: DataFrame) -> DataFrame:
    """lane_id, origin, destination, avoid: the directly touched nodes between the lane's two ends."""
    per = touched.filter("kind = 'on_route'").groupBy("lane_id").agg(F.array_sort(F.collect_set("via")).alias("avoid"))
    return lanes.select("lane_id", "origin", "destination").join(per, "lane_id")


def nearest_alternate_port(nodes: DataFrame) -> DataFrame:
    """port, alternate: the closest other port of the same country, otherwise of the same region.

    Each tier is a grid search in groups of its own (``spatial``); the second one is asked only for what the first left.
    """
    ports = nodes.filter("kind = 'port'")
    placed = lambda df, grp: df.select(F.col("node_id").alias("id"), F.col(grp).alias("grp"), "lat", "lon")
    home = nearest_in_group(placed(ports, "country_code"), placed(ports, "country_code"))
    left = ports.join(home.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    away = nearest_in_group(placed(left, "region"), placed(ports, "region"))
    return home.unionAll(away).select(F.col("id").alias("port"), F.col("other").alias("alternate"), stable_round(F.col("nm"), 1).alias("nm"))


def mitigations(touched: DataFrame, lanes: DataFrame, routes: DataFrame, nodes: DataFrame,
                neighbours: DataFrame) -> DataFrame:
    """lane_id, action, detail. One routing search for all lanes, then one branch per action."""
    asked = avoid_lists(touched, lanes)
    alt = network.alternate_routes(asked, routes, neighbours, k=1).select(
        "lane_id", "chokepoints", "extra_nm", "extra_days"
    )
    detour = asked.join(alt, "lane_id", "left").withColumn("avoid_text", F.array_join("avoid", ", "))
    found = F.col("extra_days").isNotNull()
    via = F.when(F.size("chokepoints") > 0, F.array_join("chokepoints", ", ")).otherwise("open sea")
    reroute = F.when(found, F.struct(
        F.lit("reroute").alias("action"),
        F.format_string("Avoid %s: route via %s, about %+.1f days (%+,.0f nm) vs base.", "avoid_text", via, "extra_days",
                        "extra_nm").alias("detail")))
    stock = F.when(F.col("extra_days") >= BUFFER_FROM_DAYS, F.struct(
        F.lit("buffer_stock").alias("action"),
        F.format_string("Hold about %d extra days of safety stock at %s while the detour applies.",
                        F.bround("extra_days", 0).cast("int"), "destination").alias("detail")))
    hold = F.when(~found, F.struct(
        F.lit("hold_or_air").alias("action"),
        F.format_string("No sea route avoids %s; consider delaying bookings or moving urgent cargo by air.",
                        "avoid_text").alias("detail")))
    by_route = detour.select("lane_id", F.explode(F.array_compact(F.array(reroute, stock, hold))).alias("m")).select(
        "lane_id", "m.action", "m.detail"
    )
    divert = (
        touched.filter("kind = 'endpoint'")
        .join(nearest_alternate_port(nodes).withColumnRenamed("port", "via"), "via")
        .select("lane_id", F.lit("divert_port").alias("action"),
                F.format_string("Disruption at %s: consider %s (nearest alternative port).", "via", "alternate").alias("detail"))
    )
    return by_route.unionByName(divert)


def citations(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Every contributing event (one row per id) once, with the lane where it is first named and its driver line.

    The lane depends only on an event's node list: it is settled once per list in ``hits``, and no event is multiplied by
    its lanes or shuffled.
    """
    first = hits.groupBy("node_ids").agg(F.min("lane_id").alias("first_lane"))
    line = F.format_string(
        "%s at %s (severity %d, confidence %.1f, %s) [%s]", F.replace("event_type", F.lit("_"), F.lit(" ")), "location",
        "severity", "confidence", F.date_format("published", "yyyy-MM-dd"), "event_id",
    )
    return events.join(first, "node_ids").select("event_id", "first_lane", line.alias("driver"))


# --- checks on a draft --------------------------------------------------------------------------


def check_citations(cited: DataFrame, events: DataFrame, as_of: dt.datetime) -> DataFrame:
    """cited ids (distinct) with ``valid``: in the store and not published after ``as_of``."""
    known = events.filter(F.col("published") <= ntz(as_of)).select("event_id", F.lit(True).alias("known"))
    return cited.select("event_id").distinct().join(known, "event_id", "left").select(
        "event_id", F.col("known").isNotNull().alias("valid")
    )


def ground_lanes(draft: DataFrame, risk: DataFrame, in_focus: DataFrame) -> DataFrame:
    """Draft lanes against the computed risk: lane_id, exposure_score, status, note.

    draft: lane_id, exposure_score, pos. The first mention of a lane is kept with its computed score;
    repeats, unknown and untouched lanes are removed; exposed lanes of the focus that the draft left out
    are added.
    """
    firsts = draft.groupBy("lane_id").agg(
        F.min_by("exposure_score", "pos").alias("claimed"), F.count(F.lit(1)).alias("mentions")
    )
    both = firsts.join(risk.select("lane_id", F.col("exposure_score").alias("computed")), "lane_id", "left")
    lane, computed, claimed = F.col("lane_id"), F.col("computed"), F.col("claimed")
    checked = both.select(
        "lane_id", computed.alias("exposure_score"), "mentions",
        F.when(computed.isNull(), "removed").when(computed <= 0, "removed")
        .when(F.abs(computed - claimed) > SCORE_TOLERANCE, "replaced").otherwise("kept").alias("status"),
        F.when(computed.isNull(), F.format_string("removed lane %s: unknown lane", lane))
        .when(computed <= 0, F.format_string("removed lane %s: no visible event touches it", lane))
        .when(F.abs(computed - claimed) > SCORE_TOLERANCE,
              F.format_string("%s: exposure %.3f replaced by computed %.3f", lane, claimed, computed)).alias("note"),
    )
    repeats = checked.filter("mentions > 1").select(
        "lane_id", "exposure_score", F.lit("duplicate").alias("status"),
        F.format_string("removed duplicate lane %s", lane).alias("note"),
    )
    missing = (
        risk.filter("exposure_score > 0")
        .join(in_focus.select("lane_id"), "lane_id", "left_semi")
        .join(draft.select("lane_id"), "lane_id", "left_anti")
        .select("lane_id", "exposure_score", F.lit("added").alias("status"),
                F.format_string("added missing lane %s (exposure %.3f)", lane, F.col("exposure_score")).alias("note"))
    )
    return checked.drop("mentions").unionByName(repeats).unionByName(missing)


def ground_mitigations(draft: DataFrame, grounded: DataFrame, computed: DataFrame, feasible: DataFrame) -> DataFrame:
    """lane_id, action, status, note for draft mitigations, plus computed ones for lanes left without any.

    draft: lane_id, action. grounded: ground_lanes(). computed: mitigations(). feasible: lane_id, feasible.
    """
    final = grounded.filter("status IN ('kept', 'replaced', 'added')").select(
        "lane_id", (F.col("status") == "added").alias("added")
    )
    reroute = F.lower("action").isin(*REROUTE_ACTIONS)
    judged = (
        draft.join(final, "lane_id", "left")
        .join(feasible.select("lane_id", "feasible"), "lane_id", "left")
        .select(
            "lane_id", "action",
            F.when(F.col("added").isNull(), "removed")
            .when(reroute & ~F.coalesce("feasible", F.lit(True)), "removed").otherwise("kept").alias("status"),
            F.when(F.col("added").isNull(), F.format_string("removed mitigation for unknown lane %s", "lane_id"))
            .when(reroute & ~F.coalesce("feasible", F.lit(True)),
                  F.format_string("removed reroute for %s: no sea route avoids its disrupted nodes", "lane_id")).alias("note"),
        )
    )
    covered = judged.filter("status = 'kept'").select("lane_id").distinct()
    needs = final.join(covered.withColumn("covered", F.lit(True)), "lane_id", "left").filter("added OR covered IS NULL")
    extra = computed.join(needs.select("lane_id"), "lane_id", "left_semi").select(
        "lane_id", "action", F.lit("added").alias("status"),
        F.format_string("added computed mitigations for %s", "lane_id").alias("note"),
    )
    return judged.unionByName(extra)


def rubric(proposed: DataFrame, expected: DataFrame, cited: DataFrame, drivers: DataFrame, reroutes: int,
           called_alternates: bool, completed: bool) -> DataFrame:
    """One row of scores for a draft against the computed truth.

    proposed/expected: lane_id. cited: event_id, valid. drivers: event_id of contributing events.
    """
    lanes = (
        proposed.select("lane_id").distinct().withColumn("p", F.lit(1))
        .join(expected.select("lane_id").distinct().withColumn("e", F.lit(1)), "lane_id", "full")
        .agg(F.count("p").alias("proposed"), F.count("e").alias("expected"),
             F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("hit"))
    )
    refs = (
        cited.join(drivers.select("event_id").distinct().withColumn("d", F.lit(1)), "event_id", "left")
        .agg(F.count(F.lit(1)).alias("cited"), F.count_if("valid").alias("valid"),
             F.count_if(F.col("valid") & F.col("d").isNotNull()).alias("relevant"))
    )

    def ratio(a: str, b: str, empty: Column) -> Column:
        return F.when(F.col(b) > 0, stable_round(F.col(a) / F.col(b), 3)).otherwise(empty)

    one = lanes.withColumn("j", F.lit(1)).join(refs.withColumn("j", F.lit(1)), "j")
    return one.select(
        F.col("expected").alias("expected_lanes"), F.col("proposed").alias("proposed_lanes"),
        ratio("hit", "proposed", F.when(F.col("expected") > 0, 0.0).otherwise(1.0)).alias("lane_precision"),
        ratio("hit", "expected", F.lit(1.0)).alias("lane_recall"),
        ratio("valid", "cited", F.lit(1.0)).alias("citation_validity"),
        ratio("relevant", "valid", F.lit(1.0)).alias("citation_relevance"),
        F.lit(reroutes == 0 or called_alternates).alias("reroute_grounded"),
        F.lit(completed).alias("completed"),
    )


def markdown_lines(head: DataFrame, lanes: DataFrame, drivers: DataFrame, actions: DataFrame, as_of: dt.date,
                   author: str = "deterministic") -> DataFrame:
    """section, pos, line: the text report as ordered rows, ready to be written as text."""
    def fixed(section: str, pos: str, line: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(pos).alias("pos"), line.alias("line"))

    risk = F.format_string(f"**Risk:** %s (%.2f). Generated by: {author}.", "risk_level", "risk_score")
    top = head.select(F.explode(F.array(
        fixed("0 head", "1", F.lit(f"# Disruption brief ({as_of})")),
        fixed("0 head", "2", risk),
        fixed("0 head", "3", F.col("summary")),
        fixed("1 lanes", "", F.lit("## Affected lanes")),
        fixed("2 drivers", "", F.lit("## Drivers")),
        fixed("3 mitigations", "", F.lit("## Mitigations")),
        fixed("4 cited", "", F.lit("## Cited events")),
    )).alias("x")).select("x.section", "x.pos", "x.line")

    def part(df: DataFrame, section: str, pos: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), pos.alias("pos"), line.alias("line"))

    return (
        top.unionByName(part(lanes, "1 lanes", F.format_string("%.3f %s", 1 - F.col("exposure_score"), "lane_id"),
                             F.format_string("- %s: exposure %.2f (%s)", "lane_id", "exposure_score", "why")))
        .unionByName(part(drivers, "2 drivers", F.col("event_id"), F.concat(F.lit("- "), "driver")))
        .unionByName(part(actions, "3 mitigations", F.concat_ws(" ", "lane_id", "action", "detail"),
                          F.format_string("- [%s] %s: %s", "lane_id", "action", "detail")))
        .unionByName(part(drivers, "4 cited", F.col("event_id"), F.concat(F.lit("- "), "event_id")))
    )
