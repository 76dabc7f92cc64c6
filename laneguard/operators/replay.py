"""Daily replay of lane exposure, lead time and false alarms.

An event published up to 23:59:59 of a day belongs to that day and stays visible for the lookback: the
day itself and the next ``lookback - 1`` days. Days are handled as an equi-join on the day, never as a
range join, and events are combined per (day, node list) before they meet lanes or days.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laneguard.functions.numeric import stable_round, survival
from laneguard.operators.exposure import country_weight, direct_weight


@dataclass(frozen=True)
class Params:
    lookback_days: int = 7
    threshold: float = 0.5
    window_before_days: int = 30
    window_after_days: int = 7


@dataclass(frozen=True)
class Disruption:
    id: str
    onset: dt.date
    target_nodes: tuple[str, ...]
    name: str = ""
    secondary_label: str | None = None
    secondary_date: dt.date | None = None


@dataclass(frozen=True)
class Spec:
    """What to replay: parameters and a handful of dated windows (never data-sized)."""

    params: Params
    disruptions: tuple[Disruption, ...] = ()
    control_windows: tuple[tuple[dt.date, dt.date], ...] = ()
    primary_lane: str | None = None
    secondary_lane_focus: tuple[str, ...] = field(default=())

    def windows(self, spark: SparkSession) -> DataFrame:
        """window_id, kind, start, end, onset, secondary_label, secondary_date, target_nodes."""
        before = dt.timedelta(days=self.params.window_before_days)
        after = dt.timedelta(days=self.params.window_after_days)
        rows = [
            (d.id, "disruption", d.onset - before, d.onset + after, d.onset, d.secondary_label, d.secondary_date, d.target_nodes)
            for d in self.disruptions
        ]
        rows += [(f"control_{i + 1}", "control", a, b, None, None, None, ()) for i, (a, b) in enumerate(self.control_windows)]
        names = ("window_id", "kind", "start", "end", "onset", "secondary_label", "secondary_date", "target_nodes")
        types = ("string", "string", "date", "date", "date", "string", "date", "array<string>")

        def cell(value, kind: str) -> Column:
            made = F.array(*[F.lit(v) for v in value]) if isinstance(value, tuple) else F.lit(value)
            return made.cast(kind)

        structs = [F.struct(*[cell(v, t).alias(n) for v, n, t in zip(r, names, types, strict=True)]) for r in rows]
        one = spark.range(0, 1, 1, 1)
        if not structs:
            return one.filter("false").select(*[F.lit(None).cast(t).alias(n) for n, t in zip(names, types, strict=True)])
        return one.select(F.inline(F.array(*structs)))


def day_bucket(published: Column) -> Column:
    """Day on which an event first counts; the last fraction of a second belongs to the next day."""
    return F.to_date(published + F.expr("INTERVAL '0.999999' SECOND"))


def needed_days(windows: DataFrame, lookback_days: int) -> DataFrame:
    """Every day whose news is needed: all windows, each with its lookback in front."""
    days = F.sequence(F.date_sub("start", lookback_days), F.col("end"))
    return windows.select(F.explode(days).alias("day")).distinct()


def _visible_days(lookback_days: int) -> Column:
    return F.explode(F.sequence(F.col("bucket"), F.date_add("bucket", lookback_days - 1)))


def _window_days(windows: DataFrame) -> DataFrame:
    return windows.select("window_id", "target_nodes", F.explode(F.sequence("start", "end")).alias("day"))


def visible_per_day(events: DataFrame, windows: DataFrame, lookback_days: int) -> DataFrame:
    """(window_id, day): how many events are visible and the smallest id, for days that see any."""
    per_bucket = events.groupBy(day_bucket(F.col("published")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")
    )
    return (
        per_bucket.withColumn("day", _visible_days(lookback_days))
        .join(_window_days(windows), "day")
        .groupBy("window_id", "day")
        .agg(F.sum("n").alias("n_events"), F.min("first_event").alias("first_event"))
    )


def node_signal(events: DataFrame, days: DataFrame, lookback_days: int) -> DataFrame:
    """Sliding noisy-OR per node and day: one partial result per (node, publication day), then the lookback."""
    per_bucket = (
        events.select(F.explode("node_ids").alias("node"), day_bucket(F.col("published")).alias("bucket"),
                      direct_weight().alias("w"))
        .groupBy("node", "bucket")
        .agg(survival(F.col("w")).alias("s"), F.count(F.lit(1)).alias("n"))
    )
    return (
        per_bucket.withColumn("day", _visible_days(lookback_days))
        .join(days, "day")
        .groupBy("node", "day")
        .agg(stable_round(F.lit(1.0) - F.product("s"), 3).alias("score"), F.sum("n").alias("n_events"))
    )


def _stories_v1(events: DataFrame, hits: DataFrame) -> DataFrame:
    """(lane_id, via, bucket, s, n): events combined per (day, node list), then spread to lanes."""
    per_list = (
        events.withColumn("bucket", day_bucket(F.col("published")))
        .groupBy("bucket", "node_ids")
        .agg(
            survival(direct_weight()).alias("ds"),
            survival(country_weight()).alias("cs"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    s = F.when(F.col("kind") == "country", F.col("cs")).otherwise(F.col("ds"))
    return per_list.join(hits, "node_ids").select("lane_id", "via", "bucket", s.alias("s"), "n")


def v2_stories(events: DataFrame, hits: DataFrame) -> DataFrame:
    """One hit per lane and story (publication date, type, node): the strongest; country hits dropped.

    The strongest event per node list is taken first, so the lanes only ever meet one row per list,
    date and type. Equal weights: the earlier publication, then the smaller id.
    """
    best = F.min(
        F.struct((-F.col("w")).alias("neg"), F.col("published").alias("published"), F.col("event_id").alias("event_id"))
    )
    per_list = (
        events.withColumn("pub_date", F.to_date("published"))
        .withColumn("w", direct_weight())
        .groupBy("pub_date", "event_type", "node_ids")
        .agg(best.alias("b"))
    )
    return (
        per_list.join(hits.filter("kind <> 'country'"), "node_ids")
        .groupBy("lane_id", "pub_date", "event_type", "via")
        .agg(F.min("b").alias("b"))
        .select(
            "lane_id", "pub_date", "event_type", "via", (-F.col("b.neg")).alias("weight"), F.col("b.event_id").alias("event_id"),
            day_bucket(F.col("b.published")).alias("bucket"),
        )
    )


def replay(events: DataFrame, hits: DataFrame, lanes: DataFrame, windows: DataFrame, params: Params,
           scoring: str = "v1") -> DataFrame:
    """Signals per (window, lane, day): score, flagged, on_target, n_events, nodes.

    ``lanes`` supplies the spine: a lane without events still has its days, with score 0.
    """
    if scoring == "v2":
        parts = v2_stories(events, hits).select(
            "lane_id", "via", "bucket", (F.lit(1.0) - F.col("weight")).alias("s"), F.lit(1).cast("bigint").alias("n")
        )
    else:
        parts = _stories_v1(events, hits)
    # Combined per lane and publication day first, so that the lookback multiplies few rows. The node
    # lists are bounded by the length of the lane's route.
    per_day = parts.groupBy("lane_id", "bucket").agg(
        F.product("s").alias("s"), F.sum("n").alias("n"), F.collect_set("via").alias("vias")
    )
    scored = (
        per_day.withColumn("day", _visible_days(params.lookback_days))
        .join(_window_days(windows), "day")
        .groupBy("window_id", "lane_id", "day")
        .agg(
            F.product("s").alias("s"),
            F.sum("n").alias("n_events"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("vias")))).alias("nodes"),
        )
    )
    bounds = F.array_agg(F.struct("window_id", "start", "end", "target_nodes"))
    spine = _lane_days(lanes, windows.agg(bounds.alias("w")).first().w)
    score = stable_round(F.lit(1.0) - F.coalesce("s", F.lit(1.0)), 3)
    nodes = F.coalesce("nodes", F.array().cast("array<string>"))
    flagged = score >= params.threshold
    return spine.join(scored, ["window_id", "lane_id", "day"], "left").select(
        "window_id", "lane_id", "day", score.alias("score"), flagged.alias("flagged"),
        (flagged & F.arrays_overlap(nodes, "target_nodes")).alias("on_target"),
        F.coalesce("n_events", F.lit(0).cast("bigint")).alias("n_events"), nodes.alias("nodes"),
    )


def _lane_days(lanes: DataFrame, windows: list) -> DataFrame:
    """Every lane on every day of every window, by exploding a literal list of the few windows."""
    each = [
        F.struct(
            F.lit(w.window_id).alias("window_id"),
            F.array(*[F.lit(n) for n in w.target_nodes]).cast("array<string>").alias("target_nodes"),
            F.sequence(F.lit(w.start), F.lit(w.end)).alias("days"),
        )
        for w in windows
    ]
    return (
        lanes.select("lane_id", F.explode(F.array(*each)).alias("w"))
        .select("lane_id", "w.window_id", "w.target_nodes", F.explode("w.days").alias("day"))
    )


def score_disruptions(signals: DataFrame, windows: DataFrame) -> DataFrame:
    """Lead time per (disruption, lane): positive before the onset, negative after, NULL when missed."""
    known = windows.filter("kind = 'disruption'").select(
        F.col("window_id").alias("disruption_id"), "onset", "secondary_label", "secondary_date"
    )
    per = (
        signals.withColumnRenamed("window_id", "disruption_id")
        .join(known, "disruption_id")
        .groupBy("disruption_id", "lane_id", "onset", "secondary_label", "secondary_date")
        .agg(
            F.min(F.when(F.col("on_target"), F.col("day"))).alias("first_warning"),
            F.count_if((F.col("day") < F.col("onset")) & F.col("flagged") & ~F.col("on_target")).alias("off_target_days"),
            F.max("score").alias("peak_score"),
        )
    )
    reference = F.when(
        F.col("secondary_label").isNotNull(),
        F.format_string("%s (%s)", "secondary_label", F.col("secondary_date").cast("string")),
    )
    return per.select(
        "disruption_id", "lane_id", "onset", "first_warning",
        F.date_diff("onset", "first_warning").alias("lead_days"),
        F.col("first_warning").isNull().alias("missed"),
        reference.alias("secondary_reference"),
        F.date_diff("secondary_date", "first_warning").alias("lead_vs_secondary_days"),
        "off_target_days", "peak_score",
    )


def flag_episodes(signals: DataFrame) -> DataFrame:
    """signals + ``starts``: the day begins a run of flagged days within its window."""
    w = W.partitionBy("window_id", "lane_id").orderBy("day")
    before = F.coalesce(F.lag("flagged").over(w), F.lit(False))
    return signals.withColumn("starts", F.col("flagged") & ~before)


def score_controls(signals: DataFrame, windows: DataFrame) -> DataFrame:
    """False-alarm share over all control windows; episodes never span two windows."""
    controls = windows.filter("kind = 'control'").select("window_id")
    return (
        flag_episodes(signals.join(controls, "window_id", "left_semi"))
        .groupBy("lane_id")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.count_if("flagged").alias("flagged_days"),
            stable_round(F.avg(F.col("flagged").cast("double")), 3).alias("false_alarm_rate"),
            F.count_if("starts").alias("episodes"),
        )
    )


def watched_lanes(lanes: DataFrame, primary: Column, focuses: list[str]) -> DataFrame:
    """The primary lane first, then the lanes of the secondary focuses by id."""
    is_primary = F.col("lane_id") == primary
    return lanes.filter(is_primary | F.col("focus").isin(*focuses)).select(
        "lane_id", "focus", is_primary.alias("is_primary")
    )


def roll_up(results: DataFrame) -> DataFrame:
    """Per disruption: lanes warned of lanes replayed, and the median lead time of the warned."""
    return results.groupBy("disruption_id").agg(
        F.count_if(~F.col("missed")).alias("lanes_warned"),
        F.count(F.lit(1)).alias("lanes"),
        F.median("lead_days").alias("median_lead_days"),
        F.max("peak_score").alias("peak_score"),
    )
