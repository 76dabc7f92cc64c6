"""Event store: newest-first listing, search, point lookup, upsert."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneguard.operators.ranking import ranked

# Fixed value: words too general to search for.
FILLER = ("the", "and", "for", "with", "sea", "trade", "disruption", "disruptions", "event", "events", "recent",
          "news", "risk", "shipping", "lane", "lanes")
NO_FOCUS = ("", "all", "any", "none")


def ntz(value: dt.datetime) -> Column:
    """Literal without time zone, whatever the zones of session and machine."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("published"), "event_id")


def visible(events: DataFrame, as_of: dt.datetime, lookback_days: int) -> DataFrame:
    """Closed window ``as_of - lookback <= published <= as_of``; nothing is capped."""
    return events.filter(
        F.col("published").between(ntz(as_of - dt.timedelta(days=lookback_days)), ntz(as_of))
    )


def keywords(text: str | None) -> list[str]:
    return [w for w in re.findall("[a-z]{3,}", (text or "").lower()) if w not in FILLER]


def search(events: DataFrame, text: str | None = None, since: dt.datetime | None = None,
           until: dt.datetime | None = None, min_severity: int = 1, limit: int | None = 20) -> DataFrame:
    """Newest events that carry any keyword in place, summary or type. ``limit=None`` returns all."""
    out = events.filter(F.col("severity") >= min_severity)
    if since is not None:
        out = out.filter(F.col("published") >= ntz(since))
    if until is not None:
        out = out.filter(F.col("published") <= ntz(until))
    words = keywords(text)
    if words:
        hay = F.lower(F.concat_ws(" ", "location", "summary", "event_type"))
        out = out.filter(hay.rlike("|".join(words)))
    out = newest_first(out)
    return out if limit is None else out.limit(limit)


def get_events(events: DataFrame, ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Lookup by id; an event published after ``as_of`` stays hidden."""
    return events.filter(F.col("published") <= ntz(as_of)).join(ids, "event_id", "left_semi")


def event_card(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "event_type", "location", "severity", "confidence",
        F.date_format("published", "yyyy-MM-dd").alias("published"), "summary", "source_url",
    )


def keep_last(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Last write wins: one row per key, the latest by the arrival columns.

    An aggregate and not a ranking window: copies of one key are combined before the shuffle, so a key
    with a third of all rows costs one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in arrival], *[F.col(c) for c in rest if c not in arrival])
    best = rows.groupBy(*keys).agg(F.max_by(packed, F.struct(*arrival)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def list_lanes(lanes: DataFrame, focus: str | None = None) -> DataFrame:
    if (focus or "").lower() in NO_FOCUS:
        return lanes
    return lanes.filter(F.col("focus") == focus)


def source_rank(items: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """``items`` with their rank per ``source``; a source with half of all items is many tasks."""
    return ranked(items, [source], order)
