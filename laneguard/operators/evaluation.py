"""Scoring extracted events against gold labels, and the labelling sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneguard.functions import text as tx
from laneguard.functions.numeric import stable_round
from laneguard.operators.extraction import YES
from laneguard.operators.store import keep_last
from laneguard.schemas import SHEET_COLUMNS

SET_FIELDS = ("event_type", "country_code", "port_code", "location")
DRAFT_ONLY = "draft_unconfirmed"
EVENT_CELLS = "array<struct<event_type: string, location: string, country_code: string, port_code: string, severity: int>>"


def last_record(records: DataFrame, arrival: list[str]) -> DataFrame:
    return keep_last(records, ["news_id"], arrival)


def joined_predictions(gold: DataFrame, records: DataFrame) -> DataFrame:
    """gold ⟕ records on news_id; missing and failed predictions count as empty.

    records must hold one row per news_id (see last_record).
    """
    cells = lambda e: F.struct(*[e[c].alias(c) for c in ("event_type", "location", "country_code", "port_code", "severity")])
    pred = records.select(
        "news_id", "status", F.col("is_disruption").alias("flag"), F.transform("events", cells).alias("found")
    )
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return gold.join(pred, "news_id", "left").select(
        "news_id", F.col("is_disruption").alias("gold_flag"), F.col("events").alias("gold_events"), "label_source",
        (ok & F.coalesce("flag", F.lit(False))).alias("pred_flag"),
        F.when(ok, F.col("found")).otherwise(F.array().cast(EVENT_CELLS)).alias("pred_events"),
        F.col("status").isNull().alias("missing"), F.coalesce(F.col("status") == "failed", F.lit(False)).alias("failed"),
    )


def _values(events: Column, field: str) -> Column:
    raw = F.filter(F.transform(events, lambda e: e[field]), lambda v: v.isNotNull())
    return F.array_distinct(F.transform(raw, tx.eval_name if field == "location" else F.upper))


def field_counts(pairs: DataFrame) -> DataFrame:
    """One row: tp, fp, fn per field as columns, by plain sums over the items."""
    p, g = F.col("pred_flag"), F.col("gold_flag")
    cols = [F.count_if(p & g).alias("is_disruption_tp"), F.count_if(p & ~g).alias("is_disruption_fp"), F.count_if(g & ~p).alias("is_disruption_fn")]
    for f in SET_FIELDS:
        gv, pv = _values(F.col("gold_events"), f), _values(F.col("pred_events"), f)
        cols += [
            F.sum(F.size(F.array_intersect(gv, pv))).alias(f"{f}_tp"), F.sum(F.size(F.array_except(pv, gv))).alias(f"{f}_fp"),
            F.sum(F.size(F.array_except(gv, pv))).alias(f"{f}_fn"),
        ]
    return pairs.agg(*cols)


def prf(pairs: DataFrame) -> DataFrame:
    """field, precision, recall, f1, support (micro-averaged over items)."""
    fields = ("is_disruption", *SET_FIELDS)
    rows = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"{f}_tp").alias("tp"), F.col(f"{f}_fp").alias("fp"), F.col(f"{f}_fn").alias("fn")) for f in fields
    ])
    c = field_counts(pairs).select(F.inline(rows))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(precision * 2 * recall, precision + recall)
    return c.select(
        "field", stable_round(precision, 3).alias("precision"), stable_round(recall, 3).alias("recall"), stable_round(f1, 3).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def severity_pairs(pairs: DataFrame) -> DataFrame:
    """news_id, location, gold, pred severity for gold events whose place was predicted too.

    The last prediction per place counts. Both lists belong to one item, so they are matched inside the row.
    """
    place = lambda e: tx.eval_name(e["location"])
    by_place = F.transform("pred_events", lambda e: F.struct(place(e).alias("place"), e["severity"].alias("severity")))
    listed = pairs.select("news_id", "gold_events", by_place.alias("p"))
    rows = listed.select("news_id", "p", F.explode("gold_events").alias("g")).filter("g.severity IS NOT NULL")
    same = F.filter("p", lambda x: x["place"] == tx.eval_name(F.col("g.location")))
    return (
        rows.select("news_id", tx.eval_name(F.col("g.location")).alias("location"), F.col("g.severity").alias("gold"),
                    F.try_element_at(same, F.lit(-1))["severity"].alias("pred"))
        .filter("pred IS NOT NULL")
    )


def severity_stats(matched: DataFrame) -> DataFrame:
    d = F.abs(F.col("gold") - F.col("pred"))
    share = lambda c: stable_round(F.avg(c.cast("double")), 3)
    return matched.agg(
        F.count(F.lit(1)).alias("aligned_events"), share(d == 0).alias("exact"), share(d <= 1).alias("within_1"),
        stable_round(F.avg(d.cast("double")), 3).alias("mae"),
    )


def outcome_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("items"), F.count_if("failed").alias("failed"), F.count_if("missing").alias("missing"))


# --- labelling sheet --------------------------------------------------------------------------------


def blank_sheet(items: DataFrame) -> DataFrame:
    """One sheet row per item with empty label columns."""
    cells = {
        "news_id": F.col("id"), "source": F.col("source"), "published": F.date_format("published", "yyyy-MM-dd"),
        "title": F.col("title"), "text": F.col("summary"), "url": F.col("url"),
    }
    return items.select(*[cells.get(c, F.lit("")).alias(c) for c in SHEET_COLUMNS])


def template(items: DataFrame, n: int, seed: int) -> DataFrame:
    """n items in seeded order to label by hand. The same seed gives the same rows on any cluster."""
    order = F.sha1(F.concat_ws("|", "id", F.lit(str(seed))))
    return blank_sheet(items.orderBy(order, "id").limit(n))


def is_labeled() -> Column:
    return F.trim(F.coalesce("is_disruption", F.lit(""))) != ""


def blank(c: Column) -> Column:
    return F.nullif(tx.strip(c), F.lit(""))


def pending(rows: DataFrame) -> DataFrame:
    """news_ids without any labelled row, with their first position in the sheet."""
    done = rows.filter(is_labeled()).select("news_id").distinct()
    return rows.join(done, "news_id", "left_anti").groupBy("news_id").agg(F.min("pos").alias("pos"))


def sheet_to_gold(rows: DataFrame) -> DataFrame:
    """Sheet rows (with ``pos``) -> one gold item per news_id; blanks and unconfirmed drafts are skipped.

    The first labelled row decides the flag. Events keep sheet order; a person labels a handful per item.
    """
    flag = F.lower(tx.strip(F.coalesce("is_disruption", F.lit(""))))
    used = rows.filter((flag != "") & (tx.strip(F.coalesce("label_source", F.lit(""))) != DRAFT_ONLY))
    event = F.struct(
        "pos", tx.strip(F.col("event_type")).alias("event_type"), tx.strip(F.coalesce("location", F.lit(""))).alias("location"),
        blank(F.col("country_code")).alias("country_code"), blank(F.col("port_code")).alias("port_code"),
        blank(F.col("severity")).try_cast("int").alias("severity"),
    )
    items = used.groupBy(tx.strip(F.col("news_id")).alias("news_id")).agg(
        F.min_by(flag.isin(*YES), "pos").alias("is_disruption"), F.min_by(blank(F.col("label_source")), "pos").alias("label_source"),
        F.array_sort(F.collect_list(F.when(blank(F.col("event_type")).isNotNull(), event))).alias("all"),
    )
    bare = F.transform("all", lambda e: F.struct(*[e[c].alias(c) for c in ("event_type", "location", "country_code", "port_code", "severity")]))
    return items.select(
        "news_id", "is_disruption", F.when(F.col("is_disruption"), bare).otherwise(F.array().cast(EVENT_CELLS)).alias("events"), "label_source"
    )


def gold_to_sheet(gold: DataFrame, base: DataFrame, source: str, draft_model: str, note: str = "") -> DataFrame:
    """One sheet row per gold event (one blank row without events) on top of the item's base row."""
    flat = gold.select(
        "news_id", F.when(F.col("is_disruption"), "yes").otherwise("no").alias("flag"),
        F.explode_outer(F.when(F.col("is_disruption"), F.col("events"))).alias("e"),
    )
    text = lambda c: F.coalesce(F.col(f"e.{c}").cast("string"), F.lit(""))
    cells = {
        "is_disruption": F.col("flag"), "event_type": text("event_type"), "location": text("location"), "country_code": text("country_code"),
        "port_code": text("port_code"), "severity": text("severity"), "label_source": F.lit(source), "draft_model": F.lit(draft_model),
        "notes": F.lit(note) if note else F.col("notes"),
    }
    return base.join(flat, "news_id").select(*[(cells[c] if c in cells else F.col(c)).alias(c) for c in SHEET_COLUMNS])


def records_to_gold(records: DataFrame) -> DataFrame:
    """Successful records in the gold shape (drafts for a person to confirm)."""
    cells = lambda e: F.struct(*[e[c].alias(c) for c in ("event_type", "location", "country_code", "port_code", "severity")])
    return records.filter("status = 'ok'").select(
        "news_id", "is_disruption", F.transform("events", cells).alias("events"), F.lit(None).cast("string").alias("label_source")
    )


def label_sources(rows: DataFrame) -> DataFrame:
    """Labelled items per source of their first labelled row."""
    first = rows.filter(is_labeled()).groupBy("news_id").agg(F.min_by("label_source", "pos").alias("s"))
    return first.groupBy(F.coalesce(F.nullif("s", F.lit("")), F.lit("hand_csv")).alias("label_source")).agg(F.count(F.lit(1)).alias("items"))
