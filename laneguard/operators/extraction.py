"""Event extraction: keyword rules, reply validation, records, prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from laneguard import schemas
from laneguard.functions import text as tx
from laneguard.functions.numeric import stable_round

# --- fixed values: event types, their spellings, and the keyword rules in order of precedence ---------
EVENT_TYPES = (
    "port_closure", "port_congestion", "canal_or_strait_blockage", "labor_strike", "severe_weather", "conflict_or_attack",
    "accident", "sanctions_or_regulation", "infrastructure_failure", "other",
)
TYPE_ALIASES = {
    "strike": "labor_strike", "labour_strike": "labor_strike", "labor_dispute": "labor_strike",
    "weather": "severe_weather", "storm": "severe_weather", "natural_disaster": "severe_weather",
    "congestion": "port_congestion", "closure": "port_closure",
    "blockage": "canal_or_strait_blockage", "canal_blockage": "canal_or_strait_blockage",
    "conflict": "conflict_or_attack", "attack": "conflict_or_attack", "geopolitical": "conflict_or_attack",
    "piracy": "conflict_or_attack", "sanctions": "sanctions_or_regulation", "regulation": "sanctions_or_regulation",
    "collision": "accident", "grounding": "accident", "fire": "accident",
    "outage": "infrastructure_failure", "cyberattack": "infrastructure_failure",
}
TYPE_RULES = (
    ("canal_or_strait_blockage", ("blocked", "blockage", "aground", "stuck in")),
    ("conflict_or_attack", ("attack", "missile", "houthi", "drone", "hijack", "seized")),
    ("labor_strike", ("workers strike", "on strike", "strike action", "walkout", "industrial action", "dockworkers", "union")),
    ("severe_weather", ("typhoon", "hurricane", "cyclone", "storm", "flood", "drought")),
    ("port_congestion", ("congestion", "backlog", "queue", "bottleneck")),
    ("port_closure", ("closed", "closure", "shut", "suspend")),
    ("accident", ("collision", "fire", "explosion", "capsiz", "sank", "grounding")),
    ("infrastructure_failure", ("cyber", "outage", "crane collapse", "bridge collapse")),
    ("sanctions_or_regulation", ("sanction", "embargo", "export ban", "tariff")),
)
PLACES = (
    ("suez canal", "EG", None), ("red sea", None, None), ("bab-el-mandeb", None, None), ("bab el-mandeb", None, None),
    ("strait of hormuz", None, None), ("hormuz", None, None), ("strait of malacca", None, None), ("panama canal", "PA", None),
    ("cape of good hope", "ZA", None), ("black sea", None, None), ("rotterdam", "NL", "NLRTM"), ("antwerp", "BE", "BEANR"),
    ("hamburg", "DE", "DEHAM"), ("felixstowe", "GB", "GBFXT"), ("dublin", "IE", "IEDUB"), ("cork", "IE", "IEORK"),
    ("nhava sheva", "IN", "INNSA"), ("jawaharlal nehru port", "IN", "INNSA"), ("mundra", "IN", "INMUN"),
    ("chennai", "IN", "INMAA"), ("colombo", "LK", "LKCMB"), ("singapore", "SG", "SGSIN"), ("shanghai", "CN", "CNSHA"),
    ("jebel ali", "AE", "AEJEA"), ("los angeles", "US", "USLAX"), ("long beach", "US", "USLGB"), ("baltimore", "US", "USBAL"),
    ("yemen", "YE", None), ("india", "IN", None), ("china", "CN", None), ("taiwan", "TW", None), ("iran", "IR", None),
    ("egypt", "EG", None),
)
SEVERITY_HINTS = ((5, ("global", "worldwide")), (4, ("weeks", "rerout", "suspend")), (3, ("days",)))
DEFAULT_SEVERITY = 2
RULE_CONFIDENCE = 0.5
NULL_WORDS = ("", "NULL", "NONE", "N/A", "UNKNOWN")
NULL_DATES = ("", "null", "none", "unknown")
YES = ("1", "y", "yes", "true")


@dataclass(frozen=True)
class Rules:
    """Ordered keyword rules. The first type, place and severity that match count."""

    types: tuple = TYPE_RULES
    places: tuple = PLACES
    severity: tuple = SEVERITY_HINTS


def _first_match(text: Column, ordered, value) -> Column:
    """CASE over the rules in order: value of the first one with a word contained in the text."""
    out = None
    for rule, words in ordered:
        hit = None
        for w in words:
            hit = text.contains(w) if hit is None else hit | text.contains(w)
        out = F.when(hit, value(rule)) if out is None else out.when(hit, value(rule))
    return out


def keyword_match(text: Column, rules: Rules | None = None) -> Column:
    """struct<event_type, location, country_code, port_code, severity>, NULL unless type and place are found.

    Substring tests on the whole text; no shuffle and no Python.
    """
    rules = rules or Rules()
    low = F.lower(text)
    kind = _first_match(low, rules.types, F.lit)
    place = _first_match(
        low, [((name, cc, port), (name,)) for name, cc, port in rules.places],
        lambda p: F.struct(F.lit(p[0].title()).alias("location"), F.lit(p[1]).cast("string").alias("country_code"),
                           F.lit(p[2]).cast("string").alias("port_code")),
    )
    severity = F.coalesce(_first_match(low, rules.severity, F.lit), F.lit(DEFAULT_SEVERITY))
    found = kind.isNotNull() & place.isNotNull()
    return F.when(found, F.struct(kind.alias("event_type"), place["location"].alias("location"),
                                  place["country_code"].alias("country_code"), place["port_code"].alias("port_code"),
                                  severity.alias("severity")))


def responder_text(title: Column, text: Column) -> Column:
    """What the keyword rules read: the title and the first line of the text."""
    return F.concat(title, F.lit("\n"), F.get(F.split(text, "\n", 2), F.lit(0)))


def event_id(news_id: Column, index: Column, model: Column, version: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", news_id, index.cast("string"), model, version)), 1, 16)


def _provenance(event: Column, index: Column, model: str, version: str) -> Column:
    """Event struct with the item's provenance, fields in stored order."""
    own = {
        "event_id": event_id(F.col("id"), index, F.lit(model), F.lit(version)), "news_id": F.col("id"), "source_url": F.col("url"),
        "source_name": F.col("source"), "published": F.col("published"), "model": F.lit(model), "prompt_version": F.lit(version),
    }
    names = [p.split()[0] for p in schemas.EVENT.split(", ")]
    return F.struct(*[(own[n] if n in own else event[n]).alias(n) for n in names])


def keyword_records(items: DataFrame, rules: Rules | None = None, model: str = "keyword-baseline", version: str = "extract_v1",
                    text: Column | None = None) -> DataFrame:
    """News items -> one extraction record each, with zero or one event."""
    read = text if text is not None else responder_text(F.col("title"), F.coalesce(F.nullif("summary", F.lit("")), "title"))
    m = F.col("m")
    event = F.struct(
        m["event_type"].alias("event_type"), m["location"].alias("location"), m["country_code"].alias("country_code"),
        m["port_code"].alias("port_code"), m["severity"].alias("severity"), F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"), F.array().cast("array<string>").alias("industries"), F.lit("").alias("summary"),
        F.lit(RULE_CONFIDENCE).alias("confidence"),
    )
    matched = items.withColumn("m", keyword_match(read, rules))
    full = _provenance(event, F.lit(0), model, version)
    return matched.select(
        F.col("id").alias("news_id"), F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), F.lit("ok").alias("status"),
        m.isNotNull().alias("is_disruption"),
        F.when(m.isNotNull(), F.array(full)).otherwise(F.array()).alias("events"), F.lit(None).cast("string").alias("error"),
    )


Replies = Callable[[list[dict]], list[str]]
"""A batch model in a task: item rows in, one reply text each out. It may raise, for a batch or for single items."""
EXTRACT_BATCH = 256
"""Items that a batch model is given at a time."""


def _answers(model: Replies, rows: list[dict]) -> list[tuple[str | None, str | None]]:
    """(reply, error) of every row. When a batch fails, its items are tried one by one, so that only bad ones fail."""
    try:
        replies = model(rows)
        if len(replies) != len(rows):
            raise ValueError(f"{len(replies)} replies to {len(rows)} items")
        bad = [i for i, r in enumerate(replies) if not isinstance(r, str)]
        return [(None, f"reply is {type(r).__name__}, not text") if i in bad else (r, None) for i, r in enumerate(replies)]
    except Exception as error:  # noqa: BLE001 - whatever a model raises becomes a failed record
        if len(rows) > 1:
            return [x for row in rows for x in _answers(model, [row])]
        return [(None, f"{type(error).__name__}: {error}")]


def batch_records(items: DataFrame, load: Callable[[], Replies], model: str, version: str) -> DataFrame:
    """News items -> extraction records by any batch model.

    ``load`` runs once per task (that is where a model is read), and what it returns gets lists of item rows as
    dictionaries. Its replies are JSON texts and go through the same checks as stored ones (``reply_records``). What the
    model raises, or replies that are no text, give failed records with the error; other items of the batch do not
    suffer, and a failing ``load`` fails the task, since no item could be read.
    """
    fields = [f.name for f in items.schema]

    def answer(batches):
        extract = None
        for batch in batches:
            extract = extract or load()
            for a in range(0, batch.num_rows, EXTRACT_BATCH):
                part = batch.slice(a, EXTRACT_BATCH)
                replies, errors = zip(*_answers(extract, part.to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*fields, "reply", "raised"])

    answered = items.mapInArrow(answer, StructType([*items.schema.fields, StructField("reply", StringType()), StructField("raised", StringType())]))
    return reply_records(answered, model, version, error=F.col("raised"))


def run_extraction(items: DataFrame, extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Apply any extractor ``items -> records``: the keyword rules by default, ``batch_records`` with a model otherwise.

    The result has the columns and types of stored records; an extractor that gives others is refused.
    """
    records = (extractor or keyword_records)(items)
    want = items.sparkSession.createDataFrame([], schemas.RECORD).schema
    wrong = [f.name for f in want if f.name not in records.columns or records.schema[f.name].dataType.simpleString() != f.dataType.simpleString()]
    if wrong:
        raise TypeError(f"the extractor does not give record columns: {', '.join(wrong)}")
    return records.select(*want.names)


# --- normalization and checks of model replies ------------------------------------------------------


def type_key(value: Column) -> Column:
    return F.translate(F.lower(tx.strip(value)), " -", "__")


def type_of_key(key: Column, raw: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    return F.when(key.isin(*EVENT_TYPES), key).otherwise(F.coalesce(aliases[key], raw))


def normal_type(value: Column) -> Column:
    return type_of_key(type_key(value), value)


def normal_code(value: Column) -> Column:
    up = F.upper(tx.strip(value))
    return F.when(~up.isin(*NULL_WORDS), up)


def normal_port(value: Column) -> Column:
    return F.replace(normal_code(value), F.lit(" "), F.lit(""))


def valid_country(code: Column) -> Column:
    return code.isNull() | code.rlike(r"^\p{L}{2}$")


def valid_port(code: Column) -> Column:
    return code.isNull() | code.rlike(r"^[\p{L}\p{N}]{5}$")


def blank_date(value: Column) -> Column:
    """Text of a date, NULL for blanks and the usual words for nothing."""
    return F.when(~F.lower(tx.strip(value)).isin(*NULL_DATES), value)


def normal_industries(values: Column) -> Column:
    words = F.filter(F.transform(values, lambda v: F.lower(tx.strip(v))), lambda v: v != "")
    return F.array_sort(F.array_distinct(words))


def outermost_json(reply: Column) -> Column:
    """The JSON object in a reply: code fences dropped, else the span from the first { to the last }."""
    bare = tx.strip(F.regexp_replace(reply, "```(?:json)?", ""))
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def checked_events(events: Column) -> Column:
    """array<event> -> normalized events with ``valid``: every field within its range and format.

    Three passes over the short list, each building on the fields of the one before, so that no
    normalization is evaluated more than once per event.
    """

    def trimmed(e: Column) -> Column:
        return F.struct(
            type_key(e["event_type"]).alias("key"), e["event_type"].alias("raw"), e["location"].alias("location"),
            F.upper(tx.strip(e["country_code"])).alias("country"), F.upper(tx.strip(e["port_code"])).alias("port"),
            e["severity"].try_cast("int").alias("severity"), blank_date(e["start_date"]).alias("start"), blank_date(e["end_date"]).alias("end"),
            normal_industries(F.coalesce(e["industries"], F.array().cast("array<string>"))).alias("industries"),
            F.coalesce(e["summary"], F.lit("")).alias("summary"), e["confidence"].try_cast("double").alias("confidence"),
        )

    def named(t: Column) -> Column:
        return F.struct(
            type_of_key(t["key"], t["raw"]).alias("event_type"), t["location"].alias("location"),
            F.when(~t["country"].isin(*NULL_WORDS), t["country"]).alias("country_code"),
            F.when(~t["port"].isin(*NULL_WORDS), F.replace(t["port"], F.lit(" "), F.lit(""))).alias("port_code"), t["severity"].alias("severity"),
            t["start"].try_cast("date").alias("start_date"), t["end"].try_cast("date").alias("end_date"), t["industries"].alias("industries"),
            t["summary"].alias("summary"), t["confidence"].alias("confidence"),
            t["start"].alias("start_text"), t["end"].alias("end_text"),
        )

    def judged(n: Column) -> Column:
        valid = (
            n["event_type"].isin(*EVENT_TYPES) & (F.length(F.coalesce(n["location"], F.lit(""))) > 0)
            & valid_country(n["country_code"]) & valid_port(n["port_code"])
            & n["severity"].between(1, 5) & n["confidence"].between(0.0, 1.0)
            & (n["start_text"].isNull() | n["start_date"].isNotNull()) & (n["end_text"].isNull() | n["end_date"].isNotNull())
        )
        kept = ("event_type", "location", "country_code", "port_code", "severity", "start_date", "end_date", "industries", "summary", "confidence")
        return F.struct(*[n[c].alias(c) for c in kept], F.coalesce(valid, F.lit(False)).alias("valid"))

    return F.transform(F.transform(F.transform(events, trimmed), named), judged)


def reply_records(items: DataFrame, model: str, version: str, error: Column | None = None) -> DataFrame:
    """Items with a ``reply`` column -> records. One bad event or no JSON at all makes a failed record;
    a false flag drops listed events. ``error`` is why an item has no reply, if it is known."""
    parsed = items.withColumn("r", F.from_json(outermost_json(F.col("reply")), schemas.REPLY))
    checked = parsed.withColumn(
        "checked", checked_events(F.coalesce(F.col("r.events"), F.array().cast(f"array<{schemas.REPLY_EVENT}>")))
    )
    flag, ok = F.col("r.is_disruption"), F.col("ok")
    judged = checked.withColumn("ok", flag.isNotNull() & F.forall("checked", lambda e: e["valid"]))
    # A false flag or a failed record keeps none of the listed events.
    kept = F.transform(F.when(ok & flag, F.col("checked")).otherwise(F.slice("checked", 1, 0)), lambda e, i: _provenance(e, i, model, version))
    return judged.select(
        F.col("id").alias("news_id"), F.lit(model).alias("model"), F.lit(version).alias("prompt_version"),
        F.when(ok, "ok").otherwise("failed").alias("status"), F.coalesce(ok & flag, F.lit(False)).alias("is_disruption"),
        kept.alias("events"),
        F.when(~ok, F.coalesce(error if error is not None else F.lit(None), F.when(flag.isNull(), "no valid JSON object").otherwise("event outside the schema"))).alias("error"),
    )


def flat_events(records: DataFrame) -> DataFrame:
    """Events of the successful records, one row each."""
    return records.filter("status = 'ok'").select(F.inline("events"))


def summarize(records: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    failed = F.count_if(~ok)
    n = F.count(F.lit(1))
    return records.agg(
        n.alias("items"), F.count_if(ok).alias("ok"), failed.alias("failed"),
        stable_round(failed / F.greatest(n, F.lit(1)), 3).alias("failure_rate"),
        F.count_if(ok & F.col("is_disruption")).alias("flagged_disruption"),
        F.coalesce(F.sum(F.when(ok, F.size("events"))), F.lit(0)).cast("bigint").alias("events"),
    )


# --- prompts ----------------------------------------------------------------------------------------


def render(template: str, values: dict[str, Column]) -> Column:
    """Template text with every known ``{name}`` replaced; other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def prompts(items: DataFrame, template: str) -> DataFrame:
    """id, prompt: the text a batch model reads for each item."""
    text = F.substring(F.coalesce(F.nullif("summary", F.lit("")), "title"), 1, tx.PROMPT_TEXT_MAX_CHARS)
    values = {
        "event_types": F.lit(", ".join(f'"{t}"' for t in EVENT_TYPES)), "published": F.date_format("published", "yyyy-MM-dd"),
        "title": F.col("title"), "source": F.col("source"), "text": text,
    }
    return items.select("id", render(template, values).alias("prompt"))
