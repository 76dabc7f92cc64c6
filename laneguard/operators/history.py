"""Point-in-time order features: calendar, label timing, history rates without leakage, purged split."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laneguard.functions.numeric import smoothed_rate
from laneguard.operators.store import ntz
from laneguard.session import materialize

# Fixed feature groups.
CATEGORICAL = ("shipping_mode", "market", "order_region", "order_country", "customer_segment", "category", "department", "payment_type")
NUMERIC = ("days_scheduled", "quantity", "unit_price", "discount_rate", "sales", "order_hour", "order_dow", "order_month")
HISTORY_KEYS = {"hist_mode_region": ("shipping_mode", "order_region"), "hist_country": ("order_country",), "hist_mode": ("shipping_mode",)}
HISTORY = tuple(f"{name}_{stat}" for name in HISTORY_KEYS for stat in ("rate", "n"))
FEATURES = (*CATEGORICAL, *NUMERIC, *HISTORY)
TARGET = "late"
LEAKY = ("days_real", "late", "label_known_at", "delivery_status", "shipping_date", "order_status")
NEUTRAL_PRIOR = 0.5


def calendar(orders: DataFrame) -> DataFrame:
    """order_hour, order_dow (Monday = 0), order_month."""
    return (
        orders.withColumn("order_hour", F.hour("order_date"))
        .withColumn("order_dow", F.weekday("order_date"))
        .withColumn("order_month", F.month("order_date"))
    )


def with_label_time(orders: DataFrame) -> DataFrame:
    """label_known_at: the moment the outcome becomes known."""
    return orders.withColumn("label_known_at", F.col("order_date") + F.make_dt_interval(F.col("days_real")))


def prepare(orders: DataFrame) -> DataFrame:
    return with_label_time(calendar(orders))


def features_only(orders: DataFrame) -> DataFrame:
    """Only the allowed columns; anything that reveals the outcome cannot get through."""
    leaks = set(FEATURES) & set(LEAKY)
    if leaks:
        raise ValueError(f"outcome columns among the features: {sorted(leaks)}")
    return orders.select(*FEATURES)


def global_prior(orders: DataFrame, until: dt.datetime | None) -> float:
    """Late share of the labels known before ``until``; 0.5 without any."""
    if until is None:
        return NEUTRAL_PRIOR
    seen = orders.agg(F.avg(F.when(F.col("label_known_at") < ntz(until), F.col(TARGET)))).first()[0]
    return NEUTRAL_PRIOR if seen is None else float(seen)


def _key(columns) -> Column:
    """Key columns as one value; nulls are a value of their own."""
    return F.array(*[F.col(c).cast("string") for c in columns])


def running_history(orders: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """name, key, order_date, cum_late, cum_n: for every key set (``name``), each of its keys and every order date of that
    key, the labels known strictly before.

    Labels and questions are counted per key and instant, set by set, over the few columns in use and combined map-side.
    One narrow table of all sets is cut into ranges of (name, key, instant) and summed up inside each range; what the
    earlier ranges of a key hold is added from one row per range. A key with most of the orders is many ranges, so no
    window grows with the number of orders.
    """
    late, zero = F.col(TARGET).cast("bigint"), F.lit(0).cast("bigint")
    place = ["name", "key", "at", "fact"]  # a question sorts before the labels of the same instant, so equal instants do not count

    def marks(name: str, ks: tuple[str, ...]) -> list[DataFrame]:
        facts = orders.groupBy(*ks, F.col("label_known_at").alias("at")).agg(F.sum(late).alias("late"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("fact"))
        asked = orders.select(*ks, F.col("order_date").alias("at")).distinct().select(*ks, "at", zero.alias("late"), zero.alias("n"), F.lit(0).alias("fact"))
        return [x.select(F.lit(name).alias("name"), _key(ks).alias("key"), "at", "fact", "late", "n") for x in (facts, asked)]

    counted = reduce(DataFrame.unionAll, [x for name, ks in sets.items() for x in marks(name, ks)])
    parts = materialize(counted.repartitionByRange(*place).withColumn("part", F.spark_partition_id()), "history-marks")
    totals = parts.groupBy("name", "key", "part").agg(F.sum("late").alias("late"), F.sum("n").alias("n"))
    earlier = W.partitionBy("name", "key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    before = totals.select("name", "key", "part", F.sum("late").over(earlier).alias("b_late"), F.sum("n").over(earlier).alias("b_n")).filter("b_n > 0")
    so_far = W.partitionBy("name", "key", "part").orderBy("at", "fact").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = parts.select(*place, "part", F.sum("late").over(so_far).alias("late"), F.sum("n").over(so_far).alias("n")).filter("fact = 0")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), zero)
    return within.join(before, ["name", "key", "part"], "left").select(
        "name", "key", F.col("at").alias("order_date"), plus("late", "b_late").alias("cum_late"), plus("n", "b_n").alias("cum_n"))


def _typed(orders: DataFrame, keys: tuple[str, ...]) -> list[Column]:
    """The columns of a ``key`` with the names and types that they have in ``orders``."""
    types = {f.name: f.dataType for f in orders.schema}
    return [F.get("key", F.lit(i)).cast(types[k]).alias(k) for i, k in enumerate(keys)]


def known_before(orders: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, order_date) -> cum_late, cum_n over labels known strictly before that instant."""
    return running_history(orders, {"": keys}).select(*_typed(orders, keys), "order_date", "cum_late", "cum_n")


def _join_moments(rows: DataFrame, moments: DataFrame, keys: list[str], added: list[str]) -> DataFrame:
    """``rows`` + the columns ``added`` of the row of ``moments`` with the same keys (nulls are a value) and order date.

    ``moments`` grow with the orders although they are few bytes on disk: they are never broadcast.
    """
    right = moments.select(*[F.col(k).alias(f"__{k}") for k in (*keys, "order_date")], *added).hint("merge")
    same = F.col("order_date") == F.col("__order_date")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(right, same).select(*rows.columns, *added)


def add_history(orders: DataFrame, prior: float, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """orders + one smoothed late rate and one count per key set.

    The histories come together in one narrow row per combination of keys and order date; the wide orders are joined
    with these once.
    """
    sets = names or HISTORY_KEYS
    every = list(dict.fromkeys(k for ks in sets.values() for k in ks))
    known = running_history(orders, sets)
    moments = orders.select(*every, "order_date").distinct()
    for name, ks in sets.items():
        rate = smoothed_rate(F.col("cum_late"), F.col("cum_n"), F.lit(prior)).alias(f"{name}_rate")
        own = known.filter(F.col("name") == name).select(*_typed(orders, ks), "order_date", rate, F.col("cum_n").cast("double").alias(f"{name}_n"))
        moments = _join_moments(moments, own, list(ks), [f"{name}_rate", f"{name}_n"])
    return _join_moments(orders, moments, every, [f"{name}_{stat}" for name in sets for stat in ("rate", "n")])


def split_column(valid_start: dt.datetime, test_start: dt.datetime) -> Column:
    """train / valid / test; NULL = purged, because the label was not known before the next period."""
    order, known = F.col("order_date"), F.col("label_known_at")
    vs, ts = ntz(valid_start), ntz(test_start)
    return (
        F.when((order < vs) & (known < vs), "train")
        .when((order >= vs) & (order < ts) & (known < ts), "valid")
        .when(order >= ts, "test")
    )


def build_dataset(orders: DataFrame, valid_start: dt.datetime, test_start: dt.datetime) -> DataFrame:
    """Prepared orders + history + ``split``, purged rows dropped."""
    prior = global_prior(orders, valid_start)
    return add_history(orders, prior).withColumn("split", split_column(valid_start, test_start)).filter("split IS NOT NULL")


def split_summary(data: DataFrame) -> DataFrame:
    return data.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.to_date(F.min("order_date")).alias("min_date"), F.to_date(F.max("order_date")).alias("max_date")
    )


CELL = 3600
"""Seconds of the finest time cell of the audit."""
CELL_LEVELS = 32


def history_by_cells(orders: DataFrame, keys: tuple[str, ...], until: dt.datetime | None = None) -> DataFrame:
    """key, order_date, late, n: the same counts as ``known_before`` by an interval join, without any running sum.

    Time is cut into cells of an hour, of two hours, of four and so on. All cells before an instant are at most one of
    each size (those of the ones in its binary number), so every question joins a few cell sums by equality; inside its
    own finest cell labels are compared one by one (labels of equal instants are one row). Labels known at or after
    ``until`` are never read, and only orders up to then are asked.
    """
    key, late = _key(keys), F.col(TARGET).cast("bigint")
    cell = lambda at: F.floor((F.unix_micros(F.col(at).cast("timestamp")) / 1000000 + 2.0 ** 40) / CELL).cast("bigint")
    past = (lambda c: F.col(c) < ntz(until)) if until is not None else (lambda c: F.lit(True))
    facts = orders.filter(past("label_known_at")).groupBy(key.alias("key"), F.col("label_known_at").alias("at")).agg(F.sum(late).alias("late"), F.count(F.lit(1)).alias("n"))
    facts = materialize(facts.withColumn("cell", cell("at")), "audit-labels")
    asked = orders.filter(F.col("order_date") <= ntz(until)) if until is not None else orders
    asked = materialize(asked.select(key.alias("key"), "order_date").distinct().withColumn("cell", cell("order_date")), "audit-questions")
    levels = F.sequence(F.lit(0), F.lit(CELL_LEVELS - 1))
    sums = facts.select("key", "late", "n", F.explode(F.transform(levels, lambda i: F.struct(i.alias("level"), F.call_function("shiftright", F.col("cell"), i).alias("c")))).alias("p"))
    sums = sums.groupBy("key", "p").agg(F.sum("late").alias("late"), F.sum("n").alias("n"))
    bit = lambda i: F.call_function("shiftright", F.col("cell"), i)
    needs = F.transform(F.filter(levels, lambda i: bit(i) % 2 == 1), lambda i: F.struct(i.alias("level"), (bit(i) - 1).alias("c")))
    # labels and sums grow with the orders although they are few bytes on disk: never broadcast
    whole = asked.select("key", "order_date", F.explode(needs).alias("p")).join(sums.hint("merge"), ["key", "p"]).select("key", "order_date", "late", "n")
    inner = asked.join(facts.hint("merge"), ["key", "cell"]).filter("at < order_date").select("key", "order_date", "late", "n")
    none = asked.select("key", "order_date", F.lit(0).cast("bigint").alias("late"), F.lit(0).cast("bigint").alias("n"))
    return whole.unionAll(inner).unionAll(none).groupBy("key", "order_date").agg(F.sum("late").alias("late"), F.sum("n").alias("n"))


def audit_truth(orders: DataFrame, cut: dt.datetime, names: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """Per key set the stored counts of ``history_by_cells`` before ``cut``, for any number of audits of the same orders."""
    return {name: materialize(history_by_cells(orders, keys, cut), f"audit-{name}") for name, keys in (names or HISTORY_KEYS).items()}


def leakage_audit(featured: DataFrame, orders: DataFrame, cut: dt.datetime, prior: float, names: dict[str, tuple[str, ...]] | None = None,
                  truth: dict[str, DataFrame] | None = None) -> DataFrame:
    """name, n_checked, n_changed per key set: rows of ``featured`` up to ``cut`` whose history is not what the labels
    known before each order, and before ``cut``, give.

    ``featured`` has the order columns and the history to be audited; the truth (``audit_truth``) is recomputed from
    ``orders`` in another way (``history_by_cells``) that cannot see later labels. Any feature that uses the future
    differs. Rows of equal key, instant and history are judged once and counted.
    """
    out = []
    known = truth or audit_truth(orders, cut, names)
    for name, keys in (names or HISTORY_KEYS).items():
        rows = featured.filter(F.col("order_date") <= ntz(cut)).groupBy(_key(keys).alias("key"), "order_date", F.col(f"{name}_rate").alias("rate"), F.col(f"{name}_n").alias("m")).agg(F.count(F.lit(1)).alias("rows"))
        both = rows.join(known[name].hint("merge"), ["key", "order_date"], "left")
        wrong = (F.col("m") != F.col("n")) | (F.abs(F.col("rate") - smoothed_rate(F.col("late"), F.col("n"), F.lit(prior))) > 1e-9)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        out.append(both.agg(F.lit(name).alias("name"), total(F.col("rows")).alias("n_checked"), total(F.when(F.coalesce(wrong, F.lit(True)), F.col("rows"))).alias("n_changed")))
    return reduce(DataFrame.unionAll, out)
