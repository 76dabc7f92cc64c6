"""Order history, point-in-time features, model and run-result queries."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laneguard.functions.numeric import clip_probability, sigmoid, stable_round
from laneguard.operators import extraction, forecast, history, replay, store
from laneguard.plans.domain import ROW_KEY, SPEC, TEST_START, VALID_START, Domain
from laneguard.plans.registry import query
from laneguard.plans.sql_views import rnd, view
from laneguard.session import scratch_path
from laneguard.sources import days, reference, results
from laneguard.sources import orders as order_files

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
view("lines", (), """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate + to_hours(o_orderkey % 24) AS order_date, l_linenumber AS days_real,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS days_scheduled, CAST(l_linenumber > CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS late,
  o_orderpriority AS shipping_mode, r_name AS market, r_name AS order_region, n_name AS order_country, c_mktsegment AS customer_segment, l_returnflag AS category,
  l_linestatus AS department, o_orderstatus AS payment_type, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_discount AS discount_rate,
  l_extendedprice AS sales, o_orderdate + to_hours(o_orderkey % 24) + to_days(l_linenumber) AS label_known_at,
  CAST(hour(o_orderdate + to_hours(o_orderkey % 24)) AS INTEGER) AS order_hour, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS order_dow, CAST(month(o_orderdate) AS INTEGER) AS order_month
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
view("prior", ("lines",), "SELECT coalesce(avg(late), 0.5::DOUBLE) AS g FROM lines WHERE label_known_at < TIMESTAMP '1999-01-01'")


def asof(name: str, keys: str) -> None:
    cols = keys.split(", ")
    on = " AND ".join(f"p.{c} = f.{c}" for c in cols)
    view(f"{name}_facts", ("lines",), f"""
SELECT DISTINCT {keys}, label_known_at, sum(late) OVER w AS cum_late, count(*) OVER w AS cum_n FROM lines
WINDOW w AS (PARTITION BY {keys} ORDER BY label_known_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
    view(name, (f"{name}_facts", "lines"), f"""
SELECT {', '.join('p.' + c for c in cols)}, p.order_date, coalesce(CAST(cum_late AS BIGINT), 0) AS cum_late, coalesce(cum_n, 0) AS cum_n
FROM (SELECT DISTINCT {keys}, order_date FROM lines) p ASOF LEFT JOIN {name}_facts f ON {on} AND p.order_date > f.label_known_at""")


asof("h_mode_region", "shipping_mode, order_region")
asof("h_country", "order_country")
asof("h_mode", "shipping_mode")


def rate(a: str) -> str:
    return f"({a}.cum_late + g * 20.0::DOUBLE) / ({a}.cum_n + 20.0::DOUBLE)"


view("data", ("lines", "prior", "h_mode_region", "h_country", "h_mode"), f"""
SELECT lines.*, {rate('a')} AS hist_mode_region_rate, CAST(a.cum_n AS DOUBLE) AS hist_mode_region_n, {rate('b')} AS hist_country_rate, CAST(b.cum_n AS DOUBLE) AS hist_country_n,
  {rate('c')} AS hist_mode_rate, CAST(c.cum_n AS DOUBLE) AS hist_mode_n,
  CASE WHEN lines.order_date < TIMESTAMP '1999-01-01' AND label_known_at < TIMESTAMP '1999-01-01' THEN 'train'
       WHEN lines.order_date >= TIMESTAMP '1999-01-01' AND lines.order_date < TIMESTAMP '2000-01-01' AND label_known_at < TIMESTAMP '2000-01-01' THEN 'valid'
       WHEN lines.order_date >= TIMESTAMP '2000-01-01' THEN 'test' END AS split
FROM lines, prior, h_mode_region a, h_country b, h_mode c
WHERE a.shipping_mode = lines.shipping_mode AND a.order_region = lines.order_region AND a.order_date = lines.order_date
  AND b.order_country = lines.order_country AND b.order_date = lines.order_date AND c.shipping_mode = lines.shipping_mode AND c.order_date = lines.order_date""")


@query("b26_calendar", f"SELECT {KEY}, order_hour, order_dow, order_month FROM lines", ["lines"])
def calendar(d: Domain) -> DataFrame:
    return d.order_lines.select(*ROW_KEY, "order_hour", "order_dow", "order_month")


@query("b27_label_time", f"SELECT {KEY}, order_date, label_known_at FROM lines", ["lines"])
def label_time(d: Domain) -> DataFrame:
    return d.order_lines.select(*ROW_KEY, "order_date", "label_known_at")


@query("b28_purged_split", f"SELECT {KEY}, split FROM data WHERE split IS NOT NULL", ["data"])
def purged_split(d: Domain) -> DataFrame:
    return d.order_lines.select(*ROW_KEY, history.split_column(VALID_START, TEST_START).alias("split")).filter("split IS NOT NULL")


@query("b29_feature_list", f"SELECT shipping_mode, order_region, count(*) AS n, max(sales) AS top_sales, {rnd('max(hist_country_rate)', 6)} AS top_rate FROM data WHERE split IS NOT NULL GROUP BY 1, 2", ["data"])
def feature_list(d: Domain) -> DataFrame:
    x = history.features_only(d.featured)
    return x.groupBy("shipping_mode", "order_region").agg(
        F.count(F.lit(1)).alias("n"), F.max("sales").alias("top_sales"), stable_round(F.max("hist_country_rate"), 6).alias("top_rate")
    )


HIST_OUT = ", ".join(f"{rnd(c, 6)} AS {c}" if c.endswith("rate") else c for c in history.HISTORY)


@query("c11_pit_history", f"SELECT {KEY}, {HIST_OUT} FROM data", ["data"])
def pit_history(d: Domain) -> DataFrame:
    prior = history.global_prior(d.orders, VALID_START)
    out = history.add_history(d.orders, prior)
    return out.select(*ROW_KEY, *[(stable_round(F.col(c), 6) if c.endswith("rate") else F.col(c)).alias(c) for c in history.HISTORY])


@query("j01_dataset", f"SELECT {KEY}, split, order_dow, {HIST_OUT} FROM data WHERE split IS NOT NULL", ["data"])
def dataset(d: Domain) -> DataFrame:
    return d.featured.select(*ROW_KEY, "split", "order_dow", *[(stable_round(F.col(c), 6) if c.endswith("rate") else F.col(c)).alias(c) for c in history.HISTORY])


@query("e03_cumulative_late", "SELECT shipping_mode, order_date, cum_late, cum_n FROM h_mode", ["h_mode"])
def cumulative_late(d: Domain) -> DataFrame:
    return history.known_before(d.order_lines, ("shipping_mode",))


@query("d15_global_prior", f"SELECT {rnd('g', 6)} AS prior, (SELECT count(*) FROM lines WHERE label_known_at < TIMESTAMP '1999-01-01') AS n FROM prior", ["prior", "lines"])
def global_prior(d: Domain) -> DataFrame:
    seen = F.col("label_known_at") < store.ntz(VALID_START)
    return d.order_lines.agg(stable_round(F.coalesce(F.avg(F.when(seen, F.col("late"))), F.lit(history.NEUTRAL_PRIOR)), 6).alias("prior"), F.count_if(seen).alias("n"))


@query("d19_split_summary", "SELECT split, count(*) AS n_rows, CAST(min(order_date) AS DATE) AS min_date, CAST(max(order_date) AS DATE) AS max_date FROM data WHERE split IS NOT NULL GROUP BY 1", ["data"])
def split_summary(d: Domain) -> DataFrame:
    split = d.order_lines.withColumn("split", history.split_column(VALID_START, TEST_START))
    return history.split_summary(split.filter("split IS NOT NULL"))


@query("d22_late_rate", f"SELECT shipping_mode, {rnd('avg(late)', 4)} AS late_rate, count(*) AS n FROM lines GROUP BY 1", ["lines"])
def late_rate(d: Domain) -> DataFrame:
    return d.order_lines.groupBy("shipping_mode").agg(stable_round(F.avg("late"), 4).alias("late_rate"), F.count(F.lit(1)).alias("n"))


@query("f09_order_sort", f"SELECT {KEY}, order_date FROM lines ORDER BY order_date, {KEY}", ["lines"])
def order_sort(d: Domain) -> DataFrame:
    return d.order_lines.select(*ROW_KEY, "order_date").orderBy("order_date", *ROW_KEY)


@query("f08_extreme_rows", f"""
WITH s AS (SELECT *, {rnd('hist_mode_rate', 6)} AS r FROM data WHERE split = 'test')
SELECT 'highest' AS which, {KEY}, r AS p FROM (SELECT * FROM s ORDER BY r DESC, {KEY} LIMIT 1)
UNION ALL SELECT 'lowest', {KEY}, r FROM (SELECT * FROM s ORDER BY r, {KEY} LIMIT 1)""", ["data"])
def extreme_rows(d: Domain) -> DataFrame:
    p = stable_round(F.col("hist_mode_rate"), 6)
    row = F.struct(*ROW_KEY, p.alias("p"))
    low = F.min_by(row, F.struct(p, *ROW_KEY))
    high = F.min_by(row, F.struct(-p, *ROW_KEY))
    one = d.featured.filter("split = 'test'").agg(high.alias("h"), low.alias("l"))
    both = F.array(F.struct(F.lit("highest").alias("which"), F.col("h").alias("r")), F.struct(F.lit("lowest").alias("which"), F.col("l").alias("r")))
    return one.select(F.inline(both)).select("which", "r.*")


# --- metrics --------------------------------------------------------------------------------------

view("majority", ("data",), "SELECT 'majority' AS model, split, late AS y, (SELECT avg(late) FROM data WHERE split = 'train') AS p FROM data WHERE split IN ('valid', 'test')")
view("mode_rule", ("data",), "SELECT 'mode_history' AS model, split, late AS y, hist_mode_rate AS p FROM data WHERE split IN ('valid', 'test')")


def counts_view(name: str, source: str) -> None:
    view(name, (source,), f"""
SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM (
  SELECT model, split, greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE) AS p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY model, split ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


counts_view("majority_counts", "majority")
counts_view("mode_counts", "mode_rule")


def metrics_sql(counts: str) -> str:
    return f"""SELECT model, split,
  {rnd("CASE WHEN max(p) - min(p) <= min(p) * 1e-5 + 1e-8 THEN 0.5::DOUBLE ELSE sum(neg::DOUBLE * (cum_pos::DOUBLE - pos) + pos::DOUBLE * neg * 0.5) / (sum(pos)::DOUBLE * sum(neg)) END", 4)} AS roc_auc,
  {rnd('sum(pos::DOUBLE * cum_pos / (cum_pos + cum_neg)::DOUBLE) / sum(pos)', 4)} AS pr_auc,
  {rnd('sum(pos * (p - 1) * (p - 1) + neg * p * p) / sum(pos + neg)', 4)} AS brier, {rnd('sum(-pos * ln(p) - neg * ln(1.0::DOUBLE - p)) / sum(pos + neg)', 4)} AS log_loss,
  {rnd('sum(CASE WHEN p >= 0.5 THEN pos ELSE neg END)::DOUBLE / sum(pos + neg)', 4)} AS accuracy, CAST(sum(pos + neg) AS BIGINT) AS n, {rnd('sum(pos)::DOUBLE / sum(pos + neg)', 4)} AS positive_rate
FROM {counts} GROUP BY model, split"""


@query("e10_rank_counts", f"SELECT model, split, {rnd('p', 9)} AS p, pos, neg, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_neg AS BIGINT) AS cum_neg FROM mode_counts", ["mode_counts"])
def rank_counts(d: Domain) -> DataFrame:
    return forecast.score_counts(forecast.mode_history_scores(d.featured)).withColumn("p", stable_round(F.col("p"), 9))


@query("j02_majority", metrics_sql("majority_counts"), ["majority_counts"])
def majority(d: Domain) -> DataFrame:
    return forecast.metrics(forecast.majority_scores(d.split_lines))


@query("j03_mode_rule", metrics_sql("mode_counts"), ["mode_counts"])
def mode_rule(d: Domain) -> DataFrame:
    return forecast.metrics(forecast.mode_history_scores(d.featured))


@query("d13_model_metrics", metrics_sql("majority_counts") + " UNION ALL " + metrics_sql("mode_counts"), ["majority_counts", "mode_counts"])
def model_metrics(d: Domain) -> DataFrame:
    return forecast.metrics(forecast.majority_scores(d.split_lines).unionByName(forecast.mode_history_scores(d.featured)))


@query("b34_probability", f"""
SELECT {KEY}, {rnd('1.0::DOUBLE / (1.0::DOUBLE + exp(-(quantity / 10.0::DOUBLE - 2.5::DOUBLE)))', 6)} AS p, greatest(least(discount_rate * 20.0::DOUBLE, 0.999999::DOUBLE), 0.000001::DOUBLE) AS clipped FROM lines""", ["lines"])
def probabilities(d: Domain) -> DataFrame:
    return d.order_lines.select(*ROW_KEY, stable_round(sigmoid(F.col("quantity") / 10.0 - 2.5), 6).alias("p"), clip_probability(F.col("discount_rate") * 20.0).alias("clipped"))


# --- snapshot and what-if -------------------------------------------------------------------------

view("train", ("data",), "SELECT * FROM data WHERE split = 'train'")
CAT = history.CATEGORICAL
view("typical", ("train",), " UNION ALL ".join(
    f"SELECT '{c}' AS name, arg_min({c}, (-n, {c})) AS value, max(n) AS n FROM (SELECT {c}, count(*) AS n FROM train GROUP BY 1)" for c in CAT))
view("middles", ("train",), " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(median({c}) AS DOUBLE) AS value FROM train" for c in history.NUMERIC))
view("final_hist", ("train",), " UNION ALL ".join(
    f"SELECT '{n}' AS name, concat_ws('|', {', '.join(k)}) AS key, (sum(late) + s * 20.0::DOUBLE) / (count(*) + 20.0::DOUBLE) AS rate, CAST(count(*) AS DOUBLE) AS n FROM train, (SELECT avg(late) AS s FROM train) GROUP BY ALL, s".replace("GROUP BY ALL, s", f"GROUP BY {', '.join(k)}, s")
    for n, k in history.HISTORY_KEYS.items()))


@query("d14_modes", "SELECT name, value, n FROM typical", ["typical"])
def modes(d: Domain) -> DataFrame:
    return forecast.modes(d.train_lines)


@query("d14_medians", f"SELECT name, {rnd('value', 6)} AS value FROM middles", ["middles"])
def medians(d: Domain) -> DataFrame:
    return forecast.medians(d.train_lines).select("name", stable_round(F.col("value"), 6).alias("value"))


@query("d14_final_history", f"SELECT name, key, {rnd('rate', 6)} AS rate, n FROM final_hist", ["final_hist"])
def final_history(d: Domain) -> DataFrame:
    return forecast.final_history(d.train_lines, d.train_share).withColumn("rate", stable_round(F.col("rate"), 6))


view("regions", ("train",), "SELECT order_country, arg_min(order_region, (-n, order_region)) AS order_region FROM (SELECT order_country, order_region, count(*) AS n FROM train GROUP BY 1, 2) GROUP BY 1")


@query("d14_country_regions", "SELECT order_country, order_region FROM regions", ["regions"])
def country_regions(d: Domain) -> DataFrame:
    return forecast.country_regions(d.train_lines)


view("what_if", ("lanes", "nodes", "regions", "typical", "middles", "final_hist", "train"), """
SELECT lane_id, mode AS shipping_mode, CAST(days AS DOUBLE) AS days_scheduled,
  CASE WHEN r.order_region IS NULL THEN (SELECT value FROM typical WHERE name = 'order_country') ELSE nodes.name END AS order_country,
  coalesce(r.order_region, (SELECT value FROM typical WHERE name = 'order_region')) AS order_region
FROM lanes JOIN nodes ON node_id = destination LEFT JOIN regions r ON r.order_country = nodes.name,
  (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('5-LOW', 5), ('9-NEVER', 4)) m(mode, days)""")


@query("c16_lane_country", """
SELECT lane_id, nodes.name AS order_country, r.order_region FROM lanes JOIN nodes ON node_id = destination LEFT JOIN regions r ON r.order_country = nodes.name""", ["lanes", "nodes", "regions"])
def lane_country(d: Domain) -> DataFrame:
    return d.lane_countries.join(forecast.country_regions(d.train_lines), "order_country", "left").select("lane_id", "order_country", "order_region")


@query("c15_history_lookup", f"""
SELECT lane_id, shipping_mode, {rnd('coalesce(m.rate, (SELECT avg(late) FROM train))', 6)} AS hist_mode_rate, coalesce(m.n, 0.0::DOUBLE) AS hist_mode_n
FROM what_if LEFT JOIN (SELECT * FROM final_hist WHERE name = 'hist_mode') m ON m.key = shipping_mode""", ["what_if", "final_hist", "train"])
def history_lookup(d: Domain) -> DataFrame:
    return d.what_if.select("lane_id", "shipping_mode", stable_round(F.col("hist_mode_rate"), 6).alias("hist_mode_rate"), "hist_mode_n")


@query("j08_what_if_rows", f"""
SELECT lane_id, shipping_mode, days_scheduled, order_country, order_region, {rnd("(SELECT value FROM middles WHERE name = 'sales')", 4)} AS sales,
  (SELECT value FROM typical WHERE name = 'customer_segment') AS customer_segment, {rnd('coalesce(c.rate, (SELECT avg(late) FROM train))', 6)} AS hist_country_rate, coalesce(c.n, 0.0::DOUBLE) AS hist_country_n
FROM what_if LEFT JOIN (SELECT * FROM final_hist WHERE name = 'hist_country') c ON c.key = order_country""", ["what_if", "final_hist", "middles", "typical", "train"])
def what_if_rows(d: Domain) -> DataFrame:
    return d.what_if.select(
        "lane_id", "shipping_mode", "days_scheduled", "order_country", "order_region", stable_round(F.col("sales"), 4).alias("sales"), "customer_segment",
        stable_round(F.col("hist_country_rate"), 6).alias("hist_country_rate"), "hist_country_n",
    )


def _audit_sql(name: str, keys: str) -> str:
    cols = keys.split(", ")
    on = " AND ".join(f"f.{c} = q.{c}" for c in cols)
    same = " AND ".join(f"l.{c} = x.{c}" for c in cols)
    return f"""SELECT '{name}' AS name, count(*) AS n_checked, CAST(count(*) FILTER (l.{name}_n <> x.n) AS BIGINT) AS n_changed, CAST(count(*) FILTER (x.later > x.n) AS BIGINT) AS n_leaked
FROM (SELECT * FROM data WHERE order_date <= TIMESTAMP '1999-01-01') l JOIN (
  SELECT {', '.join('q.' + c for c in cols)}, q.order_date, coalesce(sum(f.n) FILTER (f.label_known_at < q.order_date), 0) AS n, coalesce(sum(f.n), 0) AS later
  FROM (SELECT DISTINCT {keys}, order_date FROM lines WHERE order_date <= TIMESTAMP '1999-01-01') q
  LEFT JOIN (SELECT {keys}, label_known_at, count(*) AS n FROM lines GROUP BY ALL) f ON {on} AND f.label_known_at < q.order_date + INTERVAL 1 DAY
  GROUP BY ALL) x ON {same} AND l.order_date = x.order_date"""


@query("j10_leakage_audit", " UNION ALL ".join(_audit_sql(n, ", ".join(k)) for n, k in history.HISTORY_KEYS.items()), ["data", "lines"])
def leakage_audit(d: Domain) -> DataFrame:
    """The history of the dataset, and one with an injected leak (labels of the day after the order)."""
    prior, truth = history.global_prior(d.orders, VALID_START), history.audit_truth(d.orders, VALID_START)
    honest = history.add_history(d.orders, prior)
    day = F.make_dt_interval(F.lit(1))
    late = history.add_history(d.orders.withColumn("order_date", F.col("order_date") + day), prior).withColumn("order_date", F.col("order_date") - day)
    a = history.leakage_audit(honest, d.orders, VALID_START, prior, truth=truth)
    b = history.leakage_audit(late, d.orders, VALID_START, prior, truth=truth).select("name", F.col("n_changed").alias("n_leaked"))
    return a.join(b, "name")


# --- models: values have no SQL equivalent, what must hold of them has ------------------------------


def linear_scores(d: Domain) -> DataFrame:
    return forecast.scored(forecast.probability(d.linear, d.folded.filter("split <> 'train'")), "logreg", F.col("p"))


def tree_scores(d: Domain) -> DataFrame:
    return forecast.scored(forecast.probability(d.trees, d.folded.filter("split <> 'train'")), "boosted", F.col("p"))


def better_than_majority(d: Domain, scores: DataFrame) -> DataFrame:
    """split, n, positive_rate, and whether a model beats the constant answer in log-loss, AUC and Brier score."""
    both = forecast.metrics(scores.unionByName(forecast.majority_scores(d.split_lines)))
    a, b = both.filter("model <> 'majority'").alias("a"), both.filter("model = 'majority'").alias("b")
    return a.join(b, F.col("a.split") == F.col("b.split")).select("a.split", "a.n", "a.positive_rate", ((F.col("a.log_loss") < F.col("b.log_loss")) & (F.col("a.roc_auc") > 0.5) & (F.col("a.brier") < F.col("b.brier"))).alias("better"))


BETTER_SQL = f"SELECT split, count(*) AS n, {rnd('avg(late)', 4)} AS positive_rate, TRUE AS better FROM data WHERE split IN ('valid', 'test') GROUP BY 1"


@query("j04_logistic")
def logistic(d: Domain) -> DataFrame:
    return forecast.metrics(linear_scores(d))


@query("j04_beats_majority", BETTER_SQL, ["data"])
def logistic_check(d: Domain) -> DataFrame:
    return better_than_majority(d, linear_scores(d))


@query("j05_boosted")
def boosted(d: Domain) -> DataFrame:
    return forecast.metrics(tree_scores(d))


@query("j05_beats_majority", BETTER_SQL, ["data"])
def boosted_check(d: Domain) -> DataFrame:
    return better_than_majority(d, tree_scores(d))


@query("j06_unseen_categories", "SELECT shipping_mode, count(*) AS n, TRUE AS valid FROM data WHERE split = 'test' GROUP BY 1", ["data"])
def unseen(d: Domain) -> DataFrame:
    """Scores of orders whose country is new to the model: each gets a probability."""
    strange = forecast.fold_rare(d.folded.filter("split = 'test'").withColumn("order_country", F.lit("ATLANTIS")), d.common)
    return forecast.probability(d.trees, strange).groupBy("shipping_mode").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("p").between(0.0, 1.0)) == F.count(F.lit(1))).alias("valid"))


@query("j07_model_comparison")
def comparison(d: Domain) -> DataFrame:
    rules = forecast.majority_scores(d.split_lines).unionByName(forecast.mode_history_scores(d.folded))  # rates are not folded
    return forecast.metrics(rules.unionByName(linear_scores(d)).unionByName(tree_scores(d)))


@query("j08_lane_risk")
def lane_risk(d: Domain) -> DataFrame:
    return forecast.lane_risk(what_if_known(d), d.common, d.linear)


def what_if_known(d: Domain) -> DataFrame:
    known = d.lane_countries.join(forecast.country_regions(d.train_lines), "order_country", "left").select("lane_id", F.col("order_region").isNotNull().alias("known"))
    return d.what_if.join(known, "lane_id")


@query("j08_lane_notes", """
SELECT lane_id, mode AS shipping_mode, TRUE AS valid, CASE WHEN r.order_region IS NULL THEN 'No order history for the destination of ' || lane_id || '; used typical order values.'
  ELSE 'Baseline late-delivery risk from the order history (' || nodes.name || ', ' || mode || ').' END AS note
FROM lanes JOIN nodes ON node_id = destination LEFT JOIN regions r ON r.order_country = nodes.name, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('5-LOW'), ('9-NEVER')) m(mode)""", ["lanes", "nodes", "regions"])
def lane_notes(d: Domain) -> DataFrame:
    return lane_risk(d).select("lane_id", "shipping_mode", F.col("p").between(0.0, 1.0).alias("valid"), "note")


def explained_test(d: Domain) -> DataFrame:
    return forecast.contributions(d.linear, d.folded.filter("split = 'test'"))


@query("j09_explanations")
def explanations(d: Domain) -> DataFrame:
    return forecast.top_drivers(explained_test(d)).select(*ROW_KEY, stable_round(sigmoid(F.col("logit")), 4).alias("p"), stable_round(sigmoid(F.col("base")), 4).alias("base_p"), "text")


@query("j09_additivity", "SELECT count(*) AS n, TRUE AS adds_up, TRUE AS ordered FROM data WHERE split = 'test'", ["data"])
def additivity(d: Domain) -> DataFrame:
    """Base and contributions of every order add up to the model's own log-odds, and the three drivers are the strongest."""
    rows = forecast.top_drivers(explained_test(d))
    gap = F.abs(F.col("logit") - F.element_at(vector_to_array("rawPrediction"), 2))
    strongest = F.array_max(F.transform("contributions", lambda c: F.abs(c["contribution"])))
    ordered = (F.size("drivers") == 3) & (F.abs(F.col("drivers")[0]["size"] - strongest) < 1e-9) & (F.col("drivers")[1]["size"] >= F.col("drivers")[2]["size"])
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.max(gap) < 1e-6).alias("adds_up"), F.bool_and(ordered).alias("ordered"))


@query("d16_global_importance")
def importance(d: Domain) -> DataFrame:
    return forecast.global_importance(explained_test(d))


@query("d16_features", "SELECT unnest(['" + "', '".join((*history.CATEGORICAL, *history.NUMERIC, *history.HISTORY)) + "']) AS feature, TRUE AS valid")
def importance_features(d: Domain) -> DataFrame:
    return importance(d).select("feature", (F.col("importance") >= 0).alias("valid"))


def delay_of_top_lanes(d: Domain) -> DataFrame:
    top = d.risk.filter("exposure_score > 0").orderBy(F.desc("exposure_score"), "lane_id").limit(5).select("lane_id")
    return lane_risk(d).join(top, "lane_id")


@query("k05_baseline_delay")
def baseline_delay(d: Domain) -> DataFrame:
    """Late probability of the most exposed lanes, as a map per shipping mode."""
    entries = F.array_sort(F.collect_list(F.struct("lane_id", "p")))  # five lanes
    return delay_of_top_lanes(d).groupBy("shipping_mode").agg(F.map_from_entries(entries).alias("m")).select("shipping_mode", F.size("m").alias("n_lanes"), F.to_json("m").alias("baseline_delay_risk"))


@query("k05_delay_lanes", """
SELECT lane_id, mode AS shipping_mode, TRUE AS valid FROM (SELECT lane_id FROM risk WHERE exposure_score > 0 ORDER BY exposure_score DESC, lane_id LIMIT 5),
  (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('5-LOW'), ('9-NEVER')) m(mode)""", ["risk"])
def delay_lanes(d: Domain) -> DataFrame:
    return delay_of_top_lanes(d).select("lane_id", "shipping_mode", F.col("p").between(0.0, 1.0).alias("valid"))


view("ranked_terms", ("lines",), f"""
SELECT {KEY}, unnest([{{'name': 'quantity', 'c': {rnd('(quantity - 25) / 10.0::DOUBLE', 6)}}}, {{'name': 'discount', 'c': {rnd('(discount_rate - 0.05::DOUBLE) * 30.0::DOUBLE', 6)}}},
  {{'name': 'hour', 'c': {rnd('(order_hour - 11.5::DOUBLE) / 6.0::DOUBLE', 6)}}}, {{'name': 'month', 'c': {rnd('(order_month - 6.5::DOUBLE) / 3.0::DOUBLE', 6)}}}]) AS t FROM lines""")


@query("e11_top_drivers", f"""
SELECT {KEY}, string_agg(t.name, ',' ORDER BY abs(t.c) DESC, t.name DESC) AS drivers FROM (
  SELECT * FROM ranked_terms QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY abs(t.c) DESC, t.name DESC) <= 3) GROUP BY {KEY}""", ["ranked_terms"])
def top_drivers(d: Domain) -> DataFrame:
    term = lambda n, c: F.struct(F.lit(n).alias("feature"), stable_round(c, 6).alias("contribution"))
    parts = F.array(
        term("quantity", (F.col("quantity") - 25) / 10.0), term("discount", (F.col("discount_rate") - 0.05) * 30.0),
        term("hour", (F.col("order_hour") - 11.5) / 6.0), term("month", (F.col("order_month") - 6.5) / 3.0),
    )
    rows = d.order_lines.select(*ROW_KEY, parts.alias("contributions"), F.lit(0.0).alias("logit"), F.lit(0.0).alias("base"))
    names = F.array_join(F.transform("drivers", lambda c: c["feature"]), ",")
    return forecast.top_drivers(rows).select(*ROW_KEY, names.alias("drivers"))


@query("b33_driver_text", """
SELECT lane_id, 'exposure ' || printf('%.2f', floor(exposure_score * 100 + 0.5000001) / 100) || ' (' || risk_level || ') from ' || format('{:,}', n_events) || ' events' AS line FROM risk""", ["risk"])
def driver_text(d: Domain) -> DataFrame:
    score = stable_round(F.col("exposure_score"), 2)
    return d.risk.select("lane_id", F.format_string("exposure %.2f (%s) from %,d events", score, "risk_level", "n_events").alias("line"))


# --- sources and run results ----------------------------------------------------------------------


@query("a11_load_orders", """
SELECT order_date, days_real, days_scheduled, late, shipping_mode, order_country, payment_type, quantity, sales FROM lines""", ["lines"])
def load_orders(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "export")
    order_files.save_export(d.order_lines, path)
    return order_files.load_orders(d.spark, path).select(
        "order_date", "days_real", "days_scheduled", "late", "shipping_mode", "order_country", "payment_type", "quantity", "sales"
    )


@query("a10_load_reference", """
SELECT 'port' AS part, node_id AS id, name, region AS extra, lat, lon FROM nodes WHERE kind = 'port'
UNION ALL SELECT 'waypoint', node_id, name, kind, lat, lon FROM nodes WHERE kind <> 'port'
UNION ALL SELECT 'leg', from_node, to_node, NULL, NULL, NULL FROM legs UNION ALL SELECT 'lane', lane_id, origin, destination, NULL, NULL FROM lanes""", ["nodes", "legs", "lanes"])
def load_reference(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "reference")
    names = d.nodes.withColumn("aliases", F.concat(F.lit(" "), F.lower("name"), F.lit(" |  | "), "region"))
    reference.save_reference(names, d.legs, d.lanes, path)
    return reference.listing(reference.load_reference(d.spark, path))


@query("a14_load_spec", """
SELECT window_id, kind, start_day AS start, end_day AS end FROM (
  SELECT 'd' || k AS window_id, 'disruption' AS kind, onset - 10 AS start_day, onset + 3 AS end_day FROM (
    SELECT user_id % 25 AS k, CAST(max(ts) AS DATE) AS onset FROM events GROUP BY 1)
  UNION ALL SELECT 'control_1', 'control', CAST(min(ts) AS DATE), CAST(min(ts) AS DATE) + 6 FROM events)""")
def load_spec(d: Domain) -> DataFrame:
    """A spec document derived from the events, written as JSON and read back."""
    onsets = d.table("events").groupBy((F.col("user_id") % 25).alias("k")).agg(F.to_date(F.max("ts")).alias("onset"))
    one = F.struct(F.concat(F.lit("d"), F.col("k").cast("string")).alias("id"), F.lit("").alias("name"), F.col("onset").cast("string").alias("onset"),
                   F.array(F.lit("RA000")).alias("target_nodes"))
    disruptions = onsets.agg(F.array_sort(F.collect_list(one)).alias("disruptions"), F.lit(1).alias("j"))  # one per network node
    first = F.to_date(F.min("ts"))
    window = F.array(F.struct(first.cast("string").alias("start"), F.date_add(first, 6).cast("string").alias("end")))
    controls = d.table("events").agg(window.alias("control_windows"), F.lit(1).alias("j"))
    params = F.struct(F.lit(7).alias("lookback_days"), F.lit(0.5).alias("threshold"), F.lit(10).alias("window_before_days"), F.lit(3).alias("window_after_days"))
    doc = disruptions.join(controls, "j").select(F.to_json(F.struct(
        params.alias("params"), F.lit("RB001-RC002").alias("primary_lane"), F.array(F.lit("africa_asia")).alias("secondary_lane_focus"), "disruptions", "control_windows")))
    path = scratch_path(d.spark, "spec")
    doc.coalesce(1).write.text(path)
    return results.load_spec(d.spark, path).windows(d.spark).select("window_id", "kind", "start", "end")


view("asked_days", (), "SELECT CAST(day AS DATE) AS day, day(day) <> 13 AS landed FROM (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-05', INTERVAL 1 DAY)) AS day)")
view("day_log", ("asked_days", "records"), """
SELECT a.day, CASE WHEN NOT landed THEN 'missing' WHEN r.day IS NULL THEN 'no_items' ELSE 'ok' END AS status, coalesce(items, 0) AS items, coalesce(n_events, 0) AS events, coalesce(failed, 0) AS failed
FROM asked_days a LEFT JOIN (SELECT CAST(published AS DATE) AS day, count(*) AS items, count(*) FILTER (flag) AS n_events, count(*) FILTER (status = 'failed') AS failed FROM records GROUP BY 1) r
  ON r.day = a.day AND landed""")


def day_store(d: Domain) -> str:
    """Documents as the news of 48 days, extracted in two runs: the first stops half-way. The exports of each 13th never landed."""
    path = scratch_path(d.spark, "days")
    asked = d.spark.range(1).select(F.explode(F.sequence(F.lit(dt.date(2023, 12, 20)), F.lit(dt.date(2024, 2, 5)))).alias("day"))
    asked = asked.withColumn("landed", F.dayofmonth("day") != 13)
    items = d.doc_items.withColumn("day", F.to_date("published"))

    def extract(news: DataFrame) -> DataFrame:
        return extraction.run_extraction(news, lambda x: d.read_by_rules(x))

    days.finish_days(items, asked.filter("day <= '2024-01-15'"), extract, path)
    days.finish_days(items, asked, extract, path)
    return path


@query("a15_events_by_day", "SELECT day, status, items, events, failed FROM day_log", ["day_log"])
def events_by_day(d: Domain) -> DataFrame:
    return days.load_manifest(d.spark, day_store(d)).select("day", "status", "items", "events", "failed")


@query("a15_day_events", """
SELECT event_id, news_id, CAST(published AS DATE) AS day FROM records WHERE flag AND day(published) <> 13""", ["records"])
def day_events(d: Domain) -> DataFrame:
    return days.load_days(d.spark, day_store(d)).filter("status = 'ok'").select("day", F.inline("events")).select("event_id", "news_id", "day")


@query("c21_missing_days", "SELECT day FROM day_log WHERE status <> 'ok'", ["day_log"])
def missing_days(d: Domain) -> DataFrame:
    return days.load_manifest(d.spark, day_store(d)).filter("status != 'ok'").select("day")


@query("d12_day_totals", """
SELECT count(*) AS total, string_agg(CASE WHEN status <> 'ok' THEN CAST(day AS VARCHAR) END, ',' ORDER BY day) AS missing, CAST(sum(items) AS BIGINT) AS items, CAST(sum(events) AS BIGINT) AS events,
  CAST(sum(failed) AS BIGINT) AS failed FROM day_log""", ["day_log"])
def day_totals(d: Domain) -> DataFrame:
    return days.day_totals(days.load_manifest(d.spark, day_store(d)))


@query("a16_run_results", """
SELECT 'v1' AS run, disruption_id, count(*) AS lanes, count(*) FILTER (NOT missed) AS lanes_warned FROM lead GROUP BY 2""", ["lead"])
def run_results(d: Domain) -> DataFrame:
    path = scratch_path(d.spark, "runs")
    results.save_run(replay.score_disruptions(d.signals("v1"), d.windows), path, "v1")
    return results.load_runs(d.spark, path).groupBy("run", "disruption_id").agg(F.count(F.lit(1)).alias("lanes"), F.count_if(~F.col("missed")).alias("lanes_warned"))
