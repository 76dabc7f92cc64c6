"""Late-delivery models: metrics, baselines, pipelines, training snapshot, what-if rows, explanations."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laneguard.functions.numeric import clip_probability, sigmoid, smoothed_rate, stable_round
from laneguard.operators import boosting
from laneguard.operators.history import CATEGORICAL, HISTORY, HISTORY_KEYS, NUMERIC, TARGET
from laneguard.operators.store import ntz
from laneguard.session import materialize, scratch_root

MIN_CATEGORY_ROWS = 50
RARE = "(rare)"
NEWTON_SIZE = 512
"""Coefficients up to which the second derivatives (their square) are summed."""
MLLIB_ROWS = 200_000
"""Training rows up to which MLlib fits the boosted trees; its passes over more take too long."""
BINS = 1024
"""Bins of one pass of the search for a rank."""
BRACKET = 10_000
"""Rows that such a search counts value by value."""
# Scheduled days of a shipping mode in a what-if order.
TYPICAL_SCHEDULED_DAYS = {"Standard Class": 4, "Second Class": 2, "First Class": 1, "Same Day": 0}
# ISO country -> country name in the order history.
ORDER_COUNTRY_NAMES = {
    "IE": "Irlanda", "GB": "Reino Unido", "NL": "Países Bajos", "BE": "Bélgica", "DE": "Alemania", "FR": "Francia", "ES": "España",
    "IT": "Italia", "GR": "Grecia", "PL": "Polonia", "PT": "Portugal", "IN": "India", "CN": "China", "SG": "Singapur",
    "US": "Estados Unidos", "AE": "Emiratos Árabes Unidos", "LK": "SriLanka", "MT": "Malta", "SI": "Eslovenia", "MA": "Marruecos",
    "EG": "Egipto", "ZA": "Sudáfrica",
}


# What explanations call the features.
FEATURE_NAMES = {
    "shipping_mode": "shipping mode", "days_scheduled": "scheduled shipping days", "market": "market", "order_region": "order region",
    "order_country": "destination country", "customer_segment": "customer segment", "category": "product category", "department": "department",
    "payment_type": "payment type", "quantity": "quantity", "unit_price": "unit price", "discount_rate": "discount rate", "sales": "order value",
    "order_hour": "order hour", "order_dow": "order weekday", "order_month": "order month",
    "hist_mode_region_rate": "recent late rate for this mode and region", "hist_mode_region_n": "history size for this mode and region",
    "hist_country_rate": "recent late rate for this country", "hist_country_n": "history size for this country",
    "hist_mode_rate": "recent late rate for this shipping mode", "hist_mode_n": "history size for this shipping mode",
}


# --- metrics ----------------------------------------------------------------------------------------


def score_counts(scores: DataFrame) -> DataFrame:
    """model, split, p, pos, neg + cum_pos, cum_neg over all scores >= p.

    Rows are counted per distinct score first. The distinct scores are cut into ranges of equal size (by
    sampling, so a crowded part of the scale gets more ranges) and stored; running totals go over ranges
    and over the scores within one range. The ranks are exact and no task sorts a whole model.
    """
    by = ["model", "split"]
    ranges = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = scores.groupBy(*by, clip_probability(F.col("p")).alias("p")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    per = materialize(counts.repartitionByRange(ranges, *by, "p").withColumn("bucket", F.spark_partition_id()), "scores")
    totals = per.groupBy(*by, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = W.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    higher = totals.select(*by, "bucket", F.coalesce(F.sum("bp").over(above), zero).alias("hp"), F.coalesce(F.sum("bn").over(above), zero).alias("hn"))
    inside = W.partitionBy(*by, "bucket").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        per.withColumn("ip", F.sum("pos").over(inside)).withColumn("in", F.sum("neg").over(inside))
        .join(higher, [*by, "bucket"])
        .select(*by, "p", "pos", "neg", (F.col("ip") + F.col("hp")).alias("cum_pos"), (F.col("in") + F.col("hn")).alias("cum_neg"))
    )


def metrics(scores: DataFrame) -> DataFrame:
    """model, split, y, p -> ROC-AUC (ties half), step-wise average precision, Brier, log-loss, accuracy, n, positive rate."""
    d = lambda c: F.col(c).cast("double")
    pos, neg, p = d("pos"), d("neg"), F.col("p")
    n, n_pos, n_neg = F.sum(pos + neg), F.sum(pos), F.sum(neg)
    pairs = F.sum(neg * (d("cum_pos") - pos) + pos * neg * 0.5)
    steps = F.sum(pos * d("cum_pos") / (d("cum_pos") + d("cum_neg")))
    spread, low = F.max("p") - F.min("p"), F.min("p")
    auc = F.when(spread <= low * 1e-5 + 1e-8, F.lit(0.5)).otherwise(F.try_divide(pairs, n_pos * n_neg))
    right = F.when(p >= 0.5, pos).otherwise(neg)
    return score_counts(scores).groupBy("model", "split").agg(
        stable_round(auc, 4).alias("roc_auc"),
        stable_round(F.try_divide(steps, n_pos), 4).alias("pr_auc"),
        stable_round(F.sum(pos * (p - 1) * (p - 1) + neg * p * p) / n, 4).alias("brier"),
        stable_round(F.sum(-pos * F.ln(p) - neg * F.ln(F.lit(1.0) - p)) / n, 4).alias("log_loss"),
        stable_round(F.sum(right) / n, 4).alias("accuracy"),
        n.cast("bigint").alias("n"),
        stable_round(n_pos / n, 4).alias("positive_rate"),
    )


def scored(data: DataFrame, model: str, p: Column) -> DataFrame:
    return data.filter("split IN ('valid', 'test')").select(F.lit(model).alias("model"), "split", F.col(TARGET).alias("y"), p.cast("double").alias("p"))


def majority_scores(data: DataFrame) -> DataFrame:
    """Every order gets the late share of the training rows."""
    share = data.agg(F.avg(F.when(F.col("split") == "train", F.col(TARGET)))).first()[0]
    return scored(data, "majority", F.lit(share))


def mode_history_scores(data: DataFrame) -> DataFrame:
    return scored(data, "mode_history", F.col("hist_mode_rate"))


# --- models -----------------------------------------------------------------------------------------


def common_categories(train: DataFrame) -> DataFrame:
    """name, value: categories with at least 50 training rows, for all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in CATEGORICAL])
    return train.select(F.inline(pairs)).groupBy("name", "value").count().filter(F.col("count") >= MIN_CATEGORY_ROWS).drop("count")


def fold_rare(data: DataFrame, common: DataFrame) -> DataFrame:
    """Categories outside ``common`` (rare or unseen) become one value. One row of ``common`` per name and value is joined."""
    out = data
    for c in CATEGORICAL:
        table = common.filter(F.col("name") == c).select(F.col("value").alias(c), F.lit(True).alias("common"))
        out = out.join(table, c, "left").withColumn(c, F.when(F.col("common"), F.col(c)).otherwise(RARE)).drop("common")
    return out.select(*data.columns)


def _encoded() -> list:
    index = StringIndexer(inputCols=list(CATEGORICAL), outputCols=[f"{c}_ix" for c in CATEGORICAL], handleInvalid="keep")
    onehot = OneHotEncoder(inputCols=[f"{c}_ix" for c in CATEGORICAL], outputCols=[f"{c}_oh" for c in CATEGORICAL], dropLast=False, handleInvalid="keep")
    numbers = VectorAssembler(inputCols=[*NUMERIC, *HISTORY], outputCol="numbers")
    scale = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)
    join = VectorAssembler(inputCols=[*[f"{c}_oh" for c in CATEGORICAL], "scaled"], outputCol="features")
    return [index, onehot, numbers, scale, join]


def _newton_sums(rows: DataFrame, columns: tuple[list[str], list[str]], starts: list[int], shift: list[float], scale: list[float], weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, second derivatives) of the summed logistic loss at ``weights`` (intercept last), in one pass.

    A task adds up its batches and gives one row per cell of the upper triangle; Spark sums these by cell, so that the
    driver gets as many rows as there are cells, whatever the number of tasks.
    """
    categories, numbers = columns
    d = len(weights)
    upper = np.triu_indices(d)

    def partial(batches):
        loss, first, second = 0.0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = np.zeros((batch.num_rows, d))
            x[:, -1] = 1.0
            every = np.arange(batch.num_rows)
            for c, start in zip(categories, starts):
                x[every, start + batch.column(c).to_numpy(zero_copy_only=False).astype(int)] = 1.0
            for k, c in enumerate(numbers):
                x[:, starts[-1] + k] = (batch.column(c).to_numpy(zero_copy_only=False) - shift[k]) * scale[k]
            y, z = batch.column(TARGET).to_numpy(zero_copy_only=False), x @ weights
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            loss += float(np.sum(np.logaddexp(0.0, z) - y * z))
            first += x.T @ (p - y)
            second += (x * (p * (1.0 - p))[:, None]).T @ x
        values = np.concatenate([[loss], first, second[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "value"])

    cells = rows.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(1 + d + len(upper[0]))
    for r in cells:
        values[r["cell"]] = r["value"]
    second = np.zeros((d, d))
    second[upper] = values[1 + d:]
    return values[0], values[1:1 + d], second + np.triu(second, 1).T


def newton_logistic(stages: PipelineModel, train: DataFrame, c: float, max_iter: int, tol: float = 1e-9) -> LogisticRegressionModel:
    """The minimum of the summed loss plus ``|w|^2 / 2c`` by Newton steps: some ten passes over narrow rows instead of one
    pass per gradient step, and nothing is held in memory between them."""
    slots = feature_slots(stages)
    categories, numbers = [f"{x}_ix" for x in CATEGORICAL], [*NUMERIC, *HISTORY]
    index, scaler = stages.stages[0], stages.stages[3]
    rows = index.transform(train).select(*[F.col(x).cast("int").alias(x) for x in categories], *[F.col(x).cast("double").alias(x) for x in numbers], F.col(TARGET).cast("double").alias(TARGET))
    rows = materialize(rows, "logistic-rows")
    starts = [*slots.starts[:len(categories)], slots.starts[len(categories)]]
    scale = [1.0 / s if s > 0 else 0.0 for s in scaler.std]
    size = sum(slots.sizes) + 1
    ridge = np.full(size, 1.0 / c)
    ridge[-1] = 0.0  # no penalty on the intercept
    ask = lambda w: _newton_sums(rows, (categories, numbers), starts, [float(m) for m in scaler.mean], scale, w)
    total = lambda loss, w: loss + 0.5 * float(np.sum(ridge * w * w))
    weights = np.zeros(size)
    loss, first, second = ask(weights)
    best = total(loss, weights)
    for _ in range(max_iter):
        slope = first + ridge * weights
        step = np.linalg.lstsq(second + np.diag(ridge), slope, rcond=None)[0]
        gain = float(slope @ step)
        if gain <= tol * max(best, 1e-300):
            break
        share = 1.0
        while True:
            loss, new_first, new_second = ask(weights - share * step)
            now = total(loss, weights - share * step)
            if now <= best or share < 1e-6:
                break
            share /= 2
        if now > best:  # no smaller value along the step: the minimum within double precision
            break
        weights, best, first, second = weights - share * step, now, new_first, new_second
    context = SparkContext.getOrCreate()
    jvm = context._gateway.jvm
    made = jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"LogisticRegression_{uuid.uuid4().hex[:12]}", _py2java(context, Vectors.dense(weights[:-1])), float(weights[-1]))
    model = LogisticRegressionModel(made)
    model.set(model.labelCol, TARGET)
    return model


def fit_logistic(train: DataFrame, c: float = 1.0, max_iter: int = 2000) -> PipelineModel:
    """One-hot categories and scaled numbers; the penalty equals C = 1 of a summed loss.

    Up to ``NEWTON_SIZE`` coefficients the minimum is found by Newton steps, beyond by MLlib's gradient steps.
    """
    stages = Pipeline(stages=_encoded()).fit(train)
    if sum(feature_slots(stages).sizes) < NEWTON_SIZE:
        return PipelineModel([*stages.stages, newton_logistic(stages, train, c, max_iter)])
    n = train.count()
    model = LogisticRegression(labelCol=TARGET, maxIter=max_iter, tol=1e-5, regParam=1.0 / (c * max(n, 1)), standardization=False)
    return PipelineModel([*stages.stages, model.fit(stages.transform(train))])


def patient_best(losses: list[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the smallest loss, whether ``patience`` rounds without a smaller one followed): later rounds no longer count then."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first n rounds, made from the fitted trees."""
    trees, weights = model._java_obj.trees(), model.treeWeights
    context = SparkContext.getOrCreate()
    gateway, jvm = context._gateway, context._jvm
    some = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    own = gateway.new_array(jvm.double, n)
    for i in range(n):
        some[i], own[i] = trees[i], float(weights[i])
    short = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, some, own)
    out = GBTClassificationModel(short)
    for param, value in model.extractParamMap().items():
        out.set(out.getParam(param.name), value)
    return out


def settled_orders(train: DataFrame) -> DataFrame:
    """Training rows without the orders placed so late that only quick outcomes were known when training ended.

    Training rows have a known outcome. Of the orders of the last days (the longest time to an outcome) that leaves the
    quick ones, which are mostly on time, while all older orders are there whatever their outcome. Trees find those days by
    the size of the history, which grows with time, and every later order lies on their side of the split.
    """
    times = train.agg(F.max("label_known_at").alias("end"), F.max(F.col("label_known_at") - F.col("order_date")).alias("longest")).first()
    if times["end"] is None:
        return train
    whole = train.filter(F.col("order_date") <= ntz(times["end"] - times["longest"]))
    return train if whole.isEmpty() else whole


def fit_boosted(data: DataFrame, rounds: int = 2000, step: float = 0.05, patience: int = 100) -> PipelineModel:
    """Boosted trees on the settled training rows (rare categories folded before), cut at the round with the smallest loss
    on the validation rows.

    Rounds end when ``patience`` of them bring no smaller loss; the cut model is made of the trees that are there. Up to
    ``MLLIB_ROWS`` training rows MLlib fits. It cannot go on with a fitted model, so only when the patience has not ended are
    the rounds doubled and fitted anew (the same seed gives the same first trees). Beyond, ``boosting`` grows the same kind of
    trees with the same settings over blocks of binned rows. Unseen categories are their own index. Without validation rows
    all rounds are kept.
    """
    spark = data.sparkSession
    index = StringIndexer(inputCols=list(CATEGORICAL), outputCols=[f"{c}_ix" for c in CATEGORICAL], handleInvalid="keep")
    join = VectorAssembler(inputCols=[*[f"{c}_ix" for c in CATEGORICAL], *NUMERIC, *HISTORY], outputCol="features")
    known = settled_orders(data.filter("split = 'train'")).unionByName(data.filter("split = 'valid'"))
    before = Pipeline(stages=[index, join]).fit(known)
    settings = dict(labelCol=TARGET, stepSize=step, maxDepth=5, minInstancesPerNode=50, featureSubsetStrategy="0.8", subsamplingRate=0.8, seed=42)
    settings["maxBins"] = max(256, *[len(labels) + 1 for labels in before.stages[0].labelsArray])  # every category needs a bin
    if spark.sparkContext.getCheckpointDir() is None:  # each round builds on the errors of the one before
        spark.sparkContext.setCheckpointDir(f"{scratch_root(spark)}/laneguard/checkpoints")
    sizes = {r["split"]: r["count"] for r in known.groupBy("split").count().collect()}
    if sizes.get("train", 0) > MLLIB_ROWS:
        rows = before.transform(known).withColumn(TARGET, F.col(TARGET).cast("double"))
        train, valid = rows.filter("split = 'train'"), rows.filter("split = 'valid'") if sizes.get("valid") else None
        trees = boosting.fit_blocks(GBTClassifier(maxIter=rounds, **settings), train, valid, [len(labels) + 1 for labels in before.stages[0].labelsArray],
                                    [*NUMERIC, *HISTORY], sizes["train"], patience, patient_best)
        return PipelineModel([*before.stages, trees])
    rows = before.transform(known).select("split", "features", F.col(TARGET).cast("double").alias(TARGET))
    rows = materialize(rows, "boosted-rows")
    train, valid = rows.filter("split = 'train'"), rows.filter("split = 'valid'")

    def fit(n: int):
        return GBTClassifier(maxIter=n, **settings).fit(train)

    n = rounds if valid.isEmpty() else min(rounds, 2 * patience)
    trees = fit(n)
    while not valid.isEmpty():
        best, settled = patient_best(trees.evaluateEachIteration(valid), patience)
        if settled or n == rounds:
            trees = trees if best == n else first_rounds(trees, best)
            break
        n = min(rounds, 2 * n)
        trees = fit(n)
    return PipelineModel([*before.stages, trees])


def probability(model: PipelineModel, data: DataFrame) -> DataFrame:
    return model.transform(data).withColumn("p", vector_to_array("probability")[1])


# --- explanations (linear model: base + contributions = logit) --------------------------------------


@dataclass(frozen=True)
class Slots:
    """Where each raw feature sits in the model vector."""

    names: tuple[str, ...]
    starts: tuple[int, ...]
    sizes: tuple[int, ...]


def feature_slots(model: PipelineModel) -> Slots:
    sizes = [s for s in model.stages[1].categorySizes]
    sizes = [size + 1 for size in sizes] + [1] * len([*NUMERIC, *HISTORY])
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    return Slots((*CATEGORICAL, *NUMERIC, *HISTORY), tuple(starts), tuple(sizes))


def contributions(model: PipelineModel, data: DataFrame) -> DataFrame:
    """data + base, logit, contributions array<struct<feature, contribution>> (log-odds)."""
    linear, slots = model.stages[-1], feature_slots(model)
    weights = F.array(*[F.lit(float(w)) for w in linear.coefficients])
    terms = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    total = lambda start, size: F.aggregate(F.slice("terms", start + 1, size), F.lit(0.0), lambda a, t: a + t)
    parts = F.array(*[
        F.struct(F.lit(n).alias("feature"), total(a, s).alias("contribution")) for n, a, s in zip(slots.names, slots.starts, slots.sizes, strict=True)
    ])
    with_terms = model.transform(data).withColumn("terms", terms).withColumn("contributions", parts)
    base = float(linear.intercept)
    summed = F.aggregate("contributions", F.lit(base), lambda a, c: a + c["contribution"])
    return with_terms.withColumn("base", F.lit(base)).withColumn("logit", summed)


def shown_value(feature: Column) -> Column:
    """The value of a feature in its row as text: two decimals, or whole thousands from 100 on."""
    out = None
    for name in (*CATEGORICAL, *NUMERIC, *HISTORY):
        x = F.col(name)
        text = x if name in CATEGORICAL else F.when(F.abs(x) < 100, F.format_string("%.2f", x.cast("double"))).otherwise(F.format_string("%,.0f", x.cast("double")))
        out = F.when(feature == name, text) if out is None else out.when(feature == name, text)
    return out


def top_drivers(explained: DataFrame, k: int = 3) -> DataFrame:
    """explained + drivers: the k strongest contributions, largest first, and a sentence."""
    ranked = F.sort_array(F.transform("contributions", lambda c: F.struct(F.abs(c["contribution"]).alias("size"), c["feature"].alias("feature"),
                                                                          stable_round(c["contribution"], 3).alias("contribution"))), asc=False)
    with_drivers = explained.withColumn("drivers", F.slice(ranked, 1, k))
    valued = set(FEATURE_NAMES) <= set(explained.columns)
    label = lambda f: F.coalesce(friendly_name(f), F.replace(f, F.lit("_"), F.lit(" ")))
    part = F.transform("drivers", lambda c: F.concat(
        label(c["feature"]), F.concat(F.lit(" = "), F.coalesce(shown_value(c["feature"]), F.lit("unknown"))) if valued else F.lit(""),
        F.when(c["contribution"] > 0, " raises").otherwise(" lowers"), F.lit(" risk ("), F.format_string("%+.2f", c["contribution"]), F.lit(" log-odds)")))
    text = F.format_string("Late-delivery risk %.0f%% (model baseline %.0f%%). Main drivers: %s.", sigmoid(F.col("logit")) * 100,
                           sigmoid(F.col("base")) * 100, F.array_join(part, "; "))
    return with_drivers.withColumn("text", text)


def friendly_name(feature: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in FEATURE_NAMES.items() for x in kv])
    return F.try_element_at(names, feature)


def global_importance(explained: DataFrame) -> DataFrame:
    return explained.select(F.inline("contributions")).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


# --- training snapshot and what-if orders -----------------------------------------------------------


def modes(train: DataFrame, columns: tuple[str, ...] = CATEGORICAL) -> DataFrame:
    """name, value, n: the most frequent value per column, the smallest among equals."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = train.select(F.inline(pairs)).groupBy("name", "value").count()
    best = counts.groupBy("name").agg(F.min(F.struct((-F.col("count")).alias("neg"), F.col("value").alias("value"))).alias("b"))
    return best.select("name", F.col("b.value").alias("value"), (-F.col("b.neg")).alias("n"))


def nth_values(rows: DataFrame, targets: dict[str, list[tuple[str, int]]]) -> dict[str, list[float]]:
    """Exact values at given ranks (from 0) of given columns, by histogram narrowing.

    ``targets`` maps a label to (column, rank) pairs. Each pass counts, for all open targets at once, the values between
    a target's bounds in ``BINS`` bins, with the smallest and largest value of each bin; the bin that holds the rank
    gives the next bounds. It ends where a bin has one value, or so few rows (``BRACKET``) that they are counted value
    by value. The driver holds ``BINS`` rows per target and pass; nothing is sorted.
    """
    flat = [(label, i, c, rank) for label, pairs in targets.items() for i, (c, rank) in enumerate(pairs)]
    columns = sorted({c for _, _, c, _ in flat})
    ends = rows.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))], *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    spans = {k: (ends[f"lo_{t[2]}"], ends[f"hi_{t[2]}"], t[3], ends[f"n_{t[2]}"]) for k, t in enumerate(flat)}
    found = {k: s[0] for k, s in spans.items() if s[0] == s[1]}
    while len(found) < len(flat):
        todo = [k for k in spans if k not in found]
        fine = {k: spans[k][3] <= BRACKET for k in todo}
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(flat[k][2]).cast("double").alias("v"), F.lit(spans[k][0]).alias("lo"), F.lit(spans[k][1]).alias("hi"), F.lit(fine[k]).alias("fine")) for k in todo])
        width = F.col("hi") / BINS - F.col("lo") / BINS  # not hi - lo, which may be too large
        step = F.least(F.floor(F.try_divide(F.col("v") / BINS - F.col("lo") / BINS, width) * BINS), F.lit(BINS - 1))
        inside = rows.select(F.inline(cells)).filter("v >= lo AND v <= hi").withColumn("bin", F.when(F.col("fine"), F.col("v")).otherwise(step.cast("double")))
        bins: dict[int, list] = {}
        for r in inside.groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            bins.setdefault(r["k"], []).append(r)
        for k in todo:
            rank = spans[k][2]
            for r in sorted(bins[k], key=lambda r: r["lo"]):
                if rank < r["n"]:
                    spans[k] = (r["lo"], r["hi"], rank, r["n"])
                    break
                rank -= r["n"]
            if spans[k][0] == spans[k][1]:
                found[k] = spans[k][0]
    out: dict[str, list[float]] = {}
    for k, (label, _, _, _) in enumerate(flat):
        out.setdefault(label, []).append(found[k])
    return out


def medians(train: DataFrame, columns: tuple[str, ...] = NUMERIC) -> DataFrame:
    """name, value: exact medians of the non-null values (``nth_values``); columns without any have no row."""
    counts = train.agg(*[F.count(c).alias(c) for c in columns]).first()
    middle = {c: [(c, (counts[c] - 1) // 2), (c, counts[c] // 2)] for c in columns if counts[c]}
    values = nth_values(train, middle) if middle else {}
    return train.sparkSession.createDataFrame([(c, (a + b) / 2.0) for c, (a, b) in values.items()], "name string, value double")


def lane_countries(lanes: DataFrame, names: DataFrame | None = None, code: Column | None = None) -> DataFrame:
    """lane_id, order_country: the destination's country as the order history calls it, null where it has no name.

    names: country_code, order_country, one row per code; by default the names of ``ORDER_COUNTRY_NAMES``. code: where the
    code of a lane's destination is found; by default the first two letters of the port.
    """
    if names is None:
        names = lanes.sparkSession.createDataFrame(list(ORDER_COUNTRY_NAMES.items()), "country_code string, order_country string")
    of_port = F.upper(F.substring("destination", 1, 2)) if code is None else code
    return lanes.select("lane_id", of_port.alias("country_code")).join(names, "country_code", "left").select("lane_id", "order_country")


def country_regions(train: DataFrame) -> DataFrame:
    counts = train.groupBy("order_country", "order_region").count()
    best = F.min(F.struct((-F.col("count")).alias("neg"), F.col("order_region").alias("order_region")))
    return counts.groupBy("order_country").agg(best.alias("b")).select("order_country", F.col("b.order_region").alias("order_region"))


def final_history(train: DataFrame, prior: float) -> DataFrame:
    """name, key, rate, n: end-of-training history per key of every key set."""
    parts = []
    for name, keys in HISTORY_KEYS.items():
        per = train.groupBy(F.concat_ws("|", *keys).alias("key")).agg(F.sum(TARGET).alias("late"), F.count(F.lit(1)).alias("n"))
        parts.append(per.select(F.lit(name).alias("name"), "key", smoothed_rate(F.col("late"), F.col("n"), F.lit(prior)).alias("rate"),
                                F.col("n").cast("double").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def what_if_orders(lanes: DataFrame, regions: DataFrame, history: DataFrame, defaults: dict, prior: float,
                   scheduled: dict[str, float] | None = None) -> DataFrame:
    """One feature row per lane and shipping mode.

    lanes: lane_id, order_country (NULL when the destination is not in the order history). defaults: the
    typical values (modes and medians). Missing history falls back to the prior with count 0.
    """
    days = scheduled or TYPICAL_SCHEDULED_DAYS
    choices = F.array(*[F.struct(F.lit(m).alias("shipping_mode"), F.lit(float(v)).alias("days_scheduled")) for m, v in days.items()])
    rows = (
        lanes.select("lane_id", "order_country", F.inline(choices))
        .join(regions.withColumnRenamed("order_region", "known_region"), "order_country", "left")
        .withColumn("order_region", F.coalesce("known_region", F.lit(defaults["order_region"])))
        .withColumn("order_country", F.when(F.col("known_region").isNotNull(), F.col("order_country")).otherwise(defaults["order_country"]))
        .drop("known_region")
    )
    fixed = {c: defaults[c] for c in (*CATEGORICAL, *NUMERIC) if c not in ("shipping_mode", "days_scheduled", "order_region", "order_country")}
    for c, v in fixed.items():
        rows = rows.withColumn(c, F.lit(v))
    for name, keys in HISTORY_KEYS.items():
        table = history.filter(F.col("name") == name).select(F.col("key").alias("k"), F.col("rate").alias("r"), F.col("n").alias("m"))
        rows = (
            rows.withColumn("k", F.concat_ws("|", *keys)).join(table, "k", "left")
            .withColumn(f"{name}_rate", F.coalesce("r", F.lit(prior))).withColumn(f"{name}_n", F.coalesce("m", F.lit(0.0)))
            .drop("k", "r", "m")
        )
    return rows


def lane_risk(rows: DataFrame, common: DataFrame, model: PipelineModel) -> DataFrame:
    """What-if rows -> lane_id, shipping_mode, p and a note on what the probability rests on.

    ``rows`` say with ``known`` whether the lane's country is in the order history; otherwise typical values were used.
    Rare categories are folded for the model only, the note has the names asked for.
    """
    asked = rows.withColumn("asked_mode", F.col("shipping_mode")).withColumn("asked_country", F.col("order_country"))
    note = F.when(F.col("known"), F.format_string("Baseline late-delivery risk from the order history (%s, %s).", "asked_country", "asked_mode")).otherwise(
        F.format_string("No order history for the destination of %s; used typical order values.", "lane_id"))
    scored = probability(model, fold_rare(asked, common))
    return scored.select("lane_id", F.col("asked_mode").alias("shipping_mode"), stable_round(F.col("p"), 4).alias("p"), note.alias("note"))
