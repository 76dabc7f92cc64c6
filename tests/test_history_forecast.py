import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laneguard.operators import boosting, forecast, history

SCHEMA = "id int, order_date timestamp_ntz, days_real int, late int, shipping_mode string, order_region string, order_country string"


@pytest.fixture(scope="module")
def orders(spark):
    rnd = random.Random(11)
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(hours=12 * rnd.randint(0, 120)), rnd.randint(0, 5), rnd.randint(0, 1),
             "hot" if rnd.random() < 0.6 else rnd.choice("ab"), rnd.choice("xy"), rnd.choice("pqr")) for i in range(400)]
    return rows, history.with_label_time(spark.createDataFrame(rows, SCHEMA))


def test_history_equals_brute_force(orders):
    rows, df = orders
    got = {r.id: r for r in history.add_history(df, 0.5).collect()}
    assert len(got) == len(rows)
    known = [(r[1] + dt.timedelta(days=r[2]), r[3], r[4], r[5], r[6]) for r in rows]
    for i, when, _, _, mode, region, country in rows:
        for name, hit in (("hist_mode", lambda k: k[2] == mode), ("hist_mode_region", lambda k: k[2] == mode and k[3] == region), ("hist_country", lambda k: k[4] == country)):
            past = [k[1] for k in known if k[0] < when and hit(k)]
            assert got[i][f"{name}_n"] == len(past)
            assert got[i][f"{name}_rate"] == pytest.approx((sum(past) + 10.0) / (len(past) + 20.0))


def test_history_keeps_rows_with_null_keys(spark):
    rows = [(i, dt.datetime(2020, 1, 1 + i), 0, 1, None if i % 2 else "a", "x", None) for i in range(8)]
    df = history.with_label_time(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: (r.hist_mode_n, r.hist_country_n) for r in history.add_history(df, 0.5).collect()}
    assert got == {i: (i // 2, i) for i in range(8)}
    assert history.add_history(df.limit(0), 0.5).collect() == []


def test_interval_join_equals_running_sums(orders):
    _, df = orders
    for keys in history.HISTORY_KEYS.values():
        want = {(tuple(str(r[k]) for k in keys), r.order_date): (r.cum_late, r.cum_n) for r in history.known_before(df, keys).collect()}
        got = {(tuple(r.key), r.order_date): (r.late, r.n) for r in history.history_by_cells(df, keys).collect()}
        assert got == want


def test_audit_passes_honest_history_and_finds_leaks(orders):
    _, df = orders
    cut = dt.datetime(2020, 2, 1)
    honest = history.add_history(df, 0.5)
    for r in history.leakage_audit(honest, df, cut, 0.5).collect():
        assert r.n_checked > 50 and r.n_changed == 0
    flipped = df.withColumn("late", F.when(F.col("label_known_at") >= F.lit(cut.isoformat()).cast("timestamp_ntz"), 1 - F.col("late")).otherwise(F.col("late")))
    assert all(r.n_changed == 0 for r in history.leakage_audit(history.add_history(flipped, 0.5), df, cut, 0.5).collect())
    same_instant = history.add_history(df.withColumn("order_date", F.col("order_date") + F.expr("INTERVAL 1 SECOND")), 0.5).withColumn("order_date", F.col("order_date") - F.expr("INTERVAL 1 SECOND"))
    assert all(r.n_changed > 0 for r in history.leakage_audit(same_instant, df, cut, 0.5).collect())
    whole = honest.withColumn("hist_mode_rate", F.avg("late").over(history.W.partitionBy("shipping_mode")))
    assert {r.name: r.n_changed > 0 for r in history.leakage_audit(whole, df, cut, 0.5).collect()} == {"hist_mode": True, "hist_mode_region": False, "hist_country": False}


def test_split_is_purged(orders):
    _, df = orders
    vs, ts = dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 20)
    rows = df.withColumn("split", history.split_column(vs, ts)).collect()
    for r in rows:
        if r.split == "train":
            assert r.order_date < vs and r.label_known_at < vs
        elif r.split == "valid":
            assert vs <= r.order_date < ts and r.label_known_at < ts
        elif r.split == "test":
            assert r.order_date >= ts
    assert {r.split for r in rows} == {"train", "valid", "test", None}


def test_metrics_equal_definitions(spark):
    rnd = np.random.default_rng(2)
    y, p = rnd.integers(0, 2, 300), np.round(rnd.random(300), 2)
    df = spark.createDataFrame([("m", "test", int(a), float(b)) for a, b in zip(y, p)] + [("c", "test", int(a), 0.4) for a in y], "model string, split string, y int, p double")
    r = {x.model: x for x in forecast.metrics(df).collect()}
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert r["m"].roc_auc == pytest.approx(auc, abs=1e-4) and r["c"].roc_auc == 0.5
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        ap, last = ap + (recall - last) * precision, recall
    assert r["m"].pr_auc == pytest.approx(ap, abs=1e-4)
    q = np.clip(p, 1e-6, 1 - 1e-6)
    assert r["m"].brier == pytest.approx(np.mean((q - y) ** 2), abs=1e-4)
    assert r["m"].log_loss == pytest.approx(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)), abs=1e-4)
    assert r["m"].accuracy == pytest.approx(np.mean((p >= 0.5) == y), abs=1e-4) and r["m"].n == 300


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_medians_are_exact(spark, n):
    v = np.random.default_rng(n).exponential(size=n).round(3)
    df = spark.createDataFrame([(float(x), float(i % 3)) for i, x in enumerate(v)], "a double, b double")
    got = {r.name: r.value for r in forecast.medians(df, ("a", "b")).collect()}
    assert got["a"] == pytest.approx(np.median(v)) and got["b"] == np.median([i % 3 for i in range(n)])


def test_ranks_are_found_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(forecast, "BINS", 8)
    monkeypatch.setattr(forecast, "BRACKET", 5)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.exponential(size=700), [1e308, -1e308, 0.0], np.full(500, 2.5)])
    df = spark.createDataFrame([(float(x), None if i % 3 else float(i)) for i, x in enumerate(v)], "a double, b double")
    ranks = [0, 1, 600, 700, 1000, len(v) - 1]
    assert forecast.nth_values(df, {"x": [("a", r) for r in ranks], "y": [("b", 10)]}) == {"x": [np.sort(v)[r] for r in ranks], "y": [30.0]}
    assert forecast.medians(df.limit(0), ("a",)).collect() == []
    assert forecast.medians(spark.createDataFrame([(None, 1.0)], "a double, b double"), ("a", "b")).collect() == [("b", 1.0)]


def test_linear_contributions_add_up(spark, sf_dir):
    from laneguard.plans.domain import Domain

    d = Domain(spark, sf_dir)
    model = forecast.fit_logistic(forecast.fold_rare(d.train, d.common), max_iter=10)
    test = forecast.fold_rare(d.dataset.filter("split = 'test'"), d.common)
    out = forecast.contributions(model, test).select("logit", F.element_at(forecast.vector_to_array("rawPrediction"), 2).alias("raw"))
    worst = out.agg(F.max(F.abs(F.col("logit") - F.col("raw")))).first()[0]
    assert worst < 1e-6
    drivers = forecast.top_drivers(forecast.contributions(model, test)).first()
    assert len(drivers.drivers) == 3 and drivers.text.startswith("Late-delivery risk")


def test_patience_outlasts_a_miss():
    assert forecast.patient_best([5, 4, 4.5, 4.2, 3, 3.1, 3.2, 3.3, 1], 3) == (5, True)
    assert forecast.patient_best([5, 4, 4.5, 3], 3) == (4, False)
    assert forecast.patient_best([5, 5, 5, 5], 3) == (1, True)


def test_boosted_rounds_end_by_patience(spark, sf_dir):
    from laneguard.plans.domain import Domain

    d = Domain(spark, sf_dir)
    asked = []
    fit = forecast.GBTClassifier.fit

    class Counted(forecast.GBTClassifier):
        def fit(self, rows):
            asked.append(self.getMaxIter())
            return fit(self, rows)
    old, forecast.GBTClassifier = forecast.GBTClassifier, Counted
    try:
        model = forecast.fit_boosted(d.dataset, rounds=12, step=0.3, patience=3)
    finally:
        forecast.GBTClassifier = old
    valid = model.transform(d.dataset.filter("split = 'valid'")).drop("prediction", "probability", "rawPrediction")
    valid = valid.withColumn(forecast.TARGET, F.col(forecast.TARGET).cast("double"))
    losses = model.stages[-1].evaluateEachIteration(valid)
    assert asked[0] == 6 and len(set(asked)) == len(asked) and model.stages[-1].getNumTrees <= asked[-1]  # no fit is repeated to be cut
    assert len(losses) == model.stages[-1].getNumTrees and min(losses) == losses[-1]


def test_lane_countries_use_the_names_of_the_order_history(spark):
    lanes = spark.createDataFrame([("a", "NLRTM"), ("b", "deham"), ("c", "XXABC"), ("d", None)], "lane_id string, destination string")
    train = spark.createDataFrame([("Alemania", "Western Europe"), ("Alemania", "Western Europe"), ("Alemania", "Elsewhere"), ("India", "South Asia")], "order_country string, order_region string")
    named = forecast.lane_countries(lanes)
    got = named.join(forecast.country_regions(train), "order_country", "left").collect()
    assert {r["lane_id"]: (r["order_country"], r["order_region"]) for r in got} == {
        "a": ("Países Bajos", None), "b": ("Alemania", "Western Europe"), "c": (None, None), "d": (None, None)}


def test_history_and_audit_never_broadcast_what_grows_with_the_orders(orders):
    _, df = orders
    cut = dt.datetime(2020, 2, 1)
    featured = history.add_history(df, 0.5)
    for rows in (featured, history.history_by_cells(df, ("shipping_mode",), cut), history.leakage_audit(featured, df, cut, 0.5)):
        joins = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin" in line or "NestedLoop" in line]
        assert all("part#" in line for line in joins)  # only the one row per range of running_history


def test_train_lines_are_the_train_rows_without_history(spark, sf_dir):
    from laneguard.plans.domain import Domain

    d = Domain(spark, sf_dir)
    plain = d.train_lines
    whole = d.train.select(*plain.columns)
    assert whole.exceptAll(plain).isEmpty() and plain.exceptAll(whole).isEmpty() and plain.count() > 0
    assert "history-marks" not in "".join(plain.inputFiles()) and "history-marks" in "".join(d.featured.inputFiles())


def test_logistic_finds_the_minimum_in_few_passes(spark, sf_dir, monkeypatch):
    from laneguard.plans.domain import Domain

    d = Domain(spark, sf_dir)
    train = d.folded.filter("split = 'train'")
    passes, sums = [], forecast._newton_sums
    monkeypatch.setattr(forecast, "_newton_sums", lambda *a: passes.append(1) or sums(*a))
    model = forecast.fit_logistic(train)
    assert 2 <= len(passes) <= 20
    x = np.array([r[0].toArray() for r in model.transform(train).select("features").collect()])
    y = np.array([float(r[0]) for r in train.select("late").collect()])
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) + w
    assert np.abs(slope).max() < 1e-3 * len(y) ** 0.5  # the slope of the summed loss with its penalty is gone
    monkeypatch.setattr(forecast, "NEWTON_SIZE", 0)  # MLlib minimizes the same function
    other = forecast.fit_logistic(train)
    p = [np.array([r["p"] for r in forecast.probability(m, train).select("p").collect()]) for m in (model, other)]
    assert np.abs(p[0] - p[1]).max() < 0.01


def test_boosted_trees_do_not_learn_from_days_with_quick_outcomes_only(spark):
    """The last training days hold the orders with a quick outcome alone; later orders must not be judged by them."""
    rng = np.random.default_rng(8)
    start, end = dt.datetime(2020, 1, 1), dt.datetime(2020, 3, 1)
    rows = []
    for i in range(6000):
        placed = start + dt.timedelta(hours=int(i * 90 * 24 / 6000))
        days = int(rng.integers(1, 8))
        known = placed + dt.timedelta(days=days)
        split = "train" if known < end else "valid" if placed >= end else None
        if split:
            numbers = {c: 0.0 for c in (*forecast.NUMERIC, *forecast.HISTORY)} | {"hist_mode_n": float(i), "quantity": float(rng.integers(1, 9))}
            rows.append({"split": split, "order_date": placed, "label_known_at": known, "late": int(days > 2), **{c: "x" for c in forecast.CATEGORICAL}, **numbers})
    data = spark.createDataFrame(rows).withColumn("order_date", F.col("order_date").cast("timestamp_ntz")).withColumn("label_known_at", F.col("label_known_at").cast("timestamp_ntz"))
    settled = forecast.settled_orders(data.filter("split = 'train'"))
    assert settled.agg(F.max("order_date")).first()[0] < end - dt.timedelta(days=6)
    before = data.filter(F.col("order_date") < F.lit(end - dt.timedelta(days=8)).cast("timestamp_ntz"))
    assert settled.count() >= before.count() > 3000  # no other order is left out
    assert forecast.settled_orders(data.limit(0)).isEmpty()
    p = forecast.probability(forecast.fit_boosted(data, rounds=3, step=0.3, patience=1), data.filter("split = 'valid'"))
    assert p.agg(F.min("p")).first()[0] > 0.5  # five of seven are late


def test_block_trees_are_those_of_mllib(spark, monkeypatch):
    """Without drawing rows and features nothing is left to chance: the same trees, over several blocks and checkpoints."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    monkeypatch.setattr(boosting, "BLOCK", 700)
    monkeypatch.setattr(boosting, "CUT", 2)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(5000):
        a, b, x, z = rng.choice(list("pqrst")), rng.choice(list("uvw")), float(rng.integers(0, 40)), float(rng.integers(-3, 9)) / 4
        odds = {"p": -2, "q": 1, "r": 0, "s": 2, "t": -1}[a] + (b == "v") * 1.5 + np.sin(x / 6) - z
        rows.append((a, b, x, z, float(rng.random() < 1 / (1 + np.exp(-odds)))))
    data = spark.createDataFrame(rows, "a string, b string, x double, z double, late double").repartition(3)
    stages = Pipeline(stages=[StringIndexer(inputCols=["a", "b"], outputCols=["ai", "bi"], handleInvalid="keep"), VectorAssembler(inputCols=["ai", "bi", "x", "z"], outputCol="features")]).fit(data)
    data = stages.transform(data)
    est = GBTClassifier(labelCol="late", maxIter=6, stepSize=0.3, maxDepth=4, maxBins=64, minInstancesPerNode=20, featureSubsetStrategy="all", subsamplingRate=1.0, seed=1)
    ours = boosting.fit_blocks(est, data, None, [6, 4], ["x", "z"], 5000, 3, forecast.patient_best)
    theirs = est.fit(data)
    assert ours.getNumTrees == 6 and ours.treeWeights == theirs.treeWeights and ours.totalNumNodes == theirs.totalNumNodes
    p = [np.array([r[0][1] for r in m.transform(data).select("probability", "a", "b", "x", "z").orderBy("a", "b", "x", "z").collect()]) for m in (ours, theirs)]
    assert np.abs(p[0] - p[1]).max() < 1e-4 and p[0].std() > 0.1
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.01)


def test_large_tables_are_boosted_without_mllib_fits(spark, sf_dir, monkeypatch, tmp_path):
    from pyspark.ml import PipelineModel

    from laneguard.plans.domain import Domain

    monkeypatch.setattr(forecast, "MLLIB_ROWS", 0)
    monkeypatch.setattr(forecast.GBTClassifier, "fit", None)
    d = Domain(spark, sf_dir)
    grown = []
    grow = boosting.boosted_trees
    monkeypatch.setattr(boosting, "boosted_trees", lambda *a: grown.append(grow(*a)) or grown[0])
    model = forecast.fit_boosted(d.dataset, rounds=40, step=0.3, patience=4)
    trees, losses = grown[0]
    best, settled = forecast.patient_best(losses, 4)
    assert settled and len(trees) == len(losses) < 40 and best + 4 <= len(trees) < best + 4 + boosting.LOOK
    model.write().save(f"{tmp_path}/m")
    for m in (model, PipelineModel.load(f"{tmp_path}/m")):
        valid = m.transform(d.dataset.filter("split = 'valid'")).drop("prediction", "probability", "rawPrediction")
        valid = valid.withColumn(forecast.TARGET, F.col(forecast.TARGET).cast("double"))
        own = m.stages[-1].evaluateEachIteration(valid)  # MLlib's own losses of the same trees
        assert len(own) == best == m.stages[-1].getNumTrees
        assert np.allclose(own, np.array(losses[:best]) / valid.count(), atol=1e-5) and own[-1] < 2 * np.log(2)


def test_bins_and_bundles_lose_nothing(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 5, 3000), rng.integers(0, 3, 3000), rng.integers(0, 30, 3000) / 7, rng.normal(size=3000)], 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    few, many = boosting.cut_points(df, ["c", "d"], 64)
    assert len(few) == 29 and np.all(np.searchsorted(few, x[:, 2]) == np.unique(x[:, 2], return_inverse=True)[1])
    assert 60 <= len(many) <= 63 and np.bincount(np.searchsorted(many, x[:, 3])).max() < 3000 / 64 * 1.3
    sizes = (6, 3, 30, len(many) + 1)
    b = boosting.Binning((None, None, few, many), sizes, boosting.bundled(sizes, 200))
    assert sorted(f for g in b.bundles for f in g) == [0, 1, 2, 3] and len(b.bundles) < 4
    bins = np.stack([x[:, 0], x[:, 1], np.searchsorted(few, x[:, 2]), np.searchsorted(many, x[:, 3])], 1).astype(int)
    codes, y = b.encode(x), rng.normal(size=3000)
    cells = boosting._empty(b)
    boosting._count(codes, np.arange(3000), y, b, cells)
    got = boosting._per_bin(cells, b)
    for f, size in enumerate(sizes):
        assert np.allclose(got[:, b.starts[f]:b.starts[f + 1]], [np.bincount(bins[:, f], minlength=size), np.bincount(bins[:, f], y, size)])
        right = rng.random(size) < 0.5
        k, table = b.table(f, right)
        assert np.array_equal(table[codes[k]], right[bins[:, f]])


def test_comparison_and_unseen_countries_compute_the_history_once(spark, sf_dir):
    from laneguard.plans import order_queries
    from laneguard.plans.domain import Domain

    d = Domain(spark, sf_dir)
    d.__dict__["trees"] = forecast.fit_boosted(d.folded.filter("split <> 'test'"), rounds=2, step=0.3, patience=1)
    d.__dict__["linear"] = forecast.fit_logistic(d.folded.filter("split = 'train'"), max_iter=2)
    compared, strange = order_queries.comparison(d).collect(), order_queries.unseen(d).collect()
    assert "dataset" not in d.__dict__
    whole = forecast.metrics(forecast.mode_history_scores(d.dataset)).collect()
    assert sorted(r for r in compared if r["model"] == "mode_history") == sorted(whole) and len(compared) == 8
    modes = d.dataset.filter("split = 'test'").groupBy("shipping_mode").count().collect()
    assert sorted((r["shipping_mode"], r["n"], r["valid"]) for r in strange) == sorted((r["shipping_mode"], r["count"], True) for r in modes)
