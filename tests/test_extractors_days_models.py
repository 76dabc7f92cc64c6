import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from laneguard import schemas
from laneguard.operators import extraction, forecast, models
from laneguard.sources import days


def news(spark, n=30):
    rows = [(f"n{i}", f"title {i}", "text", f"http://x/{i}", "src", dt.datetime(2024, 1, 1 + i % 5, 10), "manual", "en", None) for i in range(n)]
    return spark.createDataFrame(rows, schemas.NEWS)


def echo_model():
    def replies(items):
        if len(items) > 1 and any(x["id"] == "n7" for x in items):
            raise RuntimeError("whole batch refused")
        out = []
        for x in items:
            if x["id"] == "n7":
                raise ValueError("cannot read n7")
            event = {"event_type": "strike", "location": "Cork", "country_code": "ie", "severity": 9 if x["id"] == "n8" else 2, "confidence": 0.5}
            out.append(None if x["id"] == "n9" else "no json" if x["id"] == "n10" else json.dumps({"is_disruption": True, "events": [event]}))
        return out

    return replies


def test_a_failing_item_fails_alone(spark):
    got = {r.news_id: r for r in extraction.run_extraction(news(spark), lambda x: extraction.batch_records(x, echo_model, "m", "v")).collect()}
    assert len(got) == 30
    bad = {k: r.error for k, r in got.items() if r.status == "failed"}
    assert bad == {"n7": "ValueError: cannot read n7", "n8": "event outside the schema", "n9": "reply is NoneType, not text", "n10": "no valid JSON object"}
    fine = got["n1"]
    assert fine.is_disruption and fine.events[0].event_type == "labor_strike" and fine.events[0].country_code == "IE" and fine.events[0].news_id == "n1" and fine.model == "m"
    assert extraction.batch_records(news(spark).limit(0), echo_model, "m", "v").collect() == []


def test_a_model_with_too_few_replies_is_asked_one_by_one(spark):
    got = extraction.batch_records(news(spark, 3), lambda: lambda items: ['{"is_disruption": false, "events": []}'], "m", "v").collect()
    assert [r.status for r in got] == ["ok"] * 3


def test_other_columns_are_refused(spark):
    with pytest.raises(TypeError, match="events"):
        extraction.run_extraction(news(spark), lambda x: extraction.keyword_records(x).drop("events"))
    with pytest.raises(TypeError, match="status"):
        extraction.run_extraction(news(spark), lambda x: extraction.keyword_records(x).withColumn("status", F.lit(1)))


def asked(spark, first=1, last=7, gone=(3,)):
    return spark.createDataFrame([(dt.date(2024, 1, i), i not in gone) for i in range(first, last + 1)], "day date, landed boolean")


def test_finished_days_are_not_computed_again(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []
    items = news(spark).withColumn("day", F.to_date("published"))

    def extract(x):
        calls.append(sorted(r.id for r in x.select("id").collect()))
        return extraction.batch_records(x, echo_model, "m", "v")

    assert {r.day.day for r in days.finish_days(items, asked(spark, 1, 2), extract, path).collect()} == {1, 2}
    assert {r.day.day for r in days.finish_days(items, asked(spark), extract, path).collect()} == {3, 4, 5, 6, 7}
    assert not set(calls[0]) & set(calls[1])
    log = {r.day.day: (r.status, r.items, r.failed) for r in days.load_manifest(spark, path).collect()}
    assert log == {1: ("ok", 6, 1), 2: ("ok", 6, 0), 3: ("missing", 0, 0), 4: ("ok", 6, 1), 5: ("ok", 6, 1), 6: ("no_items", 0, 0), 7: ("no_items", 0, 0)}
    assert {r.day.day for r in days.finish_days(items, asked(spark), extract, path).collect()} == {3}  # only the missing day is tried again
    assert calls[2:] == [[]]
    assert {r.day.day for r in days.finish_days(items, asked(spark, gone=()), extract, path).collect()} == {3}
    assert days.finish_days(items, asked(spark, gone=()), extract, path).isEmpty() and len(calls) == 4
    total = days.day_totals(days.load_manifest(spark, path)).first()
    assert (total.total, total.missing, total["items"], total.failed) == (7, "2024-01-06,2024-01-07", 30, 4)
    assert days.load_days(spark, path).count() == 30


def test_an_interrupted_run_leaves_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "store")
    items = news(spark).withColumn("day", F.to_date("published"))
    extract = lambda x: extraction.batch_records(x, echo_model, "m", "v")
    half = extract(items.filter("id < 'n2'").drop("day")).join(items.select(F.col("id").alias("news_id"), "day"), "news_id")
    days._replace_days(half.select(*days.RECORD_COLUMNS, "day"), f"{path}/{days.RECORDS}")  # records without their manifest
    assert days.load_days(spark, path).isEmpty() and days.load_manifest(spark, path).isEmpty()
    days.finish_days(items, asked(spark), extract, path)
    assert days.load_days(spark, path).groupBy("news_id").count().filter("count > 1").isEmpty()


def test_models_are_fitted_once_per_data_and_settings(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer

    calls = []

    def fit(df):
        calls.append(1)
        return Pipeline(stages=[StringIndexer(inputCol="a", outputCol="i")]).fit(df)

    data = spark.createDataFrame([("x", 1.0), ("y", None), ("x", 2.0)], "a string, v double")
    folder = str(tmp_path / "models")
    first = models.fit_once("m", data, {"k": 1}, fit, folder)
    again = models.fit_once("m", data.repartition(3).select("v", "a"), {"k": 1}, fit, folder)
    assert len(calls) == 1 and first.transform(data).collect() == again.transform(data).collect()
    models.fit_once("m", data, {"k": 2}, fit, folder)
    models.fit_once("m", data.unionAll(data.limit(1)), {"k": 1}, fit, folder)
    assert len(calls) == 3


def test_cut_model_equals_its_first_rounds(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(400).selectExpr("double(id % 20) AS x", "double(id % 7) AS z", "double((id % 20 > 9) != (id % 11 = 0)) AS late")
    rows = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(rows)
    whole = forecast.GBTClassifier(labelCol="late", maxIter=8, seed=1).fit(rows)
    short = forecast.first_rounds(whole, 3)
    assert short.getNumTrees == 3
    p = [r["probability"][1] for r in short.transform(rows).select("probability").collect()]
    assert len(set(p)) > 1
    assert short.evaluateEachIteration(rows) == pytest.approx(whole.evaluateEachIteration(rows)[:3])


def test_explanations_name_values(spark):
    data = spark.createDataFrame([("Standard Class", 4.0, 1234.5)], "shipping_mode string, days_scheduled double, sales double")
    filled = data.select("*", *[F.lit("x" if c in forecast.CATEGORICAL else 0.25).alias(c) for c in forecast.FEATURE_NAMES if c not in data.columns])
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("contribution")) for f, c in (("sales", -0.5), ("shipping_mode", 1.25), ("hist_mode_rate", 0.75), ("market", 0.1))])
    text = forecast.top_drivers(filled.withColumn("contributions", parts).withColumn("base", F.lit(0.0)).withColumn("logit", F.lit(1.6))).first().text
    assert text == ("Late-delivery risk 83% (model baseline 50%). Main drivers: shipping mode = Standard Class raises risk (+1.25 log-odds); "
                    "recent late rate for this shipping mode = 0.25 raises risk (+0.75 log-odds); order value = 1,235 lowers risk (-0.50 log-odds).")
