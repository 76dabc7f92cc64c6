"""Registered queries against their check SQL on the smallest driver tables, and contract checks."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.check_oracle import TABLES, norm

QUICK = ("a04_parse_article_lists", "a05_parse_exports", "a06_ingest_merge", "b06_headline", "b12_industries", "b22_get_event", "b28_purged_split", "b31_reply_records",
         "b36_keyword_extract", "c11_pit_history", "c20_integrity", "d01_lane_exposure", "d05_extraction_prf", "d20_weather_level", "e02_round_robin", "e04_sliding_lookback",
         "e08_last_wins", "i02_lane_routes", "k04_ground_brief")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(spark, sf_dir, name):
    df = entry_point.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_check_sql(spark, sf_dir, con, name):
    cols, got = rows_of(spark, sf_dir, name)
    rel = con.execute(entry_point.oracle_sql()[name])
    have = [c[0] for c in rel.description]
    assert sorted(have) == cols
    assert got == sorted(tuple(norm(r[have.index(c)]) for c in cols) for r in rel.fetchall())


def test_every_check_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_has_rows(spark, sf_dir):
    df = entry_point.entry(spark)
    assert df.columns[0] == "lane_id" and df.count() > 0


def test_results_do_not_depend_on_the_number_of_partitions(spark, sf_dir):
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows_of(spark, sf_dir, "d08_replay_v1"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
