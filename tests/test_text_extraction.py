import datetime as dt
import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from laneguard.functions import text as tx
from laneguard.operators import evaluation, extraction, ingest, linking, store
from laneguard.sources import news, tables


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_item_id_ignores_case_and_spaces(spark):
    url = " https://Example.com/A "
    assert one(spark, url, tx.item_id) == hashlib.sha1(url.strip().lower().encode()).hexdigest()[:16]


@pytest.mark.parametrize("raw", ["<p>Ports &amp; <b>ships</b>&nbsp;&eacute; x</p>", "a &lt;b&gt; c", "  plain\n\ttext  ", "&#8217;s <br/> &copy;", ""])
def test_clean_html(spark, raw):
    want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", raw))).strip()
    assert one(spark, raw, tx.clean_html) == want


@pytest.mark.parametrize(("url", "want"), [
    ("https://a.com/news/2021/mega-ship-blocks-suez-123.html", "mega ship blocks suez"), ("https://a.com/x-y/u-v", "x y"), ("https://a.com/", ""),
    ("http://a.com/one_two+three?q=long-query-string", "one two three"), ("https://a.com/amp/index-of-the-article.php", "of the"),
])
def test_headline(spark, url, want):
    assert one(spark, url, tx.headline_from_url) == want


@pytest.mark.parametrize(("url", "want"), [
    ("https://a.com/big-port-strike", True), ("https://a.com/support-report", False), ("https://a.com/red-sea-news", True), ("https://port.com/x", False)])
def test_on_topic(spark, url, want):
    assert one(spark, url, tx.is_logistics_url) is want


def test_place_names(spark):
    assert one(spark, "The Port of Córk!", tx.link_name) == "cork"
    assert one(spark, "Bab-el-Mandeb & Łódź", tx.link_name) == "bab el mandeb and odz"
    assert one(spark, "the Port of  Felixstowe", tx.eval_name) == "felixstowe"


def test_feeds_skip_undated_and_broken(spark):
    rss = ("<rss><channel><language>en-us</language><item><title>A &amp; B</title><link>http://x/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0200</pubDate>"
           "</item><item><title>no date</title><link>http://x/2</link></item></channel></rss>")
    atom = '<feed><entry><title>t</title><link href="http://x/3"/><updated>2024-01-05T06:07:08Z</updated></entry></feed>'
    docs = spark.createDataFrame([("s", rss), ("s", atom), ("s", "<rss><chan"), ("s", "oops")], "source string, value string")
    rows = {r.url: r for r in news.parse_feeds(docs).collect()}
    assert set(rows) == {"http://x/1", "http://x/3"}
    assert (rows["http://x/1"].title, str(rows["http://x/1"].published), rows["http://x/1"].language) == ("A & B", "2024-01-02 08:00:00", "en")
    assert str(rows["http://x/3"].published) == "2024-01-05 06:07:08"


def test_merge_prefers_fresh_and_missing_store_is_empty(spark, tmp_path):
    cols = "id string, title string, summary string, url string, source string, published timestamp_ntz, origin string, language string, source_country string"
    row = lambda title, url, day: (one(spark, url, tx.item_id), title, "", url, "s", __import__("datetime").datetime(2024, 1, day), "rss", "en", None)
    fresh = spark.createDataFrame([row("new", "http://a/x", 2)], cols)
    path = str(tmp_path / "store")
    assert news.load_items(spark, path).count() == 0
    news.save_items(spark.createDataFrame([row("old", "HTTP://A/x", 1), row("other", "http://a/y", 1)], cols), path)
    got = ingest.merge(fresh, news.load_items(spark, path)).orderBy("title").collect()
    assert [r.title for r in got] == ["new", "other"]


@pytest.mark.parametrize(("text", "want"), [
    ("Ship stuck in Suez Canal for weeks", ("canal_or_strait_blockage", "Suez Canal", "EG", None, 4)),
    ("Drone strike near the Red Sea", ("conflict_or_attack", "Red Sea", None, None, 2)),
    ("Dockworkers walkout in Rotterdam, days of delay", ("labor_strike", "Rotterdam", "NL", "NLRTM", 3)),
    ("Bab-el-Mandeb attack worldwide", ("conflict_or_attack", "Bab-El-Mandeb", None, None, 5)), ("Storm nowhere", None), ("Hamburg is fine", None)])
def test_keyword_rules(spark, text, want):
    got = one(spark, text, extraction.keyword_match)
    assert (tuple(got) if got else None) == want


def test_replies(spark):
    good = '{"event_type": "Strike", "location": "Port A", "country_code": "gb", "port_code": "GB FXT", "severity": 3, "start_date": "unknown", "industries": ["Cars ", "cars"], "confidence": 0.7}'
    bad = good.replace('"severity": 3', '"severity": 9')
    rows = [("1", f'```json\n{{"is_disruption": true, "events": [{good}]}}\n```'), ("2", f'Sure: {{"is_disruption": false, "events": [{good}]}} bye'),
            ("3", f'{{"is_disruption": true, "events": [{good}, {bad}]}}'), ("4", "no json"), ("5", '{"is_disruption": true, "events": [')]
    items = spark.createDataFrame([(i, r, "u", "s") for i, r in rows], "id string, reply string, url string, source string").withColumn("published", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.news_id: r for r in extraction.reply_records(items, "m", "v").collect()}
    assert [got[i].status for i in "12345"] == ["ok", "ok", "failed", "failed", "failed"]
    e = got["1"].events[0]
    assert (e.event_type, e.country_code, e.port_code, e.severity, e.start_date, e.industries) == ("labor_strike", "GB", "GBFXT", 3, None, ["cars"])
    assert e.event_id == hashlib.sha1(b"1|0|m|v").hexdigest()[:16]
    assert got["2"].events == [] and got["2"].is_disruption is False  # the flag beats the list


def test_scorer_on_a_hand_made_set(spark):
    ev = "array<struct<event_type: string, location: string, country_code: string, port_code: string, severity: int>>"
    gold = spark.createDataFrame([
        ("A", True, [("conflict_or_attack", "Red Sea", None, None, 5)], None), ("B", True, [("labor_strike", "Port of Felixstowe", "GB", "GBFXT", 3)], None),
        ("C", False, [], None), ("D", True, [("severe_weather", "Chennai", "IN", "INMAA", 3)], None)], f"news_id string, is_disruption boolean, events {ev}, label_source string")
    pred = spark.createDataFrame([
        ("A", "ok", True, [("conflict_or_attack", "the Red Sea", None, None, 4)]), ("B", "ok", True, [("port_closure", "Felixstowe", "GB", None, 3)]),
        ("C", "ok", True, [("other", "Dublin", "IE", "IEDUB", 1)]), ("D", "failed", False, [])], f"news_id string, status string, is_disruption boolean, events {ev}")
    pairs = evaluation.joined_predictions(gold, pred)
    f = {r.field: r for r in evaluation.prf(pairs).collect()}
    assert (f["is_disruption"].precision, f["is_disruption"].recall) == (0.667, 0.667)
    assert (f["event_type"].precision, f["country_code"].recall, f["port_code"].f1, f["port_code"].support, f["location"].f1) == (0.333, 0.5, 0.0, 2, 0.667)
    assert tuple(evaluation.severity_stats(evaluation.severity_pairs(pairs)).first()) == (2, 0.5, 1.0, 0.5)
    assert tuple(evaluation.outcome_counts(pairs).first()) == (4, 1, 0)


def test_sheet_round_trip(spark, tmp_path):
    from laneguard.schemas import SHEET_COLUMNS

    text = "news_id,title,is_disruption,event_type,location,severity,label_source\nn1,\"a, \"\"b\"\"\",Yes,labor_strike,X,3,\nn1,a,yes,accident,Y,,\nn2,b,,,,,\nn3,c,no,,,,edited\nn4,d,yes,accident,Z,1,draft_unconfirmed\n"
    (tmp_path / "s.csv").write_text("﻿" + text, encoding="utf-8")
    rows = tables.load_sheet(spark, str(tmp_path / "s.csv"))
    assert rows.columns == list(SHEET_COLUMNS) and rows.first().title == 'a, "b"'
    gold = {r.news_id: r for r in evaluation.sheet_to_gold(rows.withColumn("pos", F.monotonically_increasing_id())).collect()}
    assert set(gold) == {"n1", "n3"} and [e.location for e in gold["n1"].events] == ["X", "Y"] and gold["n1"].events[1].severity is None
    assert gold["n3"].is_disruption is False and gold["n3"].label_source == "edited"


LINKS = [  # place, country, port code -> node, method
    ("Nhava", "IN", "INNSA", "INNSA", "port_code"), ("Somewhere", "IN", "INXXX", "CTRY:IN", "country"), ("Yanbu port", "SA", "INNSA", None, "none"),
    ("Strait of Hormuz", None, None, "HORMUZ", "alias_exact"), ("Port of Rotterdam", "NL", None, "NLRTM", "alias_exact"), ("Hormuz Strait", None, None, "HORMUZ", "alias_within"),
    ("southern Red Sea near Yemen", None, None, "YEMEN_COAST", "alias_within"), ("Rotterdm", None, None, "NLRTM", "fuzzy"), ("", None, None, None, "none"), ("Röttérdam", "NL", None, "NLRTM", "alias_exact"),
]


def test_link_cases_and_fuzzy_bound(spark):
    ports = spark.createDataFrame([(0, "INNSA", "IN", "Nhava Sheva", ["Mumbai"]), (1, "NLRTM", "NL", "Rotterdam", ["Europoort"])], "pos int, node_id string, country_code string, name string, aliases array<string>")
    ways = spark.createDataFrame([(0, "HORMUZ", "Hormuz", ["Strait of Hormuz"]), (1, "RED_SEA", "Red Sea", ["Red Sea"])], "pos int, node_id string, name string, aliases array<string>")
    extra = spark.createDataFrame([(0, "Southern Red Sea", "YEMEN_COAST"), (1, "Mumbai", "RED_SEA")], "pos int, alias string, node_id string")
    aliases = linking.alias_table(ports, ways, extra)
    assert {r.alias: r.node_id for r in aliases.collect()}["mumbai"] == "RED_SEA"  # the extra list overrides
    mentions = spark.createDataFrame([c[:3] for c in LINKS], "location string, country_code string, port_code string")
    places = linking.distinct_places(mentions)
    got = {(r.location, r.country_code, r.port_code): (r.node_id, r.method)
           for r in linking.link_mentions(mentions, linking.link_places(places, ports.select("node_id", "country_code"), aliases), places).collect()}
    for place, cc, pc, node, method in LINKS:
        assert got[place, cc, pc] == (node, method)


@pytest.mark.parametrize("measure", ["difflib", "edit"])
def test_similar_alias_equals_all_pairs(spark, measure):
    import difflib
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(2, 14))).strip() or "a" for _ in range(120)]
    twist = lambda w: w[: (k := rnd.randint(0, len(w) - 1))] + rnd.choice(["", "x", "aa"]) + w[k + 1:]
    locs = sorted({x for x in (twist(w) for w in words) if x})
    names = sorted(set(words))
    lev = lambda a, b: spark_lev[a, b]
    places = spark.createDataFrame([(x, x) for x in locs], "place_id string, loc string")
    aliases = spark.createDataFrame([(n, n) for n in names], "alias string, node_id string")
    spark_lev = {(r.loc, r.alias): r.s for r in places.crossJoin(aliases).select("loc", "alias", linking.edit_ratio(F.col("loc"), F.col("alias")).alias("s")).collect()} if measure == "edit" else {}
    sim = lev if measure == "edit" else (lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())
    want = {}
    for a in locs:
        s, n = max((sim(a, n), n) for n in names)
        if s >= linking.FUZZY_THRESHOLD:
            want[a] = n
    got = {r.place_id: r.matched_alias for r in linking.by_similar_alias(places, aliases, measure).collect()}
    assert got == want and want


def test_search_and_last_wins(spark):
    import datetime as dt

    rows = [(f"e{i}", "Red Sea" if i % 2 else "Cork", "storm" if i == 3 else "", "accident", i, dt.datetime(2024, 1, 1 + i)) for i in range(1, 6)]
    ev = spark.createDataFrame(rows, "event_id string, location string, summary string, event_type string, severity int, published timestamp_ntz")
    ids = lambda df: [r.event_id for r in df.collect()]
    assert ids(store.search(ev, "the recent news")) == ["e5", "e4", "e3", "e2", "e1"]  # filler only: no text filter
    assert ids(store.search(ev, "storm in cork", min_severity=3)) == ["e4", "e3"]
    assert ids(store.search(ev, "red", until=dt.datetime(2024, 1, 4), limit=1)) == ["e3"]
    twice = ev.withColumn("n", F.lit(0)).unionByName(ev.filter("event_id = 'e1'").withColumn("severity", F.lit(9)).withColumn("n", F.lit(1)))
    assert {r.event_id: r.severity for r in store.keep_last(twice, ["event_id"], ["n"]).collect()}["e1"] == 9


def test_clean_html_with_and_without_entities(spark):
    rows = [("<b>a</b>  b",), ("a &amp; b &lt;c&gt;",), ("&notin; &#8364;&nbsp;5",), (None,), ("",), ("&",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(tx.clean_html(F.col("t"))).collect()]
    assert got == ["a b", "a & b <c>", "∉ € 5", "", "", "&"]


def test_merge_of_some_columns_equals_the_whole_merge(spark):
    schema = "id string, title string, published timestamp, url string, origin string"
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    fresh = spark.createDataFrame([("x", "f1", at[1], "u1", "rss"), ("x", "f0", at[0], "u2", "web"), ("y", "f2", at[1], "u3", "web")], schema)
    store = spark.createDataFrame([("x", "s1", at[0], "u0", "manual"), ("z", "s2", at[2], "u4", "manual")], schema)
    whole = ingest.merge(fresh, store)
    assert sorted(whole.select("origin").collect()) == sorted(ingest.merge(fresh, store, ["origin"]).collect())
    assert sorted(whole.select("id", "title").collect()) == [("x", "f0"), ("y", "f2"), ("z", "s2")]


def test_merge_of_items_equal_in_the_order_does_not_depend_on_their_arrival(spark):
    schema = "id string, title string, published timestamp, url string, origin string"
    at = dt.datetime(2024, 1, 1)
    rows = [("x", "b", at, "u", "rss"), ("x", "a", at, "u", "web"), ("x", "c", at, "u", "rss"), ("y", None, at, "u", "rss"), ("y", "d", at, "u", "rss")]
    none = spark.createDataFrame([], schema)
    for arrival in (rows, rows[::-1]):
        got = ingest.merge(spark.createDataFrame(arrival, schema).coalesce(1), none)
        assert got.columns == ["id", "title", "published", "url", "origin"]
        assert sorted((r["id"], r["title"], r["origin"]) for r in got.collect()) == [("x", "a", "web"), ("y", None, "rss")]
