import io
import math
import random
import zipfile

from laneguard.functions.numeric import haversine_nm
from laneguard.operators import linking, spatial
from laneguard.operators.brief import nearest_alternate_port
from laneguard.operators.ranking import ranked
from laneguard.plans.catalog import QUERIES
from laneguard.plans.domain import Domain
from laneguard.sources import news
from pyspark.sql import functions as F


def test_archives_broken_ones_cost_only_themselves(spark, tmp_path):
    lines = [f"line {i} é" for i in range(10_000)]

    def archive(name, text, *more):
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, text)
            for m in more:
                z.writestr(m, "second member\n")
        return body.getvalue()

    good = archive("a.csv", "\n".join(lines).encode() + b"\r\nbad \xff byte\n", "b.csv")
    flipped = bytearray(good)
    flipped[200] ^= 255  # inside the compressed data: found by the check sum
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    for name, content in {"20240101.export.CSV.zip": good, "20240102.export.CSV.zip": good[:len(good) // 2], "20240103.export.CSV.zip": bytes(flipped),
                          "20240104.export.CSV.zip": b"not a zip", "20240105.export.CSV.zip": empty.getvalue(), "20240106.export.CSV.zip": archive("c", ""), "20240107.export.CSV.zip": b""}.items():
        (tmp_path / name).write_bytes(content)
    rows = news.read_archives(spark, str(tmp_path), "*.zip")
    got = [(str(r["day"]), r["value"]) for r in news.export_lines(rows).collect()]
    assert sorted(got) == sorted([("2024-01-01", x) for x in [*lines, "bad � byte"]])
    broken = news.broken_archives(rows).collect()
    assert sorted(str(r["day"])[-2:] for r in broken) == ["02", "03", "04", "05"]  # Spark does not list files without bytes
    assert all(r["error"] for r in broken)


def test_zip_exports_round_trip_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(news, "ARCHIVE_LINES", 30)
    rows = [(f"2024010{1 + i % 3}", f"{i}\tx") for i in range(200)]
    zipped = news.zip_exports(spark.createDataFrame(rows, "day string, value string")).collect()
    assert len(zipped) > 6
    for i, r in enumerate(zipped):
        (tmp_path / f"day={r['day']}").mkdir(exist_ok=True)
        (tmp_path / f"day={r['day']}" / f"part-{i}.zip").write_bytes(r["content"] + b"\n")
    back = news.read_archives(spark, str(tmp_path), "part-*")
    assert news.broken_archives(back).isEmpty()
    assert sorted((r["day"].strftime("%Y%m%d"), r["value"]) for r in back.collect()) == sorted(rows)


def test_landed_feeds_with_a_broken_file(spark, tmp_path):
    feed = "<rss><channel><language>en</language>\n<item><title>Port closed</title><link>http://x/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"
    for source, name, text in (("a", "1.xml", feed), ("b", "1.xml", "<rss><channel><item>"), ("b", "2.xml", feed.replace("x/1", "x/2")), ("c", "1.xml", "")):
        (tmp_path / f"source={source}").mkdir(exist_ok=True)
        (tmp_path / f"source={source}" / name).write_text(text)
    got = news.parse_feeds(news.read_feeds(spark, str(tmp_path))).collect()
    assert sorted((r["source"], r["url"]) for r in got) == [("a", "http://x/1"), ("b", "http://x/2")]


def all_pairs(places, aliases, measure):
    pairs = places.select("loc").distinct().filter("loc <> ''").crossJoin(aliases.select("alias").distinct())
    score = linking.SIMILARITY[measure][0](F.col("loc"), F.col("alias"))
    return {(r["loc"], r["alias"]) for r in pairs.withColumn("s", score).filter(F.col("s") >= linking.FUZZY_THRESHOLD).collect()}


def test_candidates_lose_no_match_and_do_not_follow_a_common_pair(spark):
    r = random.Random(4)

    def table(n):
        names = ["port " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(9, 16))) for _ in range(n)]
        near = [x[:5] + x[6:] if i % 3 else x[:-1] + "q" for i, x in enumerate(names)]
        return spark.createDataFrame(list(enumerate(near)), "place_id long, loc string"), spark.createDataFrame([(x,) for x in names], "alias string")

    found = {}
    for measure in ("difflib", "edit"):
        for n in (100, 400):
            places, aliases = table(n)
            rows = linking.similar_candidates(places, aliases, measure).collect()
            near = {(x["loc"], x["alias"]) for x in rows}
            assert len(rows) == len(near)  # each once
            assert all_pairs(places, aliases, measure) <= near
            found[measure, n] = len(near)
            assert len(near) < n * 6  # every name starts with the same six letters
        assert found[measure, 400] < 8 * found[measure, 100]


def test_similar_alias_on_the_driver_tables(spark, sf_dir):
    from laneguard.plans.domain import Domain

    d = Domain(spark, sf_dir)
    for measure in ("difflib", "edit"):
        want = all_pairs(d.places, d.aliases, measure)
        got = {(x["loc"], x["alias"]) for x in linking.similar_candidates(d.places, d.aliases, measure).collect()}
        assert want <= got
        best = {x["loc"] for x in linking.by_similar_alias(d.places, d.aliases, measure).join(d.places.select("place_id", "loc"), "place_id").collect()}
        assert best == {loc for loc, _ in want}


def test_nearest_port_equals_all_pairs(spark):
    r = random.Random(8)
    rows = [(f"P{i:04}", "port", f"C{r.randint(0, 40)}", f"R{r.randint(0, 4)}", math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for i in range(1600)]
    rows += [(f"Q{i:04}", "port", f"C{i % 3}", "R9", 10 + r.uniform(0, 0.01), 179.999 + r.uniform(0, 0.002)) for i in range(390)]  # a harbour over the date line
    rows += [("S1", "port", "X1", "RX", 90.0, 0.0), ("S2", "port", "X2", "RX", -90.0, 0.0), ("S3", "port", "X3", "RY", 0.0, 0.0), ("S4", "port", "X4", "RX", 90.0, 77.0), ("W", "waypoint", "C1", "R1", 1.0, 1.0)]
    nodes = spark.createDataFrame(rows, "node_id string, kind string, country_code string, region string, lat double, lon double")
    ports = nodes.filter("kind = 'port'").select("node_id", "country_code", "region", "lat", "lon")
    b = ports.select(*[F.col(c).alias("b_" + c) for c in ports.columns])
    tier = F.when(F.col("country_code") == F.col("b_country_code"), 0).when(F.col("region") == F.col("b_region"), 1)
    pairs = ports.join(b, (F.col("node_id") != F.col("b_node_id")) & tier.isNotNull())
    nm = haversine_nm(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    want = {x["node_id"]: x["m"][2] for x in pairs.groupBy("node_id").agg(F.min(F.struct(tier.alias("t"), nm.alias("nm"), "b_node_id")).alias("m")).collect()}
    got = {x["port"]: x["alternate"] for x in nearest_alternate_port(nodes).collect()}
    assert got == want
    assert "S3" not in got and "W" not in got


def test_grid_search_of_one_place_and_of_nothing(spark):
    schema = "id string, grp string, lat double, lon double"
    same = spark.createDataFrame([(f"p{i:03}", "g", 5.0, 5.0) for i in range(100)] + [("far", "g", -60.0, 100.0), ("null", "g", None, 1.0), ("none", None, 5.0, 5.0)], schema)
    got = {x["id"]: x["other"] for x in spatial.nearest_in_group(same, same).collect()}
    assert got["p000"] == "p001" and got["p050"] == "p000" and got["far"] == "p000" and len(got) == 101
    assert spatial.nearest_in_group(same.limit(0), same.limit(0)).collect() == []


def test_ranks_of_a_hot_key(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 2 else f"k{i % 5}", i * 37 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, part long").repartition(5)
    order = [F.desc("v"), F.col("part")]
    got = {(x["k"], x["part"]): x["rank"] for x in ranked(df, ["k"], order).collect()}
    want = {}
    for k in {x[0] for x in rows}:
        for i, (_, _, p) in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2])), 1):
            want[k, p] = i
    assert got == want
    assert sorted(x["place"] for x in ranked(df, [], order, "place").collect()) == list(range(1, 3001))
    equal = spark.range(500).selectExpr("1 AS k", "2 AS v", "id")
    assert sorted(x["rank"] for x in ranked(equal, ["k"], [F.col("v")], salt=F.col("id")).collect()) == list(range(1, 501))
    assert ranked(df.limit(0), ["k"], order).collect() == []


def test_exports_of_every_day_are_parsed_one_item_per_url_and_day(spark, tmp_path):
    page = lambda i, url: (i, url, "<html lang=\"en\"><title>Ships wait at port</title></html>")
    rows = [page(i, f"http://a.example/de/{i}") for i in range(30)] + [page(30, "http://a.example/de/0?again=1"), page(60, "http://a.example/de/0")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["a05_parse_exports"](Domain(spark, str(tmp_path))).select("url", F.dayofmonth("published").alias("day"), "summary").collect()
    assert sorted(r["day"] for r in got) == list(range(1, 31))  # the 13th too
    assert [r["summary"] for r in got if r["day"] == 1] == ["GDELT event location: Place 0"]  # pages 30 and 60 have the same address and day
    assert [r["day"].day for r in QUERIES["a05_broken_exports"](Domain(spark, str(tmp_path))).collect()] == [13]
