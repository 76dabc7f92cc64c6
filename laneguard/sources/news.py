"""News: landed feeds, article lists and daily event exports to NewsItem rows, and the stored table."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard import schemas
from laneguard.functions import text as tx

# Fixed column positions of the daily event export (58 tab-separated columns, no header).
EXPORT_COLUMNS = 58
EXPORT_ID, EXPORT_PLACE, EXPORT_COUNTRY, EXPORT_URL = 0, 50, 51, 57
MIN_HEADLINE_WORDS = 3


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """Stored news (JSON lines). A store that does not exist yet is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.NEWS)
    return spark.read.schema(schemas.NEWS).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)


def save_items(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def _item(df: DataFrame, **cols: Column) -> DataFrame:
    order = [c.split()[0] for c in schemas.NEWS.split(", ")]
    return df.select(*[cols[c].alias(c) for c in order])


FEED = (
    "channel struct<language: string, item: array<struct<link: string, title: string, description: string, pubDate: string, updated: string>>>, "
    "entry array<struct<title: string, link: array<struct<_href: string>>, published: string, updated: string, summary: string>>"
)


def feed_time(text: Column) -> Column:
    """Feed date (RFC 822 or ISO) as naive UTC; NULL when it cannot be read."""
    mail = r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) ?([+-]\d{4})?"
    local = F.try_to_timestamp(F.nullif(F.regexp_extract(text, mail, 1), F.lit("")), F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    zone = F.regexp_extract(text, mail, 2)
    minutes = F.coalesce(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"), F.lit(0))
    shift = F.make_dt_interval(mins=F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    iso = F.try_to_timestamp(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0)).cast("timestamp_ntz")
    return F.coalesce(local - shift, iso)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed documents, one file each under ``source=<name>`` folders: source, value."""
    return spark.read.schema("value string, source string").option("ignoreCorruptFiles", "true").text(path, wholetext=True)


def parse_feeds(docs: DataFrame) -> DataFrame:
    """source, value (one RSS or Atom document) -> news. Entries need a link and a date (published, else
    updated). A document that is not XML gives no rows and does not disturb the others."""
    parsed = docs.select("source", F.from_xml("value", FEED, {"mode": "PERMISSIVE"}).alias("f"))
    field = lambda *names: F.struct(*[n.alias(a) for n, a in zip(names, ("link", "title", "summary", "date"), strict=True)])
    rss = F.transform("f.channel.item", lambda e: field(e["link"], e["title"], e["description"], F.coalesce(e["pubDate"], e["updated"])))
    atom = F.transform("f.entry", lambda e: field(F.get(e["link"], F.lit(0))["_href"], e["title"], e["summary"], F.coalesce(e["published"], e["updated"])))
    listed = parsed.select("source", F.col("f.channel.language").alias("feed_language"), F.coalesce(rss, atom).alias("entries"))
    entries = listed.select("source", "feed_language", F.inline("entries")).withColumn("published", feed_time(F.col("date")))
    usable = entries.filter("link IS NOT NULL AND link <> '' AND published IS NOT NULL")
    return _item(
        usable,
        id=tx.item_id(F.col("link")), title=tx.clean_html(F.col("title")),
        summary=F.substring(tx.clean_html(F.col("summary")), 1, tx.SUMMARY_MAX_CHARS), url=F.col("link"), source=F.col("source"),
        published=F.col("published"), origin=F.lit("rss"),
        language=F.substring(F.coalesce(F.nullif("feed_language", F.lit("")), F.lit("en")), 1, 2),
        source_country=F.lit(None).cast("string"),
    )


ARTICLES = "articles array<struct<url: string, title: string, seendate: string, domain: string, language: string, sourcecountry: string>>"


def parse_article_lists(docs: DataFrame) -> DataFrame:
    """value = one JSON document {"articles": [...]} per row -> news. Error texts give nothing."""
    body = tx.strip(F.col("value"))
    rows = docs.filter(body.startswith("{")).select(F.inline(F.from_json(body, ARTICLES)["articles"]))
    usable = rows.filter("url IS NOT NULL AND url <> '' AND seendate IS NOT NULL AND seendate <> ''")
    return _item(
        usable,
        id=tx.item_id(F.col("url")), title=tx.clean_html(F.col("title")), summary=F.lit(""), url=F.col("url"),
        source=F.coalesce(F.nullif("domain", F.lit("")), tx.url_host(F.col("url"))),
        published=F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).cast("timestamp_ntz"), origin=F.lit("gdelt_doc"),
        language=F.lower(F.substring(F.coalesce(F.nullif("language", F.lit("")), F.lit("English")), 1, 2)),
        source_country=F.nullif("sourcecountry", F.lit("")),
    )


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Daily exports as text lines with the day taken from the file or folder name (YYYYMMDD)."""
    day = F.regexp_extract("_metadata.file_path", r"[/=](\d{8})[./]", 1)
    return spark.read.text(path).select("value", F.to_date(day, "yyyyMMdd").alias("day"))


ARCHIVE_LINES = 50_000
"""Lines of one archive; a day with more gets several."""
BATCH_LINES = 4096


def zip_exports(lines: DataFrame) -> DataFrame:
    """day, value -> day, content: zip archives with one text member of at most about ``ARCHIVE_LINES`` lines each."""
    sizes = lines.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / ARCHIVE_LINES).alias("parts"))
    dealt = lines.join(sizes, "day").withColumn("part", F.pmod(F.xxhash64("value"), "parts"))

    def pack(key, rows):
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"{key[0].as_py()}.export.CSV", "\n".join(rows.column("value").to_pylist()))
        return pa.table({"day": [key[0].as_py()], "content": pa.array([body.getvalue()], pa.binary())})

    return dealt.groupBy("day", "part").applyInArrow(pack, "day string, content binary")


def _members(path: str, content: bytes):
    """Batches of (path, line, error) of an archive's first member; a broken archive is one row with its error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()
            bad = archive.testzip()
            if not names or bad:
                yield [path], [None], [f"bad member {bad}" if bad else "no member"]
                return
            with archive.open(names[0]) as raw:
                held: list[str] = []
                for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == BATCH_LINES:
                        yield [path] * len(held), held, [None] * len(held)
                        held = []
                if held:
                    yield [path] * len(held), held, [None] * len(held)
    except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError, ValueError) as error:
        yield [path], [None], [f"{type(error).__name__}: {error}"]


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Zipped daily exports as ``day, value, error, file``: the lines of the first member of every archive.

    Archives are binary files that executors decompress as a stream, each whole in one task (a day is some 15 MB). Check
    sums are tested before the first line leaves, so that a broken archive gives exactly one row with its ``error`` and
    no lines: it costs its day only. Files without bytes are not listed by Spark and give nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def unzip(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for file, line, error in _members(name, content.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (file, line, error)], names=["file", "value", "error"])

    rows = files.mapInArrow(unzip, "file string, value string, error string")
    return rows.select(F.to_date(F.nullif(F.regexp_extract("file", r"[/=](\d{8})[./]", 1), F.lit("")), "yyyyMMdd").alias("day"), "value", "error", "file")


def export_lines(archives: DataFrame) -> DataFrame:
    """The readable part of ``read_archives``, for ``parse_exports``."""
    return archives.filter("error IS NULL").select("value", "day")


def broken_archives(archives: DataFrame) -> DataFrame:
    """The side output of ``read_archives``: file, day, error."""
    return archives.filter("error IS NOT NULL").select("file", "day", "error")


def parse_exports(lines: DataFrame, words=tx.LOGISTICS_WORDS, phrases=tx.LOGISTICS_PHRASES) -> DataFrame:
    """value, day -> news: one item per on-topic URL and day whose slug makes a headline.

    Lines are cut to the four columns used and filtered before anything is shuffled; repeats of a URL are
    combined map-side, the earliest line of the export wins.
    """
    parts = F.split("value", "\t")
    cols = lines.withColumn("c", parts).filter(F.size("c") >= EXPORT_COLUMNS).select(
        "day", F.get("c", F.lit(EXPORT_ID)).try_cast("bigint").alias("seq"), F.get("c", F.lit(EXPORT_PLACE)).alias("place"),
        F.get("c", F.lit(EXPORT_COUNTRY)).alias("country"), F.get("c", F.lit(EXPORT_URL)).alias("url"),
    )
    url = F.col("url")
    kept = cols.filter(url.startswith("http") & tx.is_logistics_url(url, words, phrases))
    titled = kept.withColumn("title", tx.headline_from_url(url)).filter(F.size(F.split("title", " ")) >= MIN_HEADLINE_WORDS)
    first = titled.groupBy(tx.item_id(url).alias("id"), "day").agg(
        F.min_by(F.struct("url", "title", "place", "country"), F.struct("seq", "url")).alias("r")
    )
    rows = first.select("id", "day", "r.*")
    return _item(
        rows,
        id=F.col("id"), title=F.col("title"),
        summary=F.when(F.col("place") != "", F.concat(F.lit("GDELT event location: "), "place")).otherwise(""), url=F.col("url"),
        source=tx.publisher(F.col("url")), published=F.col("day").cast("timestamp_ntz"), origin=F.lit("gdelt_event"),
        language=F.lit("en"), source_country=F.nullif("country", F.lit("")),
    )
