"""The driver tables seen as domain tables: network, lanes, disruption events, news, orders, labels."""

from __future__ import annotations

import datetime as dt
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard.functions.numeric import stable_round
from laneguard import schemas
from laneguard.functions import text as tx
from laneguard.operators import brief, evaluation, exposure, extraction, forecast, history, linking, models, network, store
from laneguard.operators.replay import Disruption, Params, Spec, replay
from laneguard.session import materialize

AS_OF = dt.datetime(2024, 1, 21, 12, 0, 0)
LOOKBACK_DAYS = 14
VALID_START, TEST_START = dt.datetime(1999, 1, 1), dt.datetime(2000, 1, 1)
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SPEC = Spec(
    params=Params(lookback_days=7, threshold=0.5, window_before_days=10, window_after_days=3),
    disruptions=(
        Disruption("alarm_peak", dt.date(2024, 1, 20), ("RA000", "WP_F"), "Alarm peak"),
        Disruption("alarm_early", dt.date(2024, 1, 15), ("WP_D", "RB001"), "Early alarms", "first alarm", dt.date(2024, 1, 9)),
    ),
    control_windows=((dt.date(2024, 1, 1), dt.date(2024, 1, 7)), (dt.date(2024, 1, 24), dt.date(2024, 1, 30))),
    primary_lane="RB001-RC002",
    secondary_lane_focus=("africa_asia", "asia_africa"),
)
# Keyword rules over the vocabulary of the documents.
DOC_RULES = extraction.Rules(
    types=(
        ("conflict_or_attack", ("thanea", "attion")), ("labor_strike", ("ertion", "erwh")), ("severe_weather", ("onnd", "erea")),
        ("port_congestion", ("quevi", "ouvi")), ("port_closure", ("zent", "schei")),
    ),
    places=(("thnt", "RA", "RA000"), ("eron", "RB", None), ("onan", "RC", "RC002"), ("mentre", None, None), ("en-der", "RD", None)),
    severity=((5, ("whwh", "thth")), (4, ("erer",)), (3, ("anan", "tre"))),
)
ADJECTIVES = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
NOUNS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
NODES_IN_NETWORK = 25  # fixed by the nation table
# What rows of the event table mean as news, and how much they count; errors differ among themselves and count in full.
SIGNAL_TYPES = {"purchase": "port_congestion", "click": "labor_strike", "view": "severe_weather", "signup": "accident"}
SIGNAL_WEIGHTS = {"purchase": 0.2, "click": 0.1, "view": 0.05, "signup": 0.02}


class Domain:
    """Lazy domain tables over one data folder. Small derived dimensions are written once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- network ----------------------------------------------------------------------------

    @cached_property
    def keyed_nodes(self) -> DataFrame:
        k, r = F.col("n_nationkey"), F.col("n_regionkey")
        owner = F.concat(F.lit("R"), F.char(r + 65))
        waypoint = (k % 7).isin(3, 5)
        return (
            self.table("nation")
            .select(
                k.alias("k"),
                F.col("n_name").alias("name"),
                F.when(waypoint, F.concat(F.lit("WP_"), F.char(k + 65)))
                .otherwise(F.concat(owner, F.lpad(k.cast("string"), 3, "0")))
                .alias("node_id"),
                F.when(k % 7 == 3, "chokepoint").when(k % 7 == 5, "sea_region").otherwise("port").alias("kind"),
                (k * 5 - 60).cast("double").alias("lat"),
                ((k * 37) % 360 - 180).cast("double").alias("lon"),
                F.when(~waypoint, owner).alias("country_code"),
                F.when(r < 2, "WEST").otherwise("EAST").alias("region"),
                r.alias("region_key"),
                owner.alias("owner"),
            )
        )

    @cached_property
    def nodes(self) -> DataFrame:
        return self.keyed_nodes.select("node_id", "name", "kind", "lat", "lon", "country_code", "region")

    @cached_property
    def legs(self) -> DataFrame:
        ids = self.keyed_nodes.select("k", "node_id")
        steps = F.when(F.col("k") % 3 == 0, F.array(F.lit(1), F.lit(7))).otherwise(F.array(F.lit(1)))
        return (
            ids.select(F.col("node_id").alias("from_node"), "k", F.explode(steps).alias("step"))
            .select("from_node", ((F.col("k") + F.col("step")) % NODES_IN_NETWORK).alias("k"))
            .join(ids.withColumnRenamed("node_id", "to_node"), "k")
            .select("from_node", "to_node")
        )

    @cached_property
    def lane_pairs(self) -> DataFrame:
        """Nation pairs that trade. Each order is reduced to its distinct supplier nations before the join."""
        supplier = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sk"))
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ck"))
        sellers = self.table("lineitem").select("l_orderkey", "l_suppkey").join(supplier, "l_suppkey").select(
            F.col("l_orderkey").alias("o_orderkey"), "sk"
        )
        buyers = self.table("orders").select("o_orderkey", "o_custkey").join(customer, "o_custkey").select("o_orderkey", "ck")
        return sellers.join(buyers, "o_orderkey").select("sk", "ck").distinct()

    @cached_property
    def raw_lanes(self) -> DataFrame:
        named = self.keyed_nodes.join(self.table("region"), F.col("region_key") == F.col("r_regionkey"))
        end = lambda key, col: named.select(
            F.col("k").alias(key), F.col("node_id").alias(col), F.col("kind").alias(f"{col}_kind"),
            F.lower("r_name").alias(f"{col}_region"),
        )
        return (
            self.lane_pairs.join(end("sk", "origin"), "sk")
            .join(end("ck", "destination"), "ck")
            .select(
                F.concat_ws("-", "origin", "destination").alias("lane_id"), "origin", "destination",
                F.concat_ws("_", "origin_region", "destination_region").alias("focus"), "origin_kind", "destination_kind",
            )
        )

    @cached_property
    def lanes(self) -> DataFrame:
        ports = "origin <> destination AND origin_kind = 'port' AND destination_kind = 'port'"
        return materialize(self.raw_lanes.filter(ports).drop("origin_kind", "destination_kind"), "lanes")

    @cached_property
    def neighbours(self) -> DataFrame:
        return network.neighbour_table(self.nodes, self.legs)

    @cached_property
    def routes(self) -> DataFrame:
        return network.lane_routes(self.lanes, self.neighbours)

    @cached_property
    def reach(self) -> DataFrame:
        return exposure.lane_nodes(self.lanes, self.routes, self.nodes)

    # --- disruption events ------------------------------------------------------------------

    @cached_property
    def alarms(self) -> DataFrame:
        """Every event as a linked disruption event; what it is and how much it counts follows from its type."""
        user, ev = F.col("user_id"), F.col("event_id")
        near = self.keyed_nodes.select(
            F.col("k").alias("k1"), F.col("node_id").alias("n1"), F.col("name").alias("location"), "owner", "country_code"
        )
        far = self.keyed_nodes.select(F.col("k").alias("k2"), F.col("node_id").alias("n2"))
        nation = network.country_node(F.col("owner"))
        level = user % 10 == 0
        pair = ev % 7 == 0
        share = F.col("value") / 500.0
        of_type = lambda values, other: reduce(lambda out, kv: out.when(F.col("event_type") == kv[0], kv[1]), list(values.items())[1:],
                                               F.when(F.col("event_type") == list(values)[0], list(values.values())[0])).otherwise(other)
        return (
            self.table("events")
            .withColumn("k1", (user % NODES_IN_NETWORK).cast("int"))
            .withColumn("k2", ((user + 11) % NODES_IN_NETWORK).cast("int"))
            .join(near, "k1")
            .join(far, "k2")
            .select(
                F.concat(F.lit("E"), F.lpad(ev.cast("string"), 12, "0")).alias("event_id"),
                F.col("ts").alias("published"),
                of_type(SIGNAL_TYPES, F.when(ev % 4 == 0, "conflict_or_attack").when(ev % 4 == 1, "severe_weather")
                        .when(ev % 4 == 2, "labor_strike").otherwise("port_congestion")).alias("event_type"),
                "location",
                (ev % 5 + 1).cast("int").alias("severity"),
                stable_round(share * share * of_type(SIGNAL_WEIGHTS, 1.0), 4).alias("confidence"),
                F.when(level & pair, F.array(nation, "n2")).when(level, F.array(nation))
                .when(pair, F.array("n1", "n2")).otherwise(F.array("n1")).alias("node_ids"),
                "country_code",
                F.concat(F.lit("signal "), "props").alias("summary"),
                F.concat(F.lit("http://alerts.example.com/"), ev.cast("string")).alias("source_url"),
            )
        )

    @cached_property
    def visible(self) -> DataFrame:
        """Events inside the closed lookback window that ends at AS_OF."""
        return store.visible(self.alarms, AS_OF, LOOKBACK_DAYS)

    @cached_property
    def hits(self) -> DataFrame:
        """Touched lanes per distinct node list; written once, since several branches read it."""
        return materialize(exposure.signature_hits(self.alarms, self.reach), "hits")

    @cached_property
    def contributions(self) -> DataFrame:
        return exposure.exposed_lanes(self.visible, self.hits)

    @cached_property
    def risk(self) -> DataFrame:
        return exposure.lane_exposure(self.visible, self.hits, self.lanes)

    # --- replay -----------------------------------------------------------------------------

    @cached_property
    def windows(self) -> DataFrame:
        return SPEC.windows(self.spark)

    def signals(self, scoring: str) -> DataFrame:
        return replay(self.alarms, self.hits, self.lanes, self.windows, SPEC.params, scoring)

    # --- weather and brief ------------------------------------------------------------------

    @cached_property
    def weather_arrays(self) -> DataFrame:
        """Daily maxima per node as parallel arrays, the way a forecast service delivers them."""
        top = F.max("value")
        daily = (
            self.table("events")
            .groupBy((F.col("user_id") % NODES_IN_NETWORK).cast("int").alias("k"), F.to_date("ts").alias("day"))
            .agg((top / 4.0).alias("wind"), (top / 3.0).alias("gust"),
                 F.when(F.count(F.lit(1)) % 3 != 0, top / 6.0).alias("rain"))
            .join(self.keyed_nodes.select("k", "node_id"), "k")
        )
        days = F.array_sort(F.collect_list(F.struct("day", "wind", "gust", "rain")))  # one entry per calendar day
        return daily.groupBy("node_id").agg(days.alias("d")).select(
            "node_id", F.col("d.day").alias("time"), F.col("d.wind").alias("wind"), F.col("d.gust").alias("gust"),
            F.col("d.rain").alias("rain"),
        )

    @cached_property
    def touched(self) -> DataFrame:
        return brief.touched_nodes(self.visible, self.hits)

    @cached_property
    def avoid(self) -> DataFrame:
        return brief.avoid_lists(self.touched, self.lanes)

    @cached_property
    def actions(self) -> DataFrame:
        return materialize(
            brief.mitigations(self.touched, self.lanes, self.routes, self.nodes, self.neighbours), "mitigations"
        )

    @cached_property
    def draft_lanes(self) -> DataFrame:
        """A writer's draft: some lanes left out, shifted or named twice, and one invented lane per supplier."""
        a = F.substring("origin", 3, 3).cast("int")
        b = F.substring("destination", 3, 3).cast("int")
        repeats = F.when((a + b * 2) % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        real = (
            self.lanes.join(self.risk.select("lane_id", "exposure_score"), "lane_id")
            .filter((a + b) % 3 != 0)
            .select("lane_id", F.when((a * b) % 5 == 1, F.col("exposure_score") + 0.1).otherwise(F.col("exposure_score")).alias("exposure_score"),
                    F.explode(repeats).alias("pos"))
        )
        invented = self.table("supplier").select(
            F.concat(F.lit("XX-"), F.col("s_suppkey").cast("string")).alias("lane_id"), F.lit(0.5).alias("exposure_score"), F.lit(1).alias("pos")
        )
        return real.unionByName(invented)

    @cached_property
    def grounded(self) -> DataFrame:
        return brief.ground_lanes(self.draft_lanes, self.risk, self.lanes)

    @cached_property
    def draft_cites(self) -> DataFrame:
        return self.table("events").select(F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("event_id"))

    # --- news -------------------------------------------------------------------------------

    @cached_property
    def pages(self) -> DataFrame:
        """Raw pages with a headline slug in the URL and a publication time."""
        title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
        slug = F.regexp_replace(F.lower(title), "[^a-z]+", "-")
        site = F.regexp_extract("url", "^(https?://[^?#]*)", 1)
        return self.table("pages").select(
            "page_id", "url", "html", title.alias("raw_title"), F.concat(site, F.lit("/"), slug, F.lit(".html")).alias("news_url"),
            (store.ntz(dt.datetime(2024, 1, 1))
             + F.make_dt_interval((F.col("page_id") % 30).cast("int"), (F.col("page_id") % 24).cast("int"))).alias("published"),
        )

    @cached_property
    def fresh(self) -> DataFrame:
        """Pages as news items."""
        url = F.col("news_url")
        return self.pages.select(
            tx.item_id(url).alias("id"), tx.clean_html(F.col("raw_title")).alias("title"),
            F.substring(tx.clean_html(F.col("html")), 1, tx.SUMMARY_MAX_CHARS).alias("summary"), url.alias("url"),
            tx.publisher(url).alias("source"), "published", F.when(F.col("page_id") % 3 == 0, "rss").otherwise("gdelt_doc").alias("origin"),
            F.substring(F.regexp_extract("html", 'lang="([^"]*)"', 1), 1, 2).alias("language"), F.lit(None).cast("string").alias("source_country"),
        )

    @cached_property
    def stored(self) -> DataFrame:
        """The store before the merge: upper-case copies of fresh URLs, a day older, and items of its own."""
        url = F.concat(F.lit(" "), F.upper("news_url"))
        older = F.col("published") - F.expr("INTERVAL 1 DAY")
        base = self.pages.select(url.alias("url"), older.alias("published"), "raw_title", "page_id")
        own = self.pages.select(F.concat("news_url", F.lit("?old")).alias("url"), older.alias("published"), "raw_title", "page_id")
        return base.unionByName(own).select(
            tx.item_id(F.col("url")).alias("id"), F.concat(F.lit("stored "), F.col("page_id").cast("string")).alias("title"), F.lit("").alias("summary"), "url",
            F.lower(tx.publisher(F.lower(tx.strip(F.col("url"))))).alias("source"), "published", F.lit("manual").alias("origin"), F.lit("en").alias("language"),
            F.lit(None).cast("string").alias("source_country"),
        )

    @cached_property
    def doc_items(self) -> DataFrame:
        """Documents as news items: the first 80 characters are the title, the rest the text."""
        return self.table("documents").select(
            F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"), F.substring("text", 1, 80).alias("title"),
            F.expr("substring(text, 81)").alias("summary"), F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string")).alias("url"),
            "source", (store.ntz(dt.datetime(2024, 1, 1)) + F.make_dt_interval((F.col("doc_id") % 30).cast("int"))).alias("published"),
            F.lit("manual").alias("origin"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("source_country"),
        )

    @cached_property
    def records(self) -> DataFrame:
        return self.read_by_rules(self.doc_items)

    def read_by_rules(self, items: DataFrame) -> DataFrame:
        """Keyword records of documents; this extractor does not read Spanish, so those have failed."""
        made = extraction.keyword_records(items, DOC_RULES, text=tx.news_text(F.col("title"), F.col("summary")))
        bad = items.filter("language = 'es'").select(F.col("id").alias("news_id"), F.lit(True).alias("bad"))
        joined = made.join(bad, "news_id", "left")
        return joined.select(
            "news_id", "model", "prompt_version", F.when(F.col("bad"), "failed").otherwise("ok").alias("status"),
            (F.col("bad").isNull() & F.col("is_disruption")).alias("is_disruption"),
            F.when(F.col("bad"), F.filter("events", lambda e: F.lit(False))).otherwise(F.col("events")).alias("events"),
            F.when(F.col("bad"), "no valid JSON object").alias("error"),
        )

    @cached_property
    def gold(self) -> DataFrame:
        lang = F.col("lang")
        event = lambda t, loc, cc, port, sev: F.struct(
            t.alias("event_type"), loc.alias("location"), cc.alias("country_code"), port.alias("port_code"), sev.cast("int").alias("severity")
        )
        none = F.lit(None).cast("string")
        main = event(
            F.when(F.col("toxic") == 1, "conflict_or_attack").otherwise("labor_strike"),
            F.when(lang == "en", "Port of Thnt").when(lang == "fr", "The Mentre").when(lang == "de", "Eron").otherwise("Onan"),
            F.when(lang == "en", "RA").when(lang == "de", "RB"), F.when(lang == "en", "RA000"), F.col("doc_id") % 5 + 1,
        )
        second = event(F.lit("severe_weather"), F.lit("Onan"), F.lit("RC"), none, F.lit(None))
        events = F.when(F.col("quality") != 1, F.array().cast(evaluation.EVENT_CELLS)).when(F.col("doc_id") % 3 == 0, F.array(main, second)).otherwise(F.array(main))
        who = F.element_at(F.array(F.lit("accepted"), F.lit("edited"), F.lit("manual"), none), (F.col("doc_id") % 4 + 1).cast("int"))
        return self.table("labels").join(self.table("documents").select("doc_id", "lang"), "doc_id").select(
            F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("news_id"), (F.col("quality") == 1).alias("is_disruption"),
            events.alias("events"), who.alias("label_source"),
        )

    @cached_property
    def scored_pairs(self) -> DataFrame:
        """Gold labels beside the last record of each item: an earlier run had failed on all of them."""
        late = self.records.withColumn("arrival", F.lit(1))
        early = late.withColumn("arrival", F.lit(0)).withColumn("status", F.lit("failed")).withColumn("events", F.filter("events", lambda e: F.lit(False)))
        last = evaluation.last_record(late.unionByName(early), ["arrival"])
        return evaluation.joined_predictions(self.gold, last.drop("arrival"))

    @cached_property
    def sheet(self) -> DataFrame:
        """Labelling sheet: one row per document, labels where a person gave any, some as unconfirmed drafts."""
        labels = self.gold.select("news_id", "is_disruption", "events", "label_source")
        base = self.doc_items.select(
            F.col("id").alias("news_id"), "source", F.date_format("published", "yyyy-MM-dd").alias("published"), "title", F.lit("").alias("text"), "url"
        )
        rows = base.join(labels, "news_id", "left").select("*", F.posexplode_outer("events").alias("nth", "e"))
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        made = {
            "is_disruption": F.when(F.col("is_disruption").isNull(), " ").when(F.col("is_disruption"), " Yes ").otherwise("no"),
            "event_type": text("e.event_type"), "location": text("e.location"), "country_code": text("e.country_code"), "port_code": text("e.port_code"),
            "severity": text("e.severity"), "notes": F.lit(""),
            "label_source": F.when(F.col("source") == "src3", evaluation.DRAFT_ONLY).otherwise(text("label_source")), "draft_model": F.lit(""),
        }
        return rows.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in schemas.SHEET_COLUMNS], F.coalesce("nth", F.lit(0)).alias("pos"))

    @cached_property
    def replies(self) -> DataFrame:
        """Model replies built from every event: clean, fenced, chatty or cut off, some outside the schema."""
        ev = F.col("event_id")
        pick = lambda words, c: F.element_at(F.array(*[F.lit(w) for w in words]), (c % len(words) + 1).cast("int"))
        raw = self.table("events").select(
            "event_id", "event_type", "value", (F.col("value") > 10).alias("flag"),
            pick(("strike", " Severe Weather", "port-closure", "piracy", "volcano", "other"), ev).alias("type"),
            pick(("ra", "N/A", "", "RAX"), F.col("user_id")).alias("country"), pick(("RA 000", "null", "RB001", "R1"), F.col("user_id") + ev).alias("port"),
            (ev % 7).cast("int").alias("severity"), pick(("unknown", "2024-01-05", "", "2024-13-01", "2024-02-29"), ev).alias("start"),
            F.floor(F.col("value") * 100).alias("hundredths"), "ts",
        )
        body = F.format_string(
            '{"is_disruption": %s, "events": [{"event_type": "%s", "location": "Place %d", "country_code": "%s", "port_code": "%s", '
            '"severity": %d, "start_date": "%s", "end_date": null, "industries": [" Auto ", "pharma", "AUTO", ""], "summary": "s", '
            '"confidence": %d.%02d}]}',
            F.col("flag").cast("string"), "type", "event_id", "country", "port", "severity", "start",
            F.floor(F.col("hundredths") / 10000), F.col("hundredths") % 100,
        )
        reply = (
            F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("Sure, here it is:\n"), body, F.lit("\nDone.")))
            .when(F.col("event_type") == "signup", F.expr("'{\"is_disruption\": true, \"events\": [{\"event_type\": '"))
            .otherwise(body)
        )
        return raw.select(
            F.concat(F.lit("E"), F.lpad(ev.cast("string"), 12, "0")).alias("id"), F.lit("https://replies.example.com/").alias("url"), F.lit("replies").alias("source"),
            F.col("ts").alias("published"), reply.alias("reply"), "type", "country", "port", "severity", "start", "hundredths", "flag", "event_type",
        )

    # --- places -----------------------------------------------------------------------------

    @cached_property
    def named_nodes(self) -> DataFrame:
        """Nodes named after parts: the names that mentions use."""
        k = F.col("k")
        word = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % 8 + 1).cast("int"))
        eighth = F.floor(k / 8)
        return self.keyed_nodes.select(
            k.alias("pos"), "node_id", "kind", "country_code", F.concat_ws(" ", word(ADJECTIVES, k), word(NOUNS, k + eighth)).alias("name"),
            F.array(F.concat_ws(" ", word(ADJECTIVES, k + 1), word(NOUNS, k + eighth + 4))).alias("aliases"),
        )

    @cached_property
    def aliases(self) -> DataFrame:
        ports, waypoints = self.named_nodes.filter("kind = 'port'"), self.named_nodes.filter("kind <> 'port'")
        noun = F.element_at(F.array(*[F.lit(w) for w in NOUNS]), (F.col("pos") % 8 + 1).cast("int"))
        extra = self.named_nodes.filter("pos IN (0, 4, 7, 23)").select("pos", noun.alias("alias"), "node_id")
        return materialize(linking.alias_table(ports, waypoints, extra), "aliases")

    @cached_property
    def link_ports(self) -> DataFrame:
        return self.nodes.filter("kind = 'port'").select("node_id", "country_code")

    @cached_property
    def mentions(self) -> DataFrame:
        """Every part name as a place mention: prefixed, misspelt, embedded, accented, upper-case or plain."""
        size, name = F.col("p_size"), F.col("p_name")
        code = lambda c: F.concat(F.lit("R"), F.char(c % 5 + 65))
        return self.table("part").select(
            F.col("p_partkey").alias("mention_id"),
            F.when(size % 6 == 0, F.concat(F.lit("Port of "), name))
            .when(size % 6 == 1, F.concat(F.substring(name, 1, 3), F.expr("substring(p_name, 5)")))
            .when(size % 6 == 2, F.concat(F.lit("near the "), name, F.lit(" coast")))
            .when(size % 6 == 3, F.replace(name, F.lit("o"), F.lit("ö"))).when(size % 6 == 4, F.upper(name)).otherwise(name).alias("location"),
            F.when(size % 4 == 0, None).when(size % 11 == 0, "ZZ").otherwise(code(size)).alias("country_code"),
            F.when(size % 7 == 0, F.concat(code(size % 25), F.lpad((size % 25).cast("string"), 3, "0"))).when(size % 7 == 1, "ZZ999").alias("port_code"),
        )

    @cached_property
    def places(self) -> DataFrame:
        return materialize(linking.distinct_places(self.mentions), "places")

    @cached_property
    def links(self) -> DataFrame:
        return linking.link_places(self.places, self.link_ports, self.aliases, measure="edit")

    @cached_property
    def linked_mentions(self) -> DataFrame:
        return linking.link_mentions(self.mentions, self.links, self.places)

    # --- orders -----------------------------------------------------------------------------

    @cached_property
    def orders(self) -> DataFrame:
        """Order lines as a stored table, spread by order, for work that reads them several times."""
        return materialize(self._order_lines(self.table("lineitem").repartition("l_orderkey")), "orders")

    @cached_property
    def order_lines(self) -> DataFrame:
        """Order lines with their outcome: scheduled days from the priority, real days from the line number."""
        return self._order_lines(self.table("lineitem"))

    def _order_lines(self, items: DataFrame) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("order_country"), F.col("r_name").alias("order_region")
        )
        customer = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(nation, "c_nationkey")
        head = self.table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))).alias("order_date"),
            F.col("o_orderpriority").alias("shipping_mode"), "order_country", "order_region", F.col("c_mktsegment").alias("customer_segment"),
            F.col("o_orderstatus").alias("payment_type"),
        )
        lines = items.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"
        )
        scheduled = F.substring("shipping_mode", 1, 1).cast("int")
        rows = lines.join(head, "l_orderkey").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "order_date", F.col("l_linenumber").alias("days_real"), scheduled.alias("days_scheduled"),
            (F.col("l_linenumber") > scheduled).cast("int").alias("late"), "shipping_mode", F.col("order_region").alias("market"), "order_region", "order_country",
            "customer_segment", F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("department"), "payment_type",
            F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_discount").alias("discount_rate"),
            F.col("l_extendedprice").alias("sales"),
        )
        return history.prepare(rows)

    @cached_property
    def dataset(self) -> DataFrame:
        """Orders with history and split; written once, because several passes read it."""
        return materialize(self.featured, "dataset")

    @cached_property
    def featured(self) -> DataFrame:
        """The rows of ``dataset`` for a single pass, which needs no stored table of all columns."""
        return history.build_dataset(self.orders, VALID_START, TEST_START)

    @cached_property
    def split_lines(self) -> DataFrame:
        """The rows of ``dataset`` without their history, for work that does not use it."""
        return self.orders.withColumn("split", history.split_column(VALID_START, TEST_START)).filter("split IS NOT NULL")

    @cached_property
    def train(self) -> DataFrame:
        return self.dataset.filter("split = 'train'")

    @cached_property
    def train_lines(self) -> DataFrame:
        """The rows of ``train`` without their history."""
        return self.split_lines.filter("split = 'train'")

    @cached_property
    def common(self) -> DataFrame:
        return materialize(forecast.common_categories(self.train_lines), "categories")

    @cached_property
    def folded(self) -> DataFrame:
        """The dataset with rare categories as one value."""
        return materialize(forecast.fold_rare(self.featured, self.common), "folded")

    @cached_property
    def linear(self):
        """The logistic model of this data set, fitted once per application."""
        return models.fit_once("logistic", self.folded.filter("split = 'train'"), {"c": 1.0}, forecast.fit_logistic)

    @cached_property
    def trees(self):
        """The boosted model of this data set, fitted once per application."""
        rows = self.folded.filter("split IN ('train', 'valid')")
        return models.fit_once("boosted", rows, {"rounds": 2000, "step": 0.05, "patience": 100, "train": "settled"}, forecast.fit_boosted)

    @cached_property
    def train_share(self) -> float:
        return float(self.train_lines.agg(F.avg("late")).first()[0])

    @cached_property
    def defaults(self) -> dict:
        """Typical feature values: one row per feature."""
        typical = {r["name"]: r["value"] for r in forecast.modes(self.train_lines).collect()}
        return typical | {r["name"]: r["value"] for r in forecast.medians(self.train_lines).collect()}

    @cached_property
    def lane_countries(self) -> DataFrame:
        """lane -> country of its destination, by name."""
        names = self.nodes.select(F.col("node_id").alias("country_code"), F.col("name").alias("order_country"))
        return forecast.lane_countries(self.lanes, names, F.col("destination"))

    @cached_property
    def what_if(self) -> DataFrame:
        share = self.train_share
        days = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5, "9-NEVER": 4}
        return forecast.what_if_orders(self.lane_countries, forecast.country_regions(self.train_lines), forecast.final_history(self.train_lines, share),
                                       self.defaults, share, days)
