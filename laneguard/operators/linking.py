"""Linking free-text places to network nodes.

Rules in order: port code, exact alias, alias inside the text, similar alias, country, none. Linking runs
on distinct (place, country, port code) triples; each rule only sees what the earlier ones left.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from laneguard.functions.numeric import stable_round
from laneguard.functions.text import link_name
from laneguard.operators.network import country_node
from laneguard.session import materialize

FUZZY_THRESHOLD = 0.85
MIN_WITHIN_LEN = 4
COUNTRY_SCORE = 0.5


def alias_table(ports: DataFrame, waypoints: DataFrame, extra: DataFrame) -> DataFrame:
    """alias -> node_id with ``pos``, the order in which aliases are tried.

    ports/waypoints: pos, node_id, name, aliases array; extra: pos, alias, node_id. The first writer of a
    name wins among ports, then waypoints; the extra list overrides.
    """
    own = ports.select("node_id", F.lit(0).alias("tier"), "pos", F.posexplode(F.concat(F.array("name", "node_id"), "aliases")).alias("at", "name"))
    way = waypoints.select("node_id", F.lit(1).alias("tier"), "pos", F.posexplode(F.concat(F.array("name"), "aliases")).alias("at", "name"))
    more = extra.select("node_id", F.lit(2).alias("tier"), "pos", F.lit(0).alias("at"), F.col("alias").alias("name"))
    named = own.unionByName(way).unionByName(more).withColumn("alias", link_name(F.col("name"))).filter("alias <> ''")
    place = F.struct("tier", "pos", "at")
    last_extra = F.max_by(F.when(F.col("tier") == 2, F.col("node_id")), F.when(F.col("tier") == 2, place))
    return named.groupBy("alias").agg(
        F.coalesce(last_extra, F.min_by("node_id", place)).alias("node_id"), F.min(place).alias("pos")
    )


def by_port_code(places: DataFrame, ports: DataFrame) -> DataFrame:
    """Trust a port code that exists and does not contradict the country."""
    known = ports.select(F.col("node_id").alias("port_code"), F.col("country_code").alias("port_country"))
    agrees = F.col("country_code").isNull() | (F.col("country_code") == "") | (F.col("country_code") == F.col("port_country"))
    return places.join(known, "port_code").filter(agrees).select(
        "place_id", F.col("port_code").alias("node_id"), F.lit("port_code").alias("method"), F.lit(1.0).alias("score"),
        F.lit(None).cast("string").alias("matched_alias"),
    )


def by_exact_alias(places: DataFrame, aliases: DataFrame) -> DataFrame:
    return places.join(aliases.withColumnRenamed("alias", "loc"), "loc").select(
        "place_id", "node_id", F.lit("alias_exact").alias("method"), F.lit(1.0).alias("score"), F.col("loc").alias("matched_alias")
    )


def runs_of(loc: Column, words: list[int]) -> Column:
    """Distinct word runs of a name, only of the given numbers of words."""
    parts = F.split(loc, " ")
    runs = F.flatten(F.transform(F.array(*[F.lit(n) for n in words]), lambda n: F.when(F.size(parts) >= n, F.transform(
        F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(runs)


def by_alias_within(places: DataFrame, aliases: DataFrame) -> DataFrame:
    """The longest alias (4+ letters) that occurs in the place as whole words.

    Places are turned into the word runs of those lengths that aliases have and matched by equality; the table of
    aliases is never compared pair by pair.
    """
    usable = aliases.filter(F.length("alias") >= MIN_WITHIN_LEN)
    words = sorted(r["n"] for r in usable.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect())
    runs = places.select("place_id", F.explode(runs_of(F.col("loc"), words)).alias("alias"))
    best = F.max_by(F.struct("node_id", "alias"), F.struct(F.length("alias"), *[-F.col(f"pos.{c}") for c in ("tier", "pos", "at")]))
    return runs.join(usable, "alias").groupBy("place_id").agg(best.alias("b")).select(
        "place_id", "b.node_id", F.lit("alias_within").alias("method"), F.lit(1.0).alias("score"), F.col("b.alias").alias("matched_alias")
    )


@F.pandas_udf(DoubleType())
def difflib_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - F.levenshtein(a, b) / longest.cast("double")


# Similarity measure -> (column function, least number of shared letter pairs a match can have, shortest possible
# partner of a text). With U = letters left over, a difflib match of M letters in B blocks shares at least M - B pairs and
# B <= U + 1; an edit distance of d over length n leaves at least n - 1 - 2d pairs.
SIMILARITY: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column, Column, float], Column], Callable[[Column, float], Column]]] = {
    "difflib": (difflib_ratio, lambda m, n, t: (m + n) * (1.5 * t - 1.0) - 1.0, lambda m, t: m * (t / (2.0 - t))),
    "edit": (edit_ratio, lambda m, n, t: F.greatest(m, n) * (2.0 * t - 1.0) - 1.0, lambda m, t: m * t),
}
SLACK = 1e-9


def _letter_pairs(text: Column) -> Column:
    """Numbered letter pairs ('ab#1', 'ab#2', ...), so that equal keys count repeated pairs correctly."""
    pairs = F.when(
        F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))
    ).otherwise(F.array(text))
    return F.transform(pairs, lambda p, i: F.concat(p, F.lit("#"), F.size(F.filter(F.slice(pairs, 1, i + 1), lambda q: q == p)).cast("string")))


def pair_prefixes(names: DataFrame, text: str, weights: DataFrame, least: Callable, shortest: Callable, threshold: float) -> DataFrame:
    """``names`` with ``pairs`` (numbered letter pairs, rarest first) and ``prefix`` (how many of them must be looked up).

    A match shares at least ``least`` pairs, whatever its length, so when both sides list their pairs in one order, the
    first ``pairs - least + 1`` of each have one in common (prefix filter).
    """
    listed = names.withColumn("pair", F.explode(_letter_pairs(F.col(text)))).join(weights, "pair")
    sorted_ = listed.groupBy(*names.columns).agg(F.array_sort(F.collect_list(F.struct("weight", "pair"))).alias("p"))  # as many as letters
    m = F.length(text)
    need = F.greatest(F.lit(1), F.ceil(least(m, F.ceil(shortest(m, threshold) - SLACK), threshold) - SLACK))
    return sorted_.select(*names.columns, F.col("p.pair").alias("pairs"), F.greatest(F.lit(1), F.size("p") - need + 1).cast("int").alias("prefix"))


def similar_candidates(places: DataFrame, aliases: DataFrame, measure: str = "difflib", threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """``loc, alias`` of all pairs that lengths and shared letter pairs allow to be similar; no true match is lost.

    Pairs of letters are weighted by the rows that a join on them would give. Only the rarest pairs of each name, the
    prefix, are joined: a pair that is in nearly every name is in hardly any prefix. A candidate is taken at the first
    prefix pair that both sides have, so none is listed twice and nothing has to be made distinct.
    """
    _, least, shortest = SIMILARITY[measure]
    locs = places.filter("loc <> ''").select("loc").distinct()
    names = aliases.select("alias").distinct()
    count = lambda df, text, name: df.select(F.explode(_letter_pairs(F.col(text))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias(name))
    weights = count(locs, "loc", "x").join(count(names, "alias", "y"), "pair", "full").select("pair", (F.coalesce("x", F.lit(0)) * F.coalesce("y", F.lit(0))).alias("weight"))
    weights = materialize(weights, "pair-weights")
    sides = []
    for df, text in ((locs, "loc"), (names, "alias")):
        side = materialize(pair_prefixes(df, text, weights, least, shortest, threshold), "pair-prefixes")
        sides.append(side.select(text, F.col("pairs").alias(f"{text}_pairs"), F.col("prefix").alias(f"{text}_prefix"), F.explode(F.slice("pairs", F.lit(1), F.col("prefix"))).alias("pair")))
    both = sides[0].join(sides[1], "pair")
    m, n = F.length("loc"), F.length("alias")
    in_length = (F.least(m, n) >= shortest(F.greatest(m, n), threshold) - SLACK)
    head = lambda text: F.slice(f"{text}_pairs", F.lit(1), F.col(f"{text}_prefix"))
    once = F.get(F.array_intersect(head("loc"), head("alias")), F.lit(0)) == F.col("pair")
    shared = F.size(F.array_intersect("loc_pairs", "alias_pairs"))
    return both.filter(in_length & once & (shared >= least(m, n, threshold) - SLACK)).select("loc", "alias")


def by_similar_alias(places: DataFrame, aliases: DataFrame, measure: str = "difflib", threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """The most similar alias with similarity >= threshold (ties: the greater alias).

    The similarity is computed for the few pairs of distinct names that ``similar_candidates`` leaves.
    """
    if threshold < 0.8:
        raise ValueError("the letter-pair bound needs a threshold of at least 0.8")
    similarity = SIMILARITY[measure][0]
    near = similar_candidates(places, aliases, measure, threshold)
    scored = near.withColumn("score", similarity(F.col("loc"), F.col("alias"))).filter(F.col("score") >= threshold)
    best = scored.groupBy("loc").agg(F.max(F.struct("score", "alias")).alias("b"))
    found = best.select("loc", F.col("b.alias").alias("alias"), F.col("b.score").alias("score")).join(aliases.select("alias", "node_id"), "alias")
    return places.select("place_id", "loc").join(found, "loc").select(
        "place_id", "node_id", F.lit("fuzzy").alias("method"), stable_round(F.col("score"), 3).alias("score"), F.col("alias").alias("matched_alias")
    )


def by_country(places: DataFrame, ports: DataFrame) -> DataFrame:
    owners = ports.select("country_code").distinct()
    return places.join(owners, "country_code", "left_semi").select(
        "place_id", country_node(F.col("country_code")).alias("node_id"), F.lit("country").alias("method"), F.lit(COUNTRY_SCORE).alias("score"),
        F.lit(None).cast("string").alias("matched_alias"),
    )


def distinct_places(mentions: DataFrame) -> DataFrame:
    """Distinct (location, country_code, port_code) with an id and the normalized name."""
    triple = mentions.select("location", "country_code", "port_code").distinct()
    key = F.sha1(F.to_json(F.struct("location", "country_code", "port_code")))
    return triple.withColumn("place_id", key).withColumn("loc", link_name(F.coalesce("location", F.lit(""))))


def link_places(places: DataFrame, ports: DataFrame, aliases: DataFrame, measure: str = "difflib") -> DataFrame:
    """place_id, node_id, method, score, matched_alias: every place once, unlinked ones with method none.

    Port code, exact alias and country are equality lookups in small tables and are answered together in
    one pass. The two text searches run only on what is still open, and each intermediate state is written
    once, so that no rule is evaluated twice.
    """

    def tagged(hit: DataFrame, name: str) -> DataFrame:
        return hit.select("place_id", F.struct("node_id", "method", "score", "matched_alias").alias(name))

    looked_up = (
        places.select("place_id", "loc", "country_code", "port_code")
        .join(ports.select(F.col("node_id").alias("port_code"), F.col("country_code").alias("port_country")), "port_code", "left")
        .join(aliases.select(F.col("alias").alias("loc"), F.col("node_id").alias("exact")), "loc", "left")
        .join(ports.select("country_code", F.lit(True).alias("owner")).distinct(), "country_code", "left")
    )
    no_country = F.col("country_code").isNull() | (F.col("country_code") == "")
    by_code = F.col("port_country").isNotNull() & (no_country | (F.col("country_code") == F.col("port_country")))
    link = lambda node, method, alias: F.struct(
        node.alias("node_id"), F.lit(method).alias("method"), F.lit(1.0).alias("score"), alias.cast("string").alias("matched_alias")
    )
    direct = F.when(by_code, link(F.col("port_code"), "port_code", F.lit(None))).when(
        F.col("exact").isNotNull(), link(F.col("exact"), "alias_exact", F.col("loc"))
    )
    state = materialize(looked_up.select("place_id", "loc", "country_code", "owner", direct.alias("link")), "links")
    for rule in (lambda r: by_alias_within(r, aliases), lambda r: by_similar_alias(r, aliases, measure)):
        hit = tagged(rule(state.filter("link IS NULL")), "hit")
        state = materialize(
            state.join(hit, "place_id", "left").withColumn("link", F.coalesce("link", "hit")).drop("hit"), "links"
        )
    owner = F.when(F.col("owner"), F.struct(
        country_node(F.col("country_code")).alias("node_id"), F.lit("country").alias("method"), F.lit(COUNTRY_SCORE).alias("score"),
        F.lit(None).cast("string").alias("matched_alias")))
    none = F.struct(F.lit(None).cast("string").alias("node_id"), F.lit("none").alias("method"), F.lit(0.0).alias("score"),
                    F.lit(None).cast("string").alias("matched_alias"))
    return state.select("place_id", F.coalesce("link", owner, none).alias("l")).select("place_id", "l.*")


def link_mentions(mentions: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """mentions + node_id, method, score, matched_alias (null-safe join back on the triple)."""
    table = places.join(links, "place_id").select(
        *[F.col(c).alias(f"p_{c}") for c in ("location", "country_code", "port_code")], "node_id", "method", "score", "matched_alias"
    )
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("location", "country_code", "port_code")]
    return mentions.join(table, same[0] & same[1] & same[2]).drop("p_location", "p_country_code", "p_port_code")


def to_graph_events(linked: DataFrame) -> DataFrame:
    """Linked disruption events as graph events; unlinked ones are dropped."""
    return linked.filter("node_id IS NOT NULL").select(
        "event_id", F.array("node_id").alias("node_ids"), "severity", "confidence", "event_type",
        F.coalesce(F.nullif("summary", F.lit("")), "location").alias("label"),
    )


def link_report(linked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events, link rate, direct rate (without country fallbacks) and counts per method."""
    n = F.count(F.lit(1))
    method = F.col("method")
    rate = lambda c: F.coalesce(stable_round(F.try_divide(F.count_if(c).cast("double"), n.cast("double")), 3), F.lit(0.0))
    counts = [F.count_if(method == m).alias(f"method_{m}") for m in ("port_code", "alias_exact", "alias_within", "fuzzy", "country", "none")]
    cols = [n.alias("events"), rate(method != "none").alias("link_rate"), rate(~method.isin("none", "country")).alias("direct_link_rate"), *counts]
    return linked.groupBy(*by).agg(*cols) if by else linked.agg(*cols)
