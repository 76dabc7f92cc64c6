"""Merging, deduplicating and sampling news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_NAME_CHARS = 4


def keep_first(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``, among equals the smallest by the other columns in their order.

    Copies of a key are combined before the shuffle, so a URL with a third of all rows is one row per task. No choice is
    left to the order in which tasks finish.
    """
    rest = [c for c in items.columns if c != key and c not in order]
    first = items.groupBy(key).agg(F.min(F.struct(*[c for c in order if c != key], *rest)).alias("r"))
    return first.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in items.columns])


def merge(fresh: DataFrame, store: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """fresh ∪ store, one item per id. A fresh item beats a stored one; then the earlier, then the smaller URL.

    With ``columns`` only these travel with the winners' order, so that what the others are made from is never read.
    """
    order = ["published", "url"]
    if columns is not None:
        needed = list(dict.fromkeys(["id", *columns, *order]))
        fresh, store = fresh.select(*needed), store.select(*needed)
    both = fresh.withColumn("rank", F.lit(0)).unionByName(store.withColumn("rank", F.lit(1)))
    merged = keep_first(both, "id", ["rank", *order]).drop("rank")
    return merged if columns is None else merged.select(*columns)


def sample_round_robin(items: DataFrame, per_source: int = 12, total: int = 72) -> DataFrame:
    """Newest items taken in turn from every source, at most ``per_source`` each and ``total`` in all."""
    newest = [F.desc("published"), F.col("id")]
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(*newest))).filter(
        F.col("rank") <= per_source
    )
    turns = ranked.filter("rank = 1").select("source", F.col("published").alias("head"), F.col("id").alias("head_id"))
    return (
        ranked.join(turns, "source")
        .orderBy("rank", F.desc("head"), "head_id")
        .limit(total)
        .drop("head", "head_id")
    )


def word_grams(words: Column, longest: int) -> Column:
    """All runs of 1..longest neighbouring words."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        at = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, at).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, longest + 1)]))


def mentions_place(items: DataFrame, names: DataFrame, column: str = "title") -> DataFrame:
    """Items whose title (lower-cased) contains a known name of 4+ letters between spaces.

    names: alias, joined on the word runs of the titles.
    """
    usable = names.filter(F.length("alias") >= MIN_NAME_CHARS).select("alias").distinct()
    longest = usable.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    grams = word_grams(F.split(F.lower(column), " "), longest)
    named = items.select("id", F.explode(grams).alias("alias")).join(usable, "alias", "left_semi").select("id").distinct()
    return items.join(named, "id", "left_semi")
