"""Contiguous sharding with the smallest possible largest shard.

Rows with equal text form an atomic group; groups are ordered by their smallest id. The smallest feasible
capacity is searched over the running sums of group sizes, and the greedy cuts at that capacity are the shards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneguard.session import materialize

LOCAL_SUMS = 50_000
"""At most so many running sums (8 bytes each) are brought to the driver to end the search."""
PROBES = 64
"""Capacities that are checked in one pass over the running sums while more sums than that are open."""


def _largest_sum_up_to(sums: DataFrame, limits: np.ndarray) -> np.ndarray:
    """For each of the ascending ``limits`` the largest running sum not above it (0 if none)."""

    def probe(batches):
        for batch in batches:
            s = batch["s"].to_numpy()
            at = np.searchsorted(limits, s, "left")
            best = np.zeros(len(limits) + 1, np.int64)
            np.maximum.at(best, at, s)
            hit = np.flatnonzero(best[:-1])
            yield pd.DataFrame({"i": hit.astype(np.int64), "s": best[hit]})

    found = sums.filter(F.col("s") <= int(limits[-1])).mapInPandas(probe, "i long, s long").groupBy("i").agg(F.max("s").alias("s")).collect()
    best = np.zeros(len(limits), np.int64)
    for r in found:
        best[r["i"]] = r["s"]
    return np.maximum.accumulate(best)


def greedy_ends(lookup: Callable[[np.ndarray], np.ndarray], capacities: np.ndarray, n_shards: int) -> np.ndarray:
    """Running sum at the end of each greedy shard, one row per capacity."""
    at = np.zeros(len(capacities), np.int64)
    ends = []
    for _ in range(n_shards):
        at = lookup(at + capacities)
        ends.append(at)
    return np.stack(ends, axis=1)


def minimax_cuts(sums: DataFrame, total: int, largest: int, n_shards: int) -> list[int]:
    """Ends of the shards at the smallest feasible capacity, by narrowing search over ``sums(s)``.

    Each pass tries ``PROBES`` capacities at once. Between an infeasible and a feasible capacity every cut can
    only lie between their two cuts, so later passes read only those sums.
    """
    if total == 0:
        return [0] * n_shards
    low = max(largest, -(-total // n_shards)) - 1  # infeasible
    high = low + 1 + largest  # feasible: greedy leaves less than one group free in each shard
    spans = [(0, total)]
    while True:
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | F.col("s").between(a, b)
        near = sums.filter(inside)
        local = [r["s"] for r in near.limit(LOCAL_SUMS + 1).collect()]
        if len(local) <= LOCAL_SUMS:
            known = np.sort(np.array([0, *local], np.int64))
            lookup = lambda x: known[np.searchsorted(known, x, "right") - 1]
            while high - low > 1:
                middle = (low + high) // 2
                if greedy_ends(lookup, np.array([middle]), n_shards)[0, -1] == total:
                    high = middle
                else:
                    low = middle
            return [int(x) for x in greedy_ends(lookup, np.array([high]), n_shards)[0]]
        tries = np.unique(np.linspace(low, high, min(PROBES, high - low + 1)).astype(np.int64))
        ends = greedy_ends(lambda x: _largest_sum_up_to(near, x), tries, n_shards)
        best = int(np.argmax(ends[:, -1] == total))
        if best == 0 or tries[best] - tries[best - 1] <= 1:
            return [int(x) for x in ends[best]]
        low, high = int(tries[best - 1]), int(tries[best])
        spans = [(int(a), int(b)) for a, b in zip(ends[best - 1], ends[best])]


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Size is the UTF-8 length plus 1. Null text counts as no bytes (checksum 0) and forms a group apart from
    empty text. Rows with a null id come first. Repeated rows stay, each with its own slot. With fewer groups
    than shards the last shards are empty; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.col(text_col).cast("binary")
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("h"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt")), "shard-rows")
    cells = rows.groupBy("h", "size", "salt").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    groups = cells.groupBy("h", "size").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    groups = materialize(groups.repartitionByRange("first", "h").withColumn("part", F.spark_partition_id()), "shard-groups")
    parts = groups.groupBy("part").agg(F.sum(F.col("n") * F.col("size")).alias("b"), F.sum("n").alias("m"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("part", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("m0"))
    inside = Window.partitionBy("part").orderBy("first", "h").rowsBetween(Window.unboundedPreceding, 0)
    sums = materialize(groups.join(parts, "part").select(
        "h", "size", "n", (F.col("b0") + F.sum(F.col("n") * F.col("size")).over(inside)).alias("s"),
        (F.col("m0") + F.sum("n").over(inside)).alias("upto")), "shard-sums")
    top = sums.agg(F.max("s").alias("total"), F.max(F.col("n") * F.col("size")).alias("largest")).first()
    ends = minimax_cuts(sums.select("s"), top["total"] or 0, top["largest"] or 0, n_shards)
    cuts = sorted(set(ends[:-1]) - {top["total"] or 0, 0})
    begin = {r["s"]: r["upto"] for r in sums.filter(F.col("s").isin(cuts)).select("s", "upto").collect()} if cuts else {}
    shard, start = F.lit(0), F.lit(0).cast("long")
    for c in cuts:
        shard = shard + (F.col("s") > c).cast("int")
        start = F.when(F.col("s") > c, F.lit(begin[c])).otherwise(start)
    placed = sums.select("h", "size", shard.cast("int").alias("shard"), (F.col("upto") - F.col("n") - start).alias("base"))
    before = Window.partitionBy("h", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(placed, ["h", "size"]).select("h", "size", "salt", "shard", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))
    rank = F.row_number().over(Window.partitionBy("h", "size", "salt").orderBy("doc_id"))
    ranked = rows.select("doc_id", "size", "text_crc32", "h", "salt", rank.alias("rank"))
    return ranked.join(cells, ["h", "size", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
