"""Merkle manifest of a table, with the proofs of all rows made by a butterfly exchange.

Rows of a group are dealt in order to aligned blocks of ``fanout ** block_levels`` leaves. Each block hashes its own
subtree. Then the blocks swap roots: in round r a block hears from one partner in each of the up to ``fanout`` sibling
subtrees of its own subtree of r levels, and hashes their parent itself. All blocks of a subtree do the same
redundantly, so after the last round every block holds the root and all upper siblings of its leaves, and no second
pass down the tree is needed. The roots of the groups are swapped in the same way as one more tree.
"""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneguard.session import materialize

FANOUT = 8
BLOCK_LEVELS = 4


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the inputs, joined."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value (binary)."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def runs(nodes: list[str], fanout: int) -> list[str]:
    return [digest(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]


def levels_of(leaves: list[str], fanout: int, most: int | None) -> list[list[str]]:
    """Nodes of every level over some leaves: ``most`` levels, or up to a single node if None."""
    out = [leaves]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        out.append(runs(out[-1], fanout))
    return out


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves(grp, id, leaf, ...)`` with ``idx`` (place in its group from 0), and ``(grp, gidx, n)`` of every group.

    Rows are range-partitioned in order, counted per part and group, and ranked inside their part, so that a group with
    most rows is many tasks.
    """
    order = ["grp", "id", "leaf"]
    leaves = materialize(leaves, "merkle-leaves")  # finding the ranges reads them twice
    parts = materialize(leaves.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "merkle-parts")
    counts = materialize(parts.groupBy("grp", "part").agg(F.count("*").alias("n")), "merkle-counts")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    first = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("part", "grp").orderBy("id", "leaf"))
    out = parts.withColumn("rank", rank).join(first, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    groups = counts.groupBy("grp").agg(F.sum("n").alias("n")).withColumn("gidx", F.row_number().over(Window.orderBy("grp")) - 1)  # one row per group
    return out.withColumn("idx", F.col("first") + F.col("rank") - 1).drop("rank", "first", "part", "g", "p"), groups


def _swap(state: DataFrame, level: str, partners: Column) -> DataFrame:
    """One round: every row asks one block of each sibling subtree for its root and hashes the parent.

    ``partners`` is an array of ``(g, b)``, siblings in order, of rows that are still below their top; others go on as
    they are. Rows are ``(gidx, b, node, ups)``; an entry of ``ups`` has the place among the siblings and their roots.
    """
    asks = state.select("gidx", "b", F.posexplode(partners).alias("j", "partner")).select("gidx", "b", "j", "partner.*")
    roots = state.select(F.col("gidx").alias("pg"), F.col("b").alias("pb"), F.col("node").alias("root"))
    heard = asks.join(roots, ["pg", "pb"]).groupBy("gidx", "b").agg(F.array_sort(F.collect_list(F.struct("j", "root"))).alias("heard"))  # fanout entries at most
    heard = heard.select("gidx", "b", F.col("heard.root").alias("kids"))
    joined = state.join(heard, ["gidx", "b"], "left")
    up = F.array(F.struct(F.col(level).cast("int").alias("place"), F.col("kids")))
    node = F.when(F.col("kids").isNull(), F.col("node")).otherwise(F.sha2(F.array_join("kids", "").cast("binary"), 256))
    ups = F.when(F.col("kids").isNull(), F.col("ups")).otherwise(F.concat("ups", up))
    return materialize(joined.select(*[c for c in state.columns if c not in ("node", "ups")], node.alias("node"), ups.alias("ups")), "merkle-swap")


def butterfly(blocks: DataFrame, groups: DataFrame, fanout: int) -> DataFrame:
    """``gidx, b, subroot, node (root), ups`` of every block from ``blocks(gidx, b, blocks, node)``.

    A partner has the same place in its subtree as the asking block in its own; in an incomplete subtree the place
    modulo its size.
    """
    state = materialize(blocks.withColumn("ups", F.array().cast("array<struct<place:int,kids:array<string>>>")), "merkle-swap")
    most, n_groups = blocks.agg(F.max("blocks"), F.max("gidx") + 1).first()
    size = 1
    while size < (most or 0):
        base = (F.floor(F.col("b") / (size * fanout)) * (size * fanout)).cast("long")

        def partner(s: Column) -> Column:
            start = base + s * F.lit(size)
            return F.struct(F.col("gidx").alias("pg"), (start + F.pmod(F.col("b") % size, F.least(F.lit(size).cast("long"), F.col("blocks") - start))).alias("pb"))

        there = F.least(F.lit(fanout - 1).cast("long"), F.ceil((F.col("blocks") - base) / size).cast("long") - 1)
        state = _swap(state.withColumn("place", F.floor((F.col("b") - base) / size)), "place",
                      F.when(F.col("blocks") > size, F.transform(F.sequence(F.lit(0).cast("long"), there), partner))).drop("place")
        size *= fanout
    state = state.withColumn("subroot", F.col("node"))
    if (n_groups or 0) > 1:
        state = _swap_groups(state, groups, n_groups, fanout)
    return state


def _swap_groups(state: DataFrame, groups: DataFrame, n_groups: int, fanout: int) -> DataFrame:
    """The same rounds over whole groups: a block hears from the block of its own place modulo their size in sibling groups."""
    size = 1
    sizes = groups.select(F.col("gidx").alias("sib"), F.col("blocks").alias("sib_blocks"))
    while size < n_groups:
        base = (F.floor(F.col("gidx") / (size * fanout)) * (size * fanout)).cast("int")
        s = F.explode(F.sequence(F.lit(0), F.least(F.lit(fanout - 1), F.ceil((F.lit(n_groups) - base) / size).cast("int") - 1)))
        asks = state.select("gidx", "b", base.alias("base"), s.alias("j"))
        start = F.col("base") + F.col("j") * size
        asks = asks.withColumn("sib", start + F.pmod(F.col("gidx") % size, F.least(F.lit(size), F.lit(n_groups) - start))).join(sizes, "sib")
        asks = asks.select("gidx", "b", F.struct("j", F.struct(F.col("sib").alias("pg"), F.pmod("b", "sib_blocks").alias("pb")).alias("p")).alias("ask"))
        asks = asks.groupBy("gidx", "b").agg(F.array_sort(F.collect_list("ask")).alias("asks"))  # fanout entries at most
        told = state.join(asks, ["gidx", "b"]).withColumn("place", F.floor((F.col("gidx") - base) / size))
        state = _swap(told, "place", F.col("asks.p")).drop("place", "asks")
        size *= fanout
    return state


def manifest(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             text_col: str = "text", fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Leaves hash the ``columns`` (null apart from empty). Per group (null: one of its own, first) they ascend by id, null
    first, then by leaf. Runs of ``fanout`` nodes become their hash until one node remains, the subroot; subroots in
    byte order of their groups give the root likewise. The proof of a row is the hash of all siblings on its way to the
    root. Tampered rows, those with a crc32 of the decimal id that 3 divides (a null id: never), have the text
    lower-cased (A-Z); ``folded_root`` goes from that leaf up by the siblings. Repeated rows are leaves of their own.
    A table of one row has its leaf as root and the hash of nothing as proof; an empty table gives no rows. Other
    columns are not read. Tasks hold one block of ``fanout ** block_levels`` leaves.
    """
    names = {c: F.col(c) for c in columns}
    text = F.col(text_col)
    plain = F.octet_length(text) == F.char_length(text)  # then lower() does the same, faster
    low = names | {text_col: F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))}
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False)) & F.col(text_col).rlike("[A-Z]")
    leaves = docs.select(F.col(group_col).alias("grp"), F.col(id_col).cast("long").alias("id"), leaf_of(list(names.values())).alias("leaf"),
                         F.when(hit, leaf_of(list(low.values()))).alias("changed"))
    leaves, groups = numbered(leaves)
    width = fanout ** block_levels
    groups = materialize(groups.withColumn("blocks", F.ceil(F.col("n") / width).cast("long")), "merkle-groups")
    by_group = groups.select(F.col("grp").alias("g"), "gidx", "blocks")
    leaves = leaves.join(by_group, F.col("grp").eqNullSafe(F.col("g")))
    leaves = materialize(leaves.select("gidx", "blocks", F.floor(F.col("idx") / width).cast("long").alias("b"), "idx", F.col("id").cast("string").alias("id"), "leaf", "changed"), "merkle-numbered")

    def local(rows: pd.DataFrame) -> list[list[str]]:
        return levels_of(rows["leaf"].tolist(), fanout, None if rows["blocks"].iloc[0] == 1 else block_levels)

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        return rows[["gidx", "b", "blocks"]].iloc[:1].assign(node=local(rows)[-1][0])

    blocks = leaves.groupBy("gidx", "b").applyInPandas(top, "gidx int, b long, blocks long, node string")
    upper = butterfly(blocks, groups, fanout).select("gidx", "b", "subroot", F.col("node").alias("root"), "ups")

    def prove(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tree = local(rows)
        ups = [(u["place"], list(u["kids"])) for u in above["ups"].iloc[0]]
        upper_text = "".join(k for place, kids in ups for i, k in enumerate(kids) if i != place)
        proofs, folded = [], []
        for i, (leaf, changed) in enumerate(zip(rows["leaf"], rows["changed"])):
            node, others = changed or leaf, []
            for nodes in tree[:-1]:
                start = i - i % fanout
                left, right = nodes[start:i], nodes[i + 1:start + fanout]
                others += left + right
                node, i = digest(*left, node, *right), i // fanout
            for place, kids in ups:
                node = digest(*kids[:place], node, *kids[place + 1:])
            proofs.append(digest(*others, upper_text))
            folded.append(node)
        root = above["root"].iloc[0]
        return pd.DataFrame({"doc_id": rows["id"], "leaf": rows["leaf"], "subroot": above["subroot"].iloc[0], "root": root, "proof_sha256": proofs,
                             "folded_root": folded, "verified": [f == root for f in folded]})

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.groupBy("gidx", "b").cogroup(upper.groupBy("gidx", "b")).applyInPandas(prove, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
