"""Mixing sources to target weights over a domain - language - source tree. DataFrame functions only.

A token budget is passed down the tree by sibling weights. A child that cannot use its share (its supply times the
allowed epochs is smaller) takes what it has, and its shortage goes to its siblings by weight; only what a whole
subtree cannot use reaches the siblings of its parent. Every leaf then takes whole epochs and a token prefix of one
more seeded epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneguard.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKET_CHARS = 3
"""Hexadecimal digits of the shuffled order that number the slices (4,096) whose sums are added first."""
NO_NAME = "(none)"


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``budget`` of each child from its parent's ``parent_budget``, its ``weight`` and its capacity ``cap``.

    Water filling in closed form: children in the order of capacity per weight are full as long as the level that
    the rest allows is not lower than theirs. Whole tokens; fewer tokens than children are lost by rounding down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), F.col(name))
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_of = Window.partitionBy(*parent)
    c = children.withColumn("used", F.coalesce(F.sum("cap").over(earlier), F.lit(0))).withColumn("open_weight", F.sum("weight").over(later))
    c = c.withColumn("full", _big(F.col("cap")) * _big(F.col("open_weight")) <= _big(F.col("parent_budget") - F.col("used")) * _big(F.col("weight")))
    c = c.withColumn("rest", F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of))
    c = c.withColumn("rest_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_of))
    part = F.expr("(cast(rest as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(rest_weight as decimal(19,0))")
    return c.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("used", "open_weight", "full", "rest", "rest_weight", "parent_budget")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, levels: list[str], budget: Column, max_epochs: int) -> DataFrame:
    """``budget`` of every leaf of ``leaves(levels..., supply)``.

    ``weights(level, name, weight)`` gives the weight of the node ``name`` among its siblings on that level; nodes
    without a row have weight 1, a weight of 0 shuts a subtree out. Capacity is supply times ``max_epochs``.
    """
    def weighted(df: DataFrame, level: str) -> DataFrame:
        w = weights.filter(F.col("level") == level).select(F.col("name").alias(level), F.col("weight").cast("long").alias("weight"))
        return df.join(w, level, "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))

    nodes = leaves.select(*levels, (F.col("supply") * max_epochs).alias("cap"))
    by_depth = [nodes]
    for depth in range(len(levels) - 1, 0, -1):
        nodes = weighted(nodes, levels[depth]).filter(F.col("weight") > 0).groupBy(*levels[:depth]).agg(F.sum("cap").alias("cap"))
        by_depth.insert(0, nodes)
    share = None
    for depth, level in enumerate(levels):
        children = weighted(by_depth[depth], level).filter(F.col("weight") > 0)
        if share is None:
            children, parent = children.withColumn("parent_budget", F.least(budget, F.sum("cap").over(Window.partitionBy()))), []
        else:
            parent = levels[:depth]
            children = children.join(share.select(*parent, F.col("budget").alias("parent_budget")), parent)
        share = _share(children, parent, level)
    return share.select(*levels, "budget")


def mix_sources(docs: DataFrame, weights: DataFrame, domain: Column, budget_share: tuple[int, int] = (3, 5), max_epochs: int = 2,
                seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How often every row is taken: ``doc_id, domain, lang, source, tokens, epochs``.

    The budget is the given share of all tokens (words outside ASCII white space). Null names count as one node of
    their own; null text has no tokens. The order of an epoch is the hash of seed, epoch number and id, then the id,
    then the tokens; of the last epoch the longest prefix within the leaf's budget is taken. Repeated rows are rows
    of their own. An empty table gives no rows. Clashing column names do not matter: only the columns named are read.
    """
    levels = ["domain", "lang", "source"]
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NO_NAME))
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), named(domain).alias("domain"), named(F.col("lang")).alias("lang"), named(F.col("source")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens")), "mix-rows")
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("supply"))
    leaves = materialize(leaves, "mix-leaves")  # one row per source and language
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("total")).first()["total"]
    budgets = leaf_budgets(leaves, weights, levels, F.lit(total * budget_share[0] // budget_share[1]).cast("long"), max_epochs)
    whole = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0)
    plan = materialize(leaves.join(budgets, levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0))).select(
        *levels, whole.cast("int").alias("whole"), (F.col("budget") - whole * F.col("supply")).alias("rest")), "mix-plan")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    dealt = rows.join(plan, levels).withColumn("o", order).withColumn("slice", F.substring("o", 1, BUCKET_CHARS))
    before = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = dealt.groupBy(*levels, "slice").agg(F.sum("tokens").alias("t"))
    slices = slices.select(*levels, "slice", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    upto = F.sum("tokens").over(Window.partitionBy(*levels, "slice").orderBy("o", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.withColumn("upto", upto).join(slices, [*levels, "slice"])
    in_prefix = (F.col("rest") > 0) & (F.col("before") + F.col("upto") <= F.col("rest"))
    return ranked.select("doc_id", *levels, "tokens", (F.col("whole") + in_prefix.cast("int")).cast("int").alias("epochs"))
