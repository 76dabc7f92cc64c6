"""Near-dedup of embeddings: spherical k-means cells, blocked cosine products inside cells.

Two vectors with a cosine of at least t have a midpoint direction within the chord s = sqrt(2 - 2 sqrt((1 + t) / 2)) of
both. Every vector is therefore put into its own cell and into each cell that a direction within s could have as its
nearest; a pair is counted in the cell of its midpoint only. So the cells lose no link and count none twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneguard.llm.linkage import connected_components
from laneguard.session import materialize

SAMPLE = 20_000
"""Most vectors (over all labels, by the hash of their values) on which centroids are fitted."""
CELL_ROWS = 1_000
"""Rows per cell that the number of cells aims at; it is at most a quarter of the label's sample. Larger cells are
compared in blocks."""
ROUNDS = 12
BLOCK = 1_024


def usable(v):
    """Not null or empty, no null or non-finite component, not all zeros."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of the unit rows of x; starts at rows spread by a fixed stride."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.where(norm > 1e-12, norm, 1), centres)
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    """Whether row i must be in cell c: it, or a unit vector within the chord ``reach`` of it, may be nearest to c."""
    dots = x @ centres.T
    near = np.argmax(dots, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[near]
    return dots[np.arange(len(x)), near][:, None] - dots <= reach * apart + 1e-9


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; vectors link when labels are equal and the cosine in double
    precision reaches the threshold.

    Rows with a null label and vectors that are null, empty, zero or hold null or non-finite components link with
    nothing (0 links, own component). Vectors of different lengths do not link. Equal vectors are one item with a count. Rows with a null id are counted
    as neighbours but name no component (kept is false). An empty table gives no rows. Only the three columns are read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    able = rows.filter(usable(F.col("v")) & F.col("label").isNotNull())
    label = F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string"))
    # equal vectors: -0.0 counts as 0.0; partial sums meet before the shuffle
    able = able.select("vec_id", label.alias("g"), F.transform("v", lambda x: x + 0.0).alias("v")).withColumn("h", F.md5(F.concat_ws(",", F.col("v").cast("array<string>")).cast("binary")))
    items = able.groupBy("g", "h").agg(F.count("*").alias("w"), F.min("vec_id").alias("rep"), F.any_value("v").alias("v"))
    items = materialize(items.withColumn("item", F.xxhash64("g", "h")), "vector-items")
    sizes = {r["g"]: r["n"] for r in items.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(10_000).collect()}
    total = sum(sizes.values())
    # fit on a bounded sample per label, in proportion; labels beyond the first 10,000 have one cell
    share = min(1.0, SAMPLE / max(total, 1))
    sampled = items.withColumn("r", F.pmod(F.xxhash64("item"), F.lit(1_000_000)) / 1_000_000).filter(F.col("r") <= share).limit(2 * SAMPLE)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        g = frame["g"].iat[0]
        x = _unit(frame.sort_values("item")["v"])
        k = max(1, min(sizes.get(g, 0) // CELL_ROWS, len(x) // 4))
        return pd.DataFrame({"g": g, "centres": [spherical_kmeans(x, k).ravel().tolist()], "k": k})

    # bounded by the sample: a centroid for four sampled vectors at most
    fitted = sampled.groupBy("g").applyInPandas(fit, "g string, centres array<double>, k int").filter("k > 1").collect()
    centres = {r["g"]: np.array(r["centres"]).reshape(r["k"], -1) for r in fitted}
    reach = float(np.sqrt(2 - 2 * np.sqrt((1 + threshold) / 2)))

    def deal(batches):
        for batch in batches:
            out = []
            for g, part in batch.groupby("g", sort=False):
                if g not in centres:
                    out.append(part.assign(cell=0)[["g", "cell", "item", "w", "v"]])
                    continue
                i, cell = np.nonzero(cells_of(_unit(part["v"]), centres[g], reach))
                out.append(part.iloc[i].assign(cell=cell)[["g", "cell", "item", "w", "v"]])
            if out:
                yield pd.concat(out)

    dealt = items.select("g", "item", "w", "v").mapInPandas(deal, "g string, cell int, item long, w long, v array<double>")
    dealt = materialize(dealt, "vector-cells")
    blocks = dealt.groupBy("g", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = dealt.join(blocks, ["g", "cell"]).withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Weighted links of each item in this block pair, and links that connect its components."""
        same = frame["i"].iat[0] == frame["j"].iat[0]
        left, right = frame[frame["own"] == frame["i"].iat[0]], frame[frame["own"] == frame["j"].iat[0]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "w": []}).astype("int64")
        x, y = _unit(left["v"]), _unit(right["v"])
        a, b = np.nonzero(x @ y.T >= threshold)
        if same:
            a, b = a[a < b], b[a < b]
        c = centres.get(frame["g"].iat[0])
        if c is not None and len(a):
            cx, cy = x @ c.T, y @ c.T
            home = np.concatenate([np.argmax(cx[a[s:s + 8192]] + cy[b[s:s + 8192]], axis=1) for s in range(0, len(a), 8192)])
            ok = home == frame["cell"].iat[0]
            a, b = a[ok], b[ok]
        li, ri, lw, rw = left["item"].to_numpy(), right["item"].to_numpy(), left["w"].to_numpy(), right["w"].to_numpy()
        sums = pd.concat([pd.DataFrame({"a": li[a], "w": rw[b]}), pd.DataFrame({"a": ri[b], "w": lw[a]})]).groupby("a", as_index=False)["w"].sum()
        least = _block_roots(li[a], ri[b])
        return pd.concat([sums.assign(b=sums["a"])[["a", "b", "w"]], least.assign(w=0)]).astype("int64")

    found = materialize(spread.groupBy("g", "cell", "i", "j").applyInPandas(compare, "a long, b long, w long"), "vector-links")
    components = connected_components(found.filter("a != b").select("a", "b"))
    counts = found.filter("w > 0").groupBy("a").agg(F.sum("w").alias("links"))
    group = items.select("item", "g", "h", "w", "rep").join(components.select(F.col("node").alias("item"), "component"), "item", "left")
    group = group.withColumn("component", F.coalesce("component", "item")).join(counts.select(F.col("a").alias("item"), "links"), "item", "left")
    group = materialize(group.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("w") - 1), "vector-groups")
    least = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    result = group.join(least, "component").select("g", "h", "links", "component_id")
    linked = able.select("vec_id", "g", "h").join(result, ["g", "h"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.filter(~(usable(F.col("v")) & F.col("label").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _block_roots(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links (item, smallest item of its component) of a small graph given by its ends."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})
