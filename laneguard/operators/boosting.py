"""Boosted trees over blocks of binned rows, for tables on which MLlib's rounds take too long.

The trees are those of MLlib's ``GBTClassifier`` with the same settings: regression trees on the residuals of the log-loss of
labels -1 and 1, splits by the drop of the variance, categories in the order of their mean, a first tree of weight 1 and then
``stepSize``. Rows and features of a tree are drawn by another generator, and the bounds of the bins come from all rows.
A fit can go on, so it ends with the patience and no round is fitted twice.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard.session import scratch_path

BLOCK = 1 << 17
"""Rows of a block at most."""
PART_BLOCKS = 32
"""Blocks of a partition at most, unless there are fewer partitions than cores."""
CELLS = 2048
"""Cells of a bundle of features at most (a single feature may have more)."""
LOOK = 5
"""Rounds between two looks at the validation rows."""
CUT = 20
"""Rounds between two checkpoints of the margins."""
DIRECT = 64
"""Partitions whose sums the driver adds up itself."""

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package on their path


# --- bins -------------------------------------------------------------------------------------------


def cut_points(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Per column the ascending bounds (``x <= bound``) of at most ``bins`` bins: between all values where they are so
    few, else values at even ranks. All rows are read."""
    x = {c: F.col(c).cast("double") for c in columns}
    about = rows.agg(*[F.approx_count_distinct(x[c]).alias(c) for c in columns]).first()
    few = [c for c in columns if about[c] <= 2 * bins]
    ranks = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.max(x[c]).alias(f"max_{c}") for c in columns], *[F.collect_set(x[c]).alias(f"all_{c}") for c in few],
                   *[F.percentile_approx(x[c], ranks, 100 * bins).alias(f"at_{c}") for c in columns]).first()
    out = []
    for c in columns:
        values = np.unique(got[f"all_{c}"]) if c in few else np.zeros(0)
        if c in few and len(values) <= bins:
            middle = values[:-1] / 2 + values[1:] / 2
            out.append(np.where(middle < values[1:], middle, values[:-1]))
        else:
            values = np.unique(got[f"at_{c}"])
            out.append(values[values < got[f"max_{c}"]])
    return out


def bundled(sizes: tuple[int, ...], most: int = CELLS) -> tuple[tuple[int, ...], ...]:
    """Groups of features whose joint bins are at most ``most``: they are counted together, and each one's sums are margins."""
    out: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        home = next((g for g in out if math.prod(sizes[i] for i in g) * sizes[f] <= most), None)
        out.append([f]) if home is None else home.append(f)
    return tuple(map(tuple, out))


@dataclass(frozen=True)
class Binning:
    """How a feature vector becomes one code per bundle. ``cuts`` has the bounds of a number and None for a category, whose index is its bin."""

    cuts: tuple[np.ndarray | None, ...]
    sizes: tuple[int, ...]
    bundles: tuple[tuple[int, ...], ...]

    @property
    def starts(self) -> np.ndarray:
        """Where each feature's bins begin when the bins of all features are put in a row; the last is their number."""
        return np.cumsum([0, *self.sizes])

    def shape(self, bundle: int) -> tuple[int, ...]:
        return tuple(self.sizes[f] for f in self.bundles[bundle])

    def width(self) -> np.dtype:
        return np.dtype(np.uint16 if max(math.prod(self.shape(k)) for k in range(len(self.bundles))) <= 1 << 16 else np.uint32)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) -> (bundles, rows)."""
        out = np.empty((len(self.bundles), len(x)), self.width())
        for k, group in enumerate(self.bundles):
            code = np.zeros(len(x), np.int64)
            for f in group:
                code = code * self.sizes[f] + (x[:, f].astype(np.int64) if self.cuts[f] is None else np.searchsorted(self.cuts[f], x[:, f]))
            out[k] = code
        return out

    def margins(self, bundle: int, values: np.ndarray, out: np.ndarray) -> None:
        """Sums per cell of a bundle -> sums per bin of its features, at their places in ``out``."""
        shape, starts = self.shape(bundle), self.starts
        cells = values.reshape(shape)
        for axis, f in enumerate(self.bundles[bundle]):
            out[starts[f]:starts[f + 1]] = cells.sum(axis=tuple(a for a in range(len(shape)) if a != axis))

    def table(self, feature: int, right: np.ndarray) -> tuple[int, np.ndarray]:
        """(bundle, which of its codes go right) for the bins of a feature that go right."""
        k = next(k for k, g in enumerate(self.bundles) if feature in g)
        axis, shape = self.bundles[k].index(feature), self.shape(k)
        return k, np.broadcast_to(right.reshape([-1 if a == axis else 1 for a in range(len(shape))]), shape).reshape(-1).copy()


def binned_blocks(rows: DataFrame, binning: Binning, label: str, most: int) -> DataFrame:
    """features, label -> codes, labels: blocks of about ``most`` rows, codes bundle by bundle, labels as -1 and 1."""
    def pack(batches):
        held, size = [], 0

        def block():
            codes, labels = (np.concatenate([h[i] for h in held], axis=-1) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary())], names=["codes", "labels"])
        for batch in batches:
            if batch.column(1).null_count:
                raise ValueError("a label is missing")
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held.append((binning.encode(x), np.where(batch.column(1).to_numpy(zero_copy_only=False) > 0, 1, -1).astype(np.int8)))
                size += batch.num_rows
            if size >= most:
                yield block()
                held, size = [], 0
        if held:
            yield block()
    return rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(pack, "codes binary, labels binary")


# --- trees ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A node of a tree, at its number (1, 2 to 3, 4 to 7, ...). ``right``: the bins of ``feature`` that go right; None in a leaf."""

    n: float
    total: float
    gain: float = 0.0
    feature: int = -1
    right: np.ndarray | None = None

    @property
    def value(self) -> float:
        return self.total / self.n if self.n else 0.0


def best_split(sums: np.ndarray, binning: Binning, allowed: np.ndarray, least: int) -> tuple[float, int, np.ndarray, Node, Node] | None:
    """(gain, feature, bins that go right, left, right) with the largest drop of the variance; ``sums``: rows and residuals per bin."""
    starts, most = binning.starts, max(binning.sizes)
    place = np.full((len(binning.sizes), most), starts[-1])
    for f, size in enumerate(binning.sizes):
        place[f, :size] = np.arange(starts[f], starts[f + 1])
    n, total = (np.append(s, 0.0)[place] for s in sums)
    order = np.tile(np.arange(most), (len(place), 1))
    for f in (f for f, cut in enumerate(binning.cuts) if cut is None):
        order[f] = np.argsort(np.where(n[f] > 0, total[f] / np.maximum(n[f], 1.0), np.inf), kind="stable")
    n, total = (np.cumsum(np.take_along_axis(x, order, 1), 1) for x in (n, total))
    all_n, all_total = n[0, -1], total[0, -1]
    fits = (n >= least) & (all_n - n >= least) & allowed[:, None]
    if not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, (total ** 2 / n + (all_total - total) ** 2 / (all_n - n) - all_total ** 2 / all_n) / all_n, -np.inf)
    f, at = divmod(int(np.argmax(gain)), most)
    if gain[f, at] <= 0:
        return None
    right = np.ones(most, bool)
    right[order[f, :at + 1]] = False
    return float(gain[f, at]), f, right[:binning.sizes[f]], Node(n[f, at], total[f, at]), Node(all_n - n[f, at], all_total - total[f, at])


def _walk(tree: dict[int, Node], binning: Binning) -> dict[int, tuple[int, np.ndarray]]:
    """The splits of a tree, as tables over codes."""
    return {i: binning.table(x.feature, x.right) for i, x in tree.items() if x.right is not None}


def _deal(codes: np.ndarray, rows: np.ndarray, walk: dict, ends: set[int] | None = None) -> dict[int, np.ndarray]:
    """node -> its rows, for the leaves, or for the nodes in ``ends`` only."""
    reach = None if ends is None else {i >> k for i in ends for k in range(i.bit_length())}
    at, out = {1: rows}, {}
    while at:
        i, own = at.popitem()
        if i not in walk or (ends is not None and i in ends):
            out[i] = own
            continue
        k, right = walk[i]
        goes = right.take(codes[k].take(own))
        for child, side in ((2 * i, ~goes), (2 * i + 1, goes)):
            if reach is None or child in reach:
                at[child] = own[side]
    return out


def _residuals(labels: np.ndarray, margins: np.ndarray, first: bool) -> np.ndarray:
    y = labels.astype(np.float32)
    return y if first else 4 * y / (1 + np.exp(np.minimum(2 * y * margins, 80)))


def _drawn(n: int, share: float, key: list[int]) -> np.ndarray:
    return np.arange(n) if share >= 1 else np.flatnonzero(np.random.default_rng(key).random(n, np.float32) < share)


def _count(codes: np.ndarray, rows: np.ndarray, residuals: np.ndarray, binning: Binning, cells: list[np.ndarray]) -> None:
    """Adds number and residuals of the rows to ``cells``, (2, cells) per bundle."""
    weights = residuals.take(rows).astype(np.float64)
    for k, both in enumerate(cells):
        code = codes[k].take(rows).astype(np.intp)
        both[0] += np.bincount(code, minlength=both.shape[1])
        both[1] += np.bincount(code, weights, both.shape[1])


def _empty(binning: Binning) -> list[np.ndarray]:
    return [np.zeros((2, math.prod(binning.shape(k)))) for k in range(len(binning.bundles))]


def _per_bin(cells: list[np.ndarray], binning: Binning) -> np.ndarray:
    out = np.zeros((2, binning.starts[-1]))
    for k, both in enumerate(cells):
        for i in (0, 1):
            binning.margins(k, both[i], out[i])
    return out


def _arrays(block: tuple[bytes, bytes], binning: Binning) -> tuple[np.ndarray, np.ndarray]:
    labels = np.frombuffer(block[1], np.int8)
    return np.frombuffer(block[0], binning.width()).reshape(-1, len(labels)), labels


def _add(margins: np.ndarray, codes: np.ndarray, tree: tuple[float, dict, dict]) -> None:
    weight, walk, values = tree
    share = {i: np.float32(weight * v) for i, v in values.items()}
    at = {1: np.arange(len(margins))}
    while at:
        i, own = at.popitem()
        if i not in walk:
            margins[own] += share[i]
            continue
        k, right = walk[i]
        goes = right.take(codes[k].take(own))
        if 2 * i in share and 2 * i + 1 in share:
            margins[own] += np.where(goes, share[2 * i + 1], share[2 * i])
        else:
            at[2 * i], at[2 * i + 1] = own[~goes], own[goes]


# --- rounds -----------------------------------------------------------------------------------------


class Rows:
    """Blocks of binned rows with the margin of each row so far. Blocks stay where they are (memory, then disk); margins are
    made anew by each round and cut from their past by a checkpoint now and then."""

    def __init__(self, blocks: DataFrame, parts: int, binning: Binning):
        self.one = BatchedSerializer(CPickleSerializer(), 1)  # records of equal batches meet without another pass through Python
        self.parts, self.binning, self.age = parts, binning, 0
        self.blocks = self._kept(blocks.repartition(parts).rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))))
        self.state = self._kept(self.blocks.map(lambda b: (bytes(4 * len(b[1])), None)))

    def _kept(self, rdd: RDD) -> RDD:
        return rdd._reserialize(self.one).persist(StorageLevel.MEMORY_AND_DISK)

    def total(self, parts: RDD) -> np.ndarray:
        return parts.treeReduce(np.add, 1 if self.parts <= DIRECT else 2)

    def advance(self, trees: list[tuple[float, dict, dict]], note: Callable) -> np.ndarray:
        """Adds ``trees`` to the margins; the sum over all blocks of ``note(key of the block, codes, labels, margins per tree)``."""
        binning = self.binning

        def step(part, pairs):
            for k, (block, (margins, _)) in enumerate(pairs):
                codes, labels = _arrays(block, binning)
                now = np.frombuffer(margins, np.float32).copy()

                def each():
                    for tree in trees:
                        _add(now, codes, tree)
                        yield now
                noted = note([part, k], codes, labels, each() if trees else iter([now]))
                yield now.tobytes(), noted
        old, self.age = self.state, self.age + len(trees)
        self.state = self._kept(self.blocks.zip(old).mapPartitionsWithIndex(step))
        if self.age >= CUT:
            self.state.checkpoint()
            self.age = 0
        out = self.total(self.state.map(lambda s: s[1]))
        old.unpersist()
        return out

    def close(self) -> None:
        self.state.unpersist()
        self.blocks.unpersist()


def _losses(key, codes, labels, margins) -> np.ndarray:
    return np.array([[np.sum(2 * np.logaddexp(0.0, -2.0 * labels * m)) for m in margins]])


def boosted_trees(train: Rows, valid: Rows | None, estimator: GBTClassifier, patience: int, best_of: Callable) -> tuple[list[dict[int, Node]], list[float]]:
    """(trees, validation losses): rounds until ``best_of(losses, patience)`` says that they are settled, or all of them."""
    binning, seed, depth, least = train.binning, estimator.getSeed(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    share, subset = estimator.getSubsamplingRate(), estimator.getFeatureSubsetStrategy()
    features = len(binning.sizes)
    some = features if subset == "all" else math.ceil(float(subset) * features)
    trees: list[dict[int, Node]] = []
    made: list[tuple[float, dict, dict]] = []
    losses: list[float] = []
    for turn in range(estimator.getMaxIter()):
        draw = np.random.default_rng([seed, turn])

        def root(key, codes, labels, margins, turn=turn):
            for now in margins:
                residuals = _residuals(labels, now, turn == 0)
            cells = _empty(binning)
            _count(codes, _drawn(len(labels), share, [seed, turn, *key]), residuals, binning, cells)
            return _per_bin(cells, binning)
        sums = {1: train.advance(made[-1:], root)}
        own = binning.starts[:2]
        n, total = sums[1][:, own[0]:own[1]].sum(1)
        tree, open_nodes = {1: Node(n, total)}, [1]
        for level in range(depth):
            pairs = []
            for i in open_nodes:
                allowed = np.zeros(features, bool)
                allowed[draw.permutation(features)[:some]] = True
                found = best_split(sums[i], binning, allowed, least)
                if found:
                    gain, feature, right, tree[2 * i], tree[2 * i + 1] = found
                    tree[i] = Node(tree[i].n, tree[i].total, gain, feature, right)
                    pairs.append(i)
            pairs = [i for i in pairs if max(tree[2 * i].n, tree[2 * i + 1].n) >= 2 * least]
            if level == depth - 1 or not pairs:
                break
            less = [min(2 * i, 2 * i + 1, key=lambda j: tree[j].n) for i in pairs]  # the other child is its parent without this one
            for i, j, found in zip(pairs, less, train.total(_level_sums(train, tree, less, turn, share, seed))):
                sums[j], sums[j ^ 1] = found, sums[i] - found
            open_nodes = [j for i in pairs for j in (2 * i, 2 * i + 1) if tree[j].n >= 2 * least]
        trees.append(tree)
        made.append((estimator.getStepSize() if turn else 1.0, _walk(tree, binning), {i: x.value for i, x in tree.items() if x.right is None}))
        if valid is not None and (len(trees) % LOOK == 0 or len(trees) == estimator.getMaxIter()):
            losses += valid.advance(made[len(losses):], _losses)[0].tolist()
            if best_of(losses, patience)[1]:
                break
    return trees, losses


def _level_sums(rows: Rows, tree: dict[int, Node], nodes: list[int], turn: int, share: float, seed: int) -> RDD:
    """Per partition (nodes, 2, bins): the drawn rows and their residuals in each of the nodes."""
    binning = rows.binning
    walk, ends = _walk(tree, binning), set(nodes)

    def level(part, pairs):
        cells = {i: _empty(binning) for i in nodes}
        for k, (block, (margins, _)) in enumerate(pairs):
            codes, labels = _arrays(block, binning)
            residuals = _residuals(labels, np.frombuffer(margins, np.float32), turn == 0)
            for i, own in _deal(codes, _drawn(len(labels), share, [seed, turn, part, k]), walk, ends).items():
                _count(codes, own, residuals, binning, cells[i])
        yield np.stack([_per_bin(cells[i], binning) for i in nodes])
    return rows.blocks.zip(rows.state).mapPartitionsWithIndex(level)


# --- the model --------------------------------------------------------------------------------------


def as_model(spark: SparkSession, trees: list[dict[int, Node]], binning: Binning, estimator: GBTClassifier) -> GBTClassificationModel:
    """The trees as MLlib's model. Nodes have no impurity of their own (0); gains and numbers of rows are there.

    A model of single leaves is saved, its nodes are replaced by the trees', and it is loaded again: calls into the JVM for
    every node would take longer than the rounds.
    """
    gateway = SparkContext.getOrCreate()._gateway
    ml = gateway.jvm.org.apache.spark.ml

    def array(kind, values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out
    features, tree = len(binning.sizes), ml.regression.DecisionTreeRegressionModel
    stats = gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(array(gateway.jvm.double, [0.0, 0.0, 0.0]), 0)
    leaf = tree(f"dtr_{uuid.uuid4().hex[:12]}", ml.tree.LeafNode(0.0, 0.0, stats), features)
    weights = [1.0, *[estimator.getStepSize()] * (len(trees) - 1)]
    leaves = ml.classification.GBTClassificationModel(f"GBTClassifier_{uuid.uuid4().hex[:12]}", array(tree, [leaf] * len(trees)), array(gateway.jvm.double, weights), features, 2)
    model = GBTClassificationModel(leaves)
    for param, value in estimator.extractParamMap().items():
        model.set(model.getParam(param.name), value)
    path = scratch_path(spark, "boosted-trees")
    model.write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    nodes = [(t, node) for t, tree in enumerate(trees) for node in node_rows(tree, binning)]
    spark.createDataFrame(nodes, schema).write.mode("overwrite").parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def node_rows(tree: dict[int, Node], binning: Binning) -> list[tuple]:
    """A tree's nodes as MLlib stores them: parents before children, left before right."""
    out: list[tuple] = []

    def add(i: int) -> int:
        x, own = tree[i], len(out)
        out.append(())
        left, right, split = -1, -1, (-1, [], -1)
        if x.right is not None:
            cuts = binning.cuts[x.feature]
            if cuts is None:
                split = (x.feature, [float(c) for c in np.flatnonzero(~x.right)], binning.sizes[x.feature])
            else:
                split = (x.feature, [float(cuts[int(np.argmax(x.right)) - 1])], -1)
            left, right = add(2 * i), add(2 * i + 1)
        stats = [float(x.n), float(x.total), float(x.total * x.value)]
        out[own] = (own, float(x.value), 0.0, stats, int(x.n), float(x.gain) if x.right is not None else -1.0, left, right, split)
        return own
    add(1)
    return out


def fit_blocks(estimator: GBTClassifier, train: DataFrame, valid: DataFrame | None, categories: list[int], numbers: list[str], n: int,
               patience: int, best_of: Callable) -> GBTClassificationModel:
    """The model of ``estimator`` on ``train`` (n rows), cut at the round that ``best_of`` finds best on ``valid``.

    train, valid: features (first the categories as indices, then the numbers), the label and the columns ``numbers``. categories: the
    number of indices of each category.
    """
    bins, label = estimator.getMaxBins(), estimator.getLabelCol()
    cuts = (*[None] * len(categories), *cut_points(train, numbers, bins))
    sizes = (*categories, *[len(c) + 1 for c in cuts[len(categories):]])
    binning = Binning(cuts, sizes, bundled(sizes))
    cores = train.sparkSession.sparkContext.defaultParallelism
    most = min(BLOCK, max(4096, math.ceil(n / (4 * cores))))
    parts = max(cores, math.ceil(n / most / PART_BLOCKS))
    held = [Rows(binned_blocks(rows, binning, label, most), parts, binning) for rows in (train, valid) if rows is not None]
    try:
        trees, losses = boosted_trees(held[0], held[1] if len(held) > 1 else None, estimator, patience, best_of)
    finally:
        for rows in held:
            rows.close()
    return as_model(train.sparkSession, trees[:best_of(losses, patience)[0]] if losses else trees, binning, estimator)
