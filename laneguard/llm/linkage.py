"""Exact groups of linked items from candidate buckets, without all pairs of a bucket.

Items of a bucket are chained in the order of their ids. Verified chain pairs join items into components; only
buckets that still hold items of several components are compared further, block by block, across components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneguard.llm import blocks
from laneguard.llm.words import mix
from laneguard.session import materialize

BLOCK = 256
"""Items of a bucket that are compared with as many others in one call."""
CALL_BUCKETS = 200
"""Buckets of at most ``BLOCK`` items that one call takes on average."""
SKETCH_BLOCK = 4
"""Times as many items where only small sketches are sent."""
EXACT_BLOCK, EXACT_BUCKETS = 64, 25
"""The same two figures where whole items are sent instead of sketches."""
PAIRS = 1 << 16


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node of ``links(a, b)``.

    Alternates between stars around larger and smaller neighbours until nothing changes. Hubs are met by partial
    aggregation and a join with one row per key, so no neighbour list is ever gathered.
    """
    ends = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, state = materialize(ends.distinct(), "stars"), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _labelled(pairs: DataFrame, components: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        of = components.select(F.col("node").alias(end), F.col("component").alias("of_" + end))
        pairs = pairs.join(of, end, "left").withColumn("of_" + end, F.coalesce("of_" + end, end))
    return pairs


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` after more ``links(a, b)``: only the components that these join are looked at again."""
    ends = _labelled(links, components).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    over = materialize(connected_components(ends), "stars")
    known = components.join(over.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left")
    known = known.select("node", F.coalesce("joined", "component").alias("component"))
    return known.unionAll(over.join(components, "node", "left_anti").select("node", "component"))


Screen = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _screened(pairs: DataFrame, info: DataFrame, screen: Screen) -> DataFrame:
    """Pairs ``(a, b)`` that pass ``screen`` on the rows of ``info(sid, ...)``."""
    fields = [c for c in info.columns if c != "sid"]
    for end in ("a", "b"):
        pairs = pairs.join(info.select(F.col("sid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in fields]), end)

    def keep(batches):
        for batch in batches:
            if len(batch):
                sides = [batch[[f"{end}_{c}" for c in fields]].set_axis(fields, axis=1) for end in ("a", "b")]
                yield batch.loc[screen(*sides), ["a", "b"]]

    return pairs.mapInPandas(keep, "a long, b long")


def _pairs_in_runs(sizes: np.ndarray):
    """All pairs (i < j) of row positions inside consecutive runs of the given sizes, about ``PAIRS`` at a time."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    later = np.concatenate([np.arange(n - 1, -1, -1) for n in sizes]) if len(sizes) else np.zeros(0, np.int64)  # partners after each row
    cuts = np.flatnonzero(np.diff(np.cumsum(later) // PAIRS, prepend=0)).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, int(starts[-1])]):
        n = later[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _calls(members: DataFrame, info: DataFrame, block: int, call_buckets: int) -> DataFrame:
    """Members ``(key, sid, comp, prev)`` of buckets with more than one component, with the fields of ``info`` and the
    ``call`` that compares them: many small buckets at once, buckets over ``block`` items as pairs of blocks.

    In these, blocks of the largest component only meet blocks of the other items: a group that is linked already costs
    one row per item, whatever its size, as long as the others are one block.
    """
    per = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).filter("comps > 1")
    blocks_of = lambda n: F.ceil(n / block).cast("int")
    sizes = sizes.select("key", F.col("top.comp").alias("top"), F.when(F.col("n") > block, blocks_of(F.col("n") - F.col("top.n"))).alias("rest"), blocks_of(F.col("top.n")).alias("tops"))
    sizes = materialize(sizes, "open-buckets")
    calls = max(1, sizes.count() // call_buckets)
    m = members.join(sizes, "key").join(info, "sid")
    dealt = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    is_top, small = F.col("comp") == F.col("top"), F.col("rest").isNull()
    m = m.withColumn("own", F.when(small, 0).when(is_top, F.col("rest") + dealt(F.col("tops"))).otherwise(dealt(F.col("rest"))))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(small, 0).when(is_top, F.col("rest") - 1).otherwise(F.col("rest") + F.col("tops") - 1))))
    m = m.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    m = m.withColumn("call", F.when(small, F.pmod(F.xxhash64("key"), F.lit(calls))).otherwise(F.xxhash64("key", "i", "j")))
    return m.drop("other", "top", "rest", "tops")


def _open_pairs(rows: pd.DataFrame):
    """(sorted rows, generator of positions x, y) of all pairs of a call that lie in one bucket and in different components
    and are no chain pair (``prev`` names the one before; those are tested already)."""
    rows = rows.sort_values(["key", "i", "j", "sid"], ignore_index=True)
    group = rows.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
    sid, comp, prev = rows["sid"].to_numpy(), rows["comp"].to_numpy(), rows["prev"].to_numpy()
    own, mixed = rows["own"].to_numpy(), (rows["i"] != rows["j"]).to_numpy()

    def pairs():
        for x, y in _pairs_in_runs(np.bincount(group)):
            ok = (comp[x] != comp[y]) & ~(mixed[x] & (own[x] == own[y])) & (prev[y] != sid[x]) & (prev[x] != sid[y])
            if ok.any():
                yield x[ok], y[ok]

    return rows, pairs()


def _partnered(members: DataFrame, info: DataFrame, screen: Screen) -> DataFrame:
    """The members that have a screened partner of another component in their bucket."""
    fields = [c for c in info.columns if c != "sid"]

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows, pairs = _open_pairs(rows)
        hit = np.zeros(len(rows), bool)
        for x, y in pairs:
            ok = screen(rows.loc[x, fields].reset_index(drop=True), rows.loc[y, fields].reset_index(drop=True))
            hit[x[ok]] = hit[y[ok]] = True
        return rows.loc[hit, ["key", "sid", "comp", "prev"]].drop_duplicates()

    found = _calls(members, info, SKETCH_BLOCK * BLOCK, CALL_BUCKETS).groupBy("call").applyInPandas(mark, "key long, sid long, comp long, prev long")
    return materialize(found.distinct(), "members")


def _cross_forest(members: DataFrame, info: DataFrame, screen: Screen, block: int, call_buckets: int, batch: int) -> DataFrame:
    """Screened pairs between components: of each call so few that they join all components that its screened pairs join.

    A call gives fewer pairs than it has members, however many of these are linked.
    """
    fields = [c for c in info.columns if c != "sid"]

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        rows, pairs = _open_pairs(rows)
        sid, out = rows["sid"].to_numpy(), []
        root = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]  # component of each row, as joined so far
        for xs, ys in pairs:
            for lo in range(0, len(xs), batch):
                x, y = xs[lo:lo + batch], ys[lo:lo + batch]
                apart = root[x] != root[y]
                x, y = x[apart], y[apart]
                ok = screen(rows.loc[x, fields].reset_index(drop=True), rows.loc[y, fields].reset_index(drop=True)) if len(x) else apart[:0]
                for p, q in zip(x[ok].tolist(), y[ok].tolist()):
                    if root[p] != root[q]:
                        root[root == root[q]] = root[p]
                        out.append((min(sid[p], sid[q]), max(sid[p], sid[q])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return materialize(_calls(members, info, block, call_buckets).groupBy("call").applyInPandas(forest, "a long, b long").distinct(), "pairs")


TASK_KEYS = 1 << 20
"""Keys that a task sorts at a time, and that one group of the exchange holds on average."""
KEY_BLOCKS = "bucket int, keys binary, owner binary, sids binary, pair_keys binary, pair_a binary, pair_b binary"


def _chained(key: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct (key, sid) pairs, and which of them repeat the key of the one before."""
    order = np.lexsort((sid, key))
    k, s = key[order], sid[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))[:len(k)]
    order = order[new]
    k = key[order]
    return order, np.concatenate(([False], k[1:] == k[:-1]))[:len(k)]


def key_blocks(found, buckets: int):
    """Frames of ``KEY_BLOCKS`` from (keys uint64, sids int64) arrays; some ``TASK_KEYS`` of them are sorted at a time.

    Items of a task with equal keys are chained here already, so a key sends one item per such block, however many items
    share it; the rest travels as small blocks, one row per bucket of the key range.
    """
    held, size = [], 0

    def packed() -> pd.DataFrame:
        key, sid = (np.concatenate(x) for x in zip(*held))
        order, again = _chained(key, sid)
        key, sid = key[order], sid[order]
        pair = np.flatnonzero(again)
        of = lambda k: ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        head, head_sid = key[~again], sid[~again]
        out = {}
        for b, i, j in blocks.spans(of(head)):
            own, owner = np.unique(head_sid[i:j], return_inverse=True)
            width = np.uint16 if len(own) <= 1 << 16 else np.uint32
            out[b] = [b, blocks.pack(head[i:j]), owner.astype(width).tobytes(), own.tobytes(), b"", b"", b""]
        for b, i, j in blocks.spans(of(key[pair])):
            out[b][4:] = blocks.pack(key[pair[i:j]]), sid[pair[i:j] - 1].tobytes(), sid[pair[i:j]].tobytes()
        return pd.DataFrame(list(out.values()), columns=[c.split()[0] for c in KEY_BLOCKS.split(", ")])

    for key, sid in found:
        held.append((key, sid))
        size += len(key)
        if size >= TASK_KEYS:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def chain_blocks(packed: DataFrame) -> DataFrame:
    """Chain pairs ``(key, a, b)`` with a < b of all keys in ``KEY_BLOCKS`` rows: each item of a key but its first is b once.
    ``n`` is the number of items of the key, and ``items`` a hash of them: keys with the same items have the same."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        sids = [np.frombuffer(x, np.int64) for x in rows["sids"]]
        keys = [blocks.unpack(x) for x in rows["keys"]]
        owners = [np.frombuffer(x, np.uint16 if len(s) <= 1 << 16 else np.uint32) for x, s in zip(rows["owner"], sids)]
        key, sid = np.concatenate(keys), np.concatenate([s[o] for s, o in zip(sids, owners)])
        order, again = _chained(key, sid)
        key, sid = key[order], sid[order]
        at = np.flatnonzero(again)
        told = [np.concatenate([np.zeros(0, t), *[f(x) for x in rows[c]]]) for c, t, f in (("pair_keys", np.uint64, blocks.unpack), ("pair_a", np.int64, _longs), ("pair_b", np.int64, _longs))]
        k, a, b = np.concatenate([key[at], told[0]]), np.concatenate([sid[at - 1], told[1]]), np.concatenate([sid[at], told[2]])
        order = np.lexsort((a, b, k))  # an item that several blocks have chained keeps its smallest partner
        k, a, b = k[order], a[order], b[order]
        one = np.concatenate(([True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])))[:len(k)]
        k, a, b = k[one], a[one], b[one]
        begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[:len(k)])
        times, items = np.diff(np.append(begin, len(k))), np.zeros(0, np.uint64)
        if len(k):
            items = mix(np.add.reduceat(mix(b.view(np.uint64)), begin) + mix(np.minimum.reduceat(a, begin).view(np.uint64)))
        return pd.DataFrame({"key": k.view(np.int64), "a": a, "b": b, "n": np.repeat(times, times) + 1, "items": np.repeat(items, times).view(np.int64)})

    return packed.groupBy("bucket").applyInPandas(chain, "key long, a long, b long, n long, items long")


def _longs(block: bytes) -> np.ndarray:
    return np.frombuffer(block, np.int64)


def link_buckets(packed: DataFrame, info: DataFrame | Callable[[DataFrame], DataFrame], screen: Screen,
                 verify: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None, fine: DataFrame | None = None,
                 exact: tuple[Callable[[DataFrame], DataFrame], Screen] | None = None) -> DataFrame:
    """Components ``(node, component)`` of the items of ``packed`` (``KEY_BLOCKS``) under their true links.

    Any two linked items must share a key. ``info`` may be made from the chain pairs ``(key, a, b)``, which name all candidates. ``screen`` sees two aligned frames of ``info`` rows and may only drop
    pairs that are no links; ``fine`` has the same fields in a sharper form for the comparison of whole buckets. ``verify(pairs)`` gathers once what all these pairs need and gives a function from some of
    them to the true links among them; without it the screen itself is exact. ``exact`` goes with ``verify``: it makes rows of
    the items ``(sid)`` on which its own screen decides exactly. The result is exact: first one earlier neighbour per item
    is verified, then the chain pairs between different components. Of the buckets that still hold more than one component,
    the items with a screened partner across components are left; a spanning forest of the screened pairs is verified, and
    only where some of it fails are the items that still have such a partner compared exactly. No step lists all pairs.
    """
    chain = materialize(chain_blocks(packed), "chains")
    info = info(chain) if callable(info) else info
    chosen = chain.select("a", "b").repartition("a").distinct()  # dealt by a once, for this and the join
    if verify is None:
        tested, check = chosen, lambda pairs: _screened(pairs, info, screen)
    else:
        tested = materialize(_screened(chosen, info, screen), "pairs")
        check = verify(tested)
    first = materialize(tested.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = materialize(check(first), "links")
    components = materialize(connected_components(links), "components")
    more = materialize(_labelled(tested, components).filter("of_a != of_b").select("a", "b").join(first, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        components = materialize(_joined(components, materialize(check(more), "links")), "components")
    # near copies meet in many buckets; those with the same items are one (so are those whose hashes collide, which loses no pair)
    distinct = chain.filter("n > 2").groupBy(F.col("items").alias("key"), "b").agg(F.min("a").alias("a"))
    labelled = materialize(_labelled(distinct, components), "buckets")
    broken = labelled.groupBy("key").agg(F.max((F.col("of_a") != F.col("of_b")).cast("int")).alias("open"), F.min("a").alias("least"))
    broken = materialize(broken.filter("open = 1").select("key", "least"), "open-buckets")
    if broken.isEmpty():
        return components
    here = labelled.join(broken, "key")
    heads = here.filter("a = least").select("key", F.col("a").alias("sid"), F.col("of_a").alias("comp"), F.col("a").alias("prev")).distinct()
    members = here.select("key", F.col("b").alias("sid"), F.col("of_b").alias("comp"), F.col("a").alias("prev")).unionAll(heads)
    if fine is not None:
        members = _partnered(members, info, screen)
    cross = _cross_forest(members, info if fine is None else fine, screen, BLOCK, CALL_BUCKETS, PAIRS)
    if cross.isEmpty():
        return components
    if verify is None:
        return _joined(components, cross)
    true = materialize(verify(cross)(cross), "links")
    components = materialize(_joined(components, true), "components")
    if true.count() == cross.count():
        return components  # all screened pairs lie in one component each
    now = components.select(F.col("node").alias("sid"), "component")
    members = members.join(now, "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("comp"), "prev")
    members = _partnered(members, info if fine is None else fine, screen)
    rows_of, decide = exact
    rest = _cross_forest(members, rows_of(members.select("sid").distinct()), decide, EXACT_BLOCK, EXACT_BUCKETS, EXACT_BLOCK)
    return _joined(components, rest) if not rest.isEmpty() else components
