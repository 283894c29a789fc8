"""Links between sets of shingles with a Jaccard similarity of at least a bound, checked exactly.

Candidates come as groups of nodes (a bucket of a fingerprint, a shared shingle). All
similar pairs of a group are found, but only the edges of a spanning forest leave it:

* A group whose sets weigh at most ``WEIGHT`` shingles is read by one task. Shingles that
  only one set of the group has can match nothing: a set with too many of them is
  out. The others are indexed by their rarest shingles, so many that two similar sets share
  one, and a set is compared with those it shares one with, unless they are linked already.
* A heavier group is first thinned by the same bound and dealt anew by rarest shingles, with
  joins. What is still heavier is cut into blocks, and every two blocks meet in one task.

No set of pairs is ever written, and no task holds more than twice ``WEIGHT`` shingles
(or one pair of sets).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import column, small_batches
from lexloom.session import checkpointed

WEIGHT = 1 << 20
_EPS = 1e-9


def _prefix(size, least: float):
    """Shingles of a set of which one must be shared with any similar set."""
    return size - np.ceil(size * least - _EPS).astype(np.int64) + 1


def _groups(owner: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of n owners begin; entries are sorted by owner."""
    return np.searchsorted(owner, np.arange(n + 1))


def spanning_edges(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct-element arrays that are ``least`` alike."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n < 2 or not size.all():
        kept = np.flatnonzero(size)
        return [] if n < 2 else [(int(kept[a]), int(kept[b])) for a, b in spanning_edges([sets[i] for i in kept], least)]
    if n == 2:
        if size.min() < least * size.max() - _EPS:
            return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both >= least * (size.sum() - both) - _EPS else []
    owner = np.repeat(np.arange(n), size)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    item = item.reshape(-1)
    alive = np.ones(n, bool)
    while True:
        part = alive[owner]
        often = np.bincount(item[part], minlength=int(item.max()) + 1)
        shared = np.bincount(owner[part & (often[item] > 1)], minlength=n)
        lone = np.where(alive, size - shared, size.max())
        still = alive & (shared >= least * (size + lone.min()) - _EPS)
        done = still.sum() == alive.sum()
        alive = still
        if done or alive.sum() < 2:
            break
    if alive.sum() < 2:
        return []
    part = alive[owner]
    order = np.lexsort((item[part], often[item[part]], owner[part]))
    own, it = owner[part][order], item[part][order]
    begin = _groups(own, n)
    rank = np.arange(len(own)) - begin[own]
    front = (rank < _prefix(size, least)[own]) & (often[it] > 1)
    post_item, post_owner = it[front], own[front]
    by = np.argsort(post_item, kind="stable")
    posting_items, posting = post_item[by], post_owner[by]
    root = np.arange(n)
    edges = []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = _groups(post_owner, n)
    marked = np.zeros(int(item.max()) + 1, bool)
    left = len(np.unique(post_owner))
    for a in np.unique(post_owner).tolist():
        if left < 2:
            break
        mine = post_item[first[a] : first[a + 1]]
        lo, hi = np.searchsorted(posting_items, mine), np.searchsorted(posting_items, mine, side="right")
        others = np.unique(np.concatenate([posting[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]))
        others = others[others > a]
        most = np.minimum(shared[others], shared[a])
        others = others[most >= least * (size[others] + size[a] - most) - _EPS]
        at = find(a)
        others = others[[find(b) != at for b in others.tolist()]] if len(others) else others
        if not len(others):
            continue
        marked[it[begin[a] : begin[a + 1]]] = True
        ends = np.cumsum(begin[others + 1] - begin[others])
        where = np.arange(ends[-1]) + np.repeat(begin[others] - ends + (begin[others + 1] - begin[others]), begin[others + 1] - begin[others])
        both = np.add.reduceat(marked[it[where]].astype(np.int64), ends - (begin[others + 1] - begin[others]))
        marked[it[begin[a] : begin[a + 1]]] = False
        for b in others[both >= least * (size[others] + size[a] - both) - _EPS].tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((a, b))
                left -= 1
    return edges


def _within(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): forests of the groups of (g, node, shingles), each held by one task."""

    def run(batches):
        now, nodes, sets = None, [], []

        def edges():
            found = spanning_edges(sets, least)
            return pa.RecordBatch.from_pydict({"a": pa.array([nodes[a] for a, _ in found], pa.int64()), "b": pa.array([nodes[b] for _, b in found], pa.int64())})

        for batch in batches:
            node = column(batch, "node").to_numpy()
            lists = column(batch, "shingles")
            edge, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for k, g in enumerate(column(batch, "g").to_numpy().tolist()):
                if g != now:
                    if len(nodes) > 1:
                        yield edges()
                    now, nodes, sets = g, [], []
                elif nodes[-1] == node[k]:
                    continue
                nodes.append(int(node[k]))
                sets.append(values[edge[k] : edge[k + 1]])
        if len(nodes) > 1:
            yield edges()

    small_batches(rows.sparkSession)
    dealt = rows.select("g", "node", "shingles").repartition("g").sortWithinPartitions("g", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _weighed(rows: DataFrame) -> DataFrame:
    """(g, n, weight) of the groups with two or more nodes."""
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1")


def by_rare_items(rows: DataFrame, least) -> DataFrame:
    """Groups of (g, node, size, shingles) -> groups (g, node, size) by rare shared shingles of each, without sets that can match nothing.

    ``least`` may be a column of g. No pair of sets that is ``least`` alike is lost.
    """
    least = least if isinstance(least, Column) else F.lit(least)
    items = rows.select("g", "node", "size", F.explode("shingles").alias("t"))
    often = checkpointed(items.groupBy("g", "t").agg(F.count("*").alias("df")).where("df > 1"))
    shared = items.join(often, ["g", "t"])
    sums = checkpointed(shared.groupBy("g", "node", "size").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("order")))
    lone = F.col("size") - F.size("order")
    fewest = sums.groupBy("g").agg(F.min(lone).alias("fewest"))
    kept = sums.join(fewest, "g").where(F.size("order") >= least * (F.col("size") + F.col("fewest")) - _EPS)
    # the shingles that no other set has come first in the order; what is left of the prefix are the rarest shared ones
    rest = F.col("size") - F.ceil(F.col("size") * least - _EPS) + 1 - lone
    front = kept.select("g", "node", "size", F.explode(F.slice("order", F.lit(1), F.greatest(rest, F.lit(0)).cast("int"))).alias("o"))
    return checkpointed(front.select(F.xxhash64("g", "o.t").alias("g"), "node", "size"))


def _blocks(members: DataFrame, weight: int) -> DataFrame:
    """(g, node) of heavy groups (g, node, weight) as cells of two blocks each."""
    placed = members.withColumn("blocks", F.ceil(F.col("weight") * 2 / weight).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = placed.select("g", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return cells.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node")


def _weighed(members: DataFrame) -> DataFrame:
    """``members`` (g, node, size) with the weight of their group; of groups with the same members one stays, and none with a single one."""
    marks = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    each = members.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), *marks).where("n > 1")
    return checkpointed(members.join(each.groupBy("n", "weight", "x", "y").agg(F.min("g").alias("g")).select("g", "weight"), "g"))


def links(members: DataFrame, with_sets: Callable[[DataFrame], DataFrame], least: float, weight: int | None = None) -> DataFrame:
    """``members`` (g, node, size) -> edges (a, b) whose components are those of all similar pairs within groups.

    ``with_sets`` turns (g, node) into (g, node, shingles); it may repeat rows.
    """
    weight = WEIGHT if weight is None else weight
    members = _weighed(members.distinct())
    light, heavy = members.where(F.col("weight") <= weight), members.where(F.col("weight") > weight)
    edges = _within(with_sets(light.select("g", "node")), least)
    if heavy.isEmpty():
        return edges
    # the sets of heavy groups are made once and kept
    nodes = heavy.select(F.col("node").alias("g"), "node").distinct()
    sets = checkpointed(with_sets(nodes).dropDuplicates(["node"]).select("node", "shingles"))
    anew = _weighed(by_rare_items(heavy.select("g", "node", "size").join(sets, "node"), least))
    light, heavy = anew.where(F.col("weight") <= weight).select("g", "node"), anew.where(F.col("weight") > weight)
    return edges.unionByName(_within(light.unionByName(_blocks(heavy, weight)).join(sets, "node"), least))
