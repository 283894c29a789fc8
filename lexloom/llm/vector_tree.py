"""Approximate nearest neighbours (12): a hierarchical k-means tree, best bin first.

Nearness is the largest inner product. Every vector gets one more component that brings all
to one length, and queries get a zero there, so the nearest by distance has the largest product.

* The tree is fitted on at most ``SAMPLE`` distinct vectors and ``SAMPLE_BYTES`` (a part of
  all hashes, so copies count once). It has at most a leaf per sampled vector: its size is bounded.
* Every row descends to one leaf. The leaves below one child of the root are a bin of the
  exchange; a bin of more than ``ROWS`` rows is dealt to several blocks, and so are the queries.
* A query walks the tree with a priority queue, nearest centre first, and lists leaves in
  the order in which it would open them.
* Calibration: ``TRIAL`` queries are compared with every row. The order number of the leaf that
  holds each true neighbour says how many visits give which recall; the least number with
  ``RECALL`` serves all queries. If it is the number of leaves, the search is exact.
* Leaves are read in rounds: after the first round of visits the query's k-th product goes along, and
  later blocks return only what is not below it.

Blocks score with matrix products, keep all within rounding of the k-th, and score those
again component by component in double precision, so equal vectors have equal scores.

* Vectors that are null, empty, zero or hold null or non-finite components take no part. Neither
  do those whose length is not the most frequent one (ties: the smaller).
* A row is its id and its vector: equal rows count once, rows that share only the id are
  different rows. A null id is never a query and comes last among ties.
* Fewer than ``k`` candidates: all are returned. No rows, or a single one: no result.
* Only ``vec_id`` and ``embedding`` are read; other columns never clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import column, small_batches, staged

K = 20
EVERY = 20
SAMPLE = 16_384
SAMPLE_BYTES = 32 << 20
BRANCH = 8
LEAF = 64
TRIAL = 256
TRIAL_BYTES = 4 << 20
RECALL = 0.95
FIRST = 1 / 16
ROWS = 16_384
_QUERIES = 256
_FAR = np.iinfo(np.int64).max


# --- the tree ---------------------------------------------------------------------


@dataclass
class Tree:
    """Centres of all nodes (the root is node 0), first child and number of children, leaf number or -1, and the bin of each leaf."""

    centres: np.ndarray
    first: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    bins: np.ndarray
    norm: float  # length that all stored vectors are brought to

    @property
    def leaves(self) -> int:
        return len(self.bins)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack((x, rest))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        x = self.lifted(x)
        at = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.children[at] > 0)
        while len(open_):
            for node in np.unique(at[open_]):
                mine = open_[at[open_] == node]
                below = slice(self.first[node], self.first[node] + self.children[node])
                at[mine] = self.first[node] + np.argmax(_nearness(x[mine], self.centres[below]), axis=1)
            open_ = open_[self.children[at[open_]] > 0]
        return self.leaf[at]

    def visits(self, queries: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves of each query, nearest bin first."""
        near = -_nearness(np.column_stack((queries, np.zeros(len(queries)))), self.centres)
        out = np.empty((len(queries), most), np.int64)
        for q, far in enumerate(near):
            heap, got = [(0.0, 0)], 0
            while got < most:
                node = heapq.heappop(heap)[1]
                if self.children[node]:
                    for child in range(self.first[node], self.first[node] + self.children[node]):
                        heapq.heappush(heap, (far[child], child))
                else:
                    out[q, got] = self.leaf[node]
                    got += 1
        return out


def _nearness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return x @ centres.T - 0.5 * (centres * centres).sum(axis=1)


def _means(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres that have members, and the centre of each vector."""
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        own = np.argmax(_nearness(x, centres), axis=1)
        used = np.unique(own)
        centres = np.stack([x[own == c].mean(axis=0) for c in used])
    own = np.argmax(_nearness(x, centres), axis=1)
    used, own = np.unique(own, return_inverse=True)
    return centres[used], own


def grow(sample: np.ndarray, norm: float, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    """A tree whose nodes are divided while they hold more than ``leaf`` sampled vectors."""
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1), np.zeros(0, np.int64), norm)
    x, rng = tree.lifted(sample), np.random.default_rng(12)
    centres, first, children = [x.mean(axis=0)], [0], [0]
    todo, top = [(0, np.arange(len(x)))], [0]
    while todo:
        node, members = todo.pop()
        if len(members) <= leaf:
            continue
        found, own = _means(x[members], min(branch, len(members)), rng)
        if len(found) < 2:
            continue
        first[node], children[node] = len(centres), len(found)
        for c in range(len(found)):
            todo.append((len(centres), members[own == c]))
            top.append(c if node == 0 else top[node])
            centres.append(found[c])
            first.append(0)
            children.append(0)
    children = np.array(children)
    leaf_no = np.full(len(children), -1)
    ends = np.flatnonzero(children == 0)
    leaf_no[ends] = np.arange(len(ends))
    return Tree(np.array(centres), np.array(first), children, leaf_no, np.array(top)[ends], norm)


# --- rows -------------------------------------------------------------------------


def _matrix(col) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    if len(col) == 0:
        return np.zeros((0, 1))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, row): rows that take part; ``row`` is a hash of id and vector."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is above infinity
    good = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0)).where(finite & F.exists("x", lambda v: v != 0))
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").select("d").first()
    # minus zero is zero, also in the hash
    plain = F.transform("x", lambda v: v + F.lit(0.0))
    return good.where(F.size("x") == (common[0] if common else 0)).select("vec_id", plain.alias("x")).withColumn("row", F.xxhash64("vec_id", "x"))


def _sample(rows: DataFrame, most: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, ids, rows) of at most ``most`` distinct vectors: those in a part of the hash values, so copies count once."""
    h = F.xxhash64("x", F.lit(seed))
    n = rows.agg(F.approx_count_distinct(h)).first()[0]
    share = int(min(1.0, 2 * most / max(1, n)) * 2**62)
    part = rows.select("vec_id", "row", "x", h.alias("h")).where(F.col("h").bitwiseAND(F.lit(2**62 - 1)) < share)
    got = part.groupBy("h").agg(F.min_by(F.struct("vec_id", "row", "x"), "row").alias("r")).orderBy("h").limit(most).select("r.*").toArrow().combine_chunks()
    ids, row = (got.column(n).combine_chunks().fill_null(_FAR).to_numpy() if got.num_rows else np.zeros(0, np.int64) for n in ("vec_id", "row"))
    return _matrix(got.column("x").combine_chunks()), ids, row


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best(q: np.ndarray, own: tuple[np.ndarray, np.ndarray], floor: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """(query number, candidate, score) of the k best candidates of each query, without its own row (id, hash) or any below its floor."""
    at, hit = [], []
    if len(x):
        rough = q @ x.T
        slack = 1e-9 * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max())
        least = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if rough.shape[1] > k else np.full(len(q), -np.inf)
        at, hit = np.nonzero(rough >= (np.maximum(least, floor) - slack)[:, None])
    at, hit = np.asarray(at, np.int64), np.asarray(hit, np.int64)
    apart = (ids[hit] != own[0][at]) | (rows[hit] != own[1][at])
    at, hit = at[apart], hit[apart]
    score = _products(q[at], x[hit])
    order = np.lexsort((ids[hit], -score, at))
    at, hit, score = at[order], hit[order], score[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[kept], hit[kept], score[kept]


def _distinct_rows(x, ids, rows, k):
    """Equal rows once; of equal vectors the k + 1 smallest ids, since no more can be among k neighbours."""
    order = np.lexsort((rows, ids))
    first = order[np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (rows[order][1:] != rows[order][:-1])))]
    x, ids, rows = x[first], ids[first], rows[first]
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].reshape(-1)
    order = np.lexsort((rows, ids, same))
    rank = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    kept = order[rank <= k]
    return x[kept], ids[kept], rows[kept]


# --- calibration ------------------------------------------------------------------


def calibrate(rows: DataFrame, tree: Tree, trial: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int, recall: float) -> int:
    """The least number of visits with which the trial queries find ``recall`` of their true neighbours."""

    def run(batches):
        floor = np.full(len(trial), -np.inf)
        for batch in batches:
            x, ids = _matrix(column(batch, "x")), column(batch, "vec_id").fill_null(_FAR).to_numpy()
            at, hit, score = best(trial, own, floor, x, ids, column(batch, "row").to_numpy(), k)
            used, where = np.unique(hit, return_inverse=True)
            leaves = tree.leaf_of(x[used])[where] if len(used) else hit
            yield pa.RecordBatch.from_pydict({"q": pa.array(at), "leaf": pa.array(leaves), "score": pa.array(score)})

    ranked = Window.partitionBy("q").orderBy(F.desc("score"))
    found = rows.select("vec_id", "x", "row").mapInArrow(run, "q long, leaf long, score double")
    top = found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).select("q", "leaf").collect()  # at most k rows a trial query
    order = np.argsort(tree.visits(trial, tree.leaves), axis=1)
    needed = np.sort([order[r["q"], r["leaf"]] + 1 for r in top])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else 1


# --- search -----------------------------------------------------------------------

_MESSAGE = "bin int, part int, side int, kind int, vec_id long, row long, x array<double>, leaves array<int>, floor double"
_FOUND = "query_id long, query_row long, vec_id long, row long, score double"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32()))


def _message(batch, pick, bins, parts, sides, kind, leaves) -> pa.RecordBatch:
    one = batch.take(pa.array(pick, pa.int64()))
    numbers = [pa.array(v, pa.int32()) for v in (bins, parts, sides, np.full(len(pick), kind))]
    return pa.RecordBatch.from_arrays([*numbers, *(column(one, n) for n in ("vec_id", "row", "x")), leaves, column(one, "floor")], ["bin", "part", "side", "kind", "vec_id", "row", "x", "leaves", "floor"])


def _row_messages(rows: DataFrame, tree: Tree, parts: np.ndarray, sides: int) -> DataFrame:
    """Every row once for each side of its block."""

    def run(batches):
        for batch in batches:
            leaf = np.repeat(tree.leaf_of(_matrix(column(batch, "x"))), sides)
            pick = np.repeat(np.arange(batch.num_rows), sides)
            bins = tree.bins[leaf]
            part = column(batch, "row").to_numpy()[pick] % parts[bins]
            yield _message(batch, pick, bins, part, np.tile(np.arange(sides), batch.num_rows), 0, _lists(leaf, np.ones(len(leaf), np.int64)))

    return rows.withColumn("floor", F.lit(None).cast("double")).mapInArrow(run, _MESSAGE)


def _query_messages(queries: DataFrame, tree: Tree, parts: np.ndarray, sides: int, skip: int, most: int) -> DataFrame:
    """Every query once for each block of each bin that its visits after the first ``skip`` reach."""

    def run(batches):
        for batch in batches:
            own = column(batch, "row").to_numpy()
            pick, bins, part, leaves = [], [], [], []
            for i, order in enumerate(tree.visits(_matrix(column(batch, "x")), most)[:, skip:]):
                for b in np.unique(tree.bins[order]).tolist():
                    mine = order[tree.bins[order] == b]
                    for p in range(parts[b]):
                        pick.append(i)
                        bins.append(b)
                        part.append(p)
                        leaves.append(mine)
            pick = np.array(pick, np.int64)
            values = np.concatenate(leaves) if leaves else pick
            yield _message(batch, pick, bins, part, own[pick] % sides, 1, _lists(values, np.array([len(v) for v in leaves], np.int64)))

    return queries.mapInArrow(run, _MESSAGE)


class _Block:
    """The rows of one block, by leaf."""

    def __init__(self, k: int):
        self.k, self.parts, self.ready = k, [], None

    def add(self, x, ids, rows, leaf):
        self.parts.append((x, ids, rows, leaf))

    def search(self, q, own, floor, visits):
        """(query number, vec_id, row, score) of the best rows in the leaves that each query visits."""
        if self.ready is None:
            x, ids, rows, leaf = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            self.ready = {c: _distinct_rows(x[leaf == c], ids[leaf == c], rows[leaf == c], self.k) for c in np.unique(leaf).tolist()}
            self.parts = []
        who = np.repeat(np.arange(len(visits)), [len(v) for v in visits])
        leaves = np.concatenate(visits) if len(visits) else np.zeros(0, np.int64)
        order = np.argsort(leaves, kind="stable")
        who, leaves = who[order], leaves[order]
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        for c in np.unique(leaves).tolist():
            if c in self.ready:
                mine = who[np.searchsorted(leaves, c) : np.searchsorted(leaves, c, side="right")]
                x, ids, rows = self.ready[c]
                at, hit, score = best(q[mine], (own[0][mine], own[1][mine]), floor[mine], x, ids, rows, self.k)
                found.append((mine[at], ids[hit], rows[hit], score))
        at, ids, rows, score = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((ids, -score, at))
        order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < self.k]
        return at[order], ids[order], rows[order], score[order]


def _search(messages: DataFrame, k: int) -> DataFrame:
    """Sorted messages: the rows of a block are held, its queries stream past."""

    def run(batches):
        now, block = None, None
        for batch in batches:
            key = np.column_stack([column(batch, n).to_numpy() for n in ("bin", "part", "side", "kind")])
            cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(key) else []
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if now != tuple(key[a][:3]):
                    now, block = tuple(key[a][:3]), None
                ids = column(batch, "vec_id").fill_null(_FAR).to_numpy()
                rows, floor = column(batch, "row").to_numpy(), column(batch, "floor").to_numpy(zero_copy_only=False)
                if key[a][3] == 0:
                    block = block or _Block(k)
                    part = batch.slice(a, b - a)
                    block.add(_matrix(column(part, "x")), ids[a:b], rows[a:b], column(part, "leaves").flatten().to_numpy())
                    continue
                for c in range(a, b, _QUERIES) if block else ():
                    e = min(b, c + _QUERIES)
                    part = batch.slice(c, e - c)
                    visits = [np.asarray(v, np.int64) for v in column(part, "leaves").to_pylist()]
                    at, hit, row, score = block.search(_matrix(column(part, "x")), (ids[c:e], rows[c:e]), floor[c:e], visits)
                    vec = pa.array(hit, mask=hit == _FAR)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[c:e][at]), pa.array(rows[c:e][at]), vec, pa.array(row), pa.array(score)], ["query_id", "query_row", "vec_id", "row", "score"])

    small_batches(messages.sparkSession, 2000)
    dealt = messages.repartition("bin", "part", "side").sortWithinPartitions("bin", "part", "side", "kind")
    return dealt.mapInArrow(run, _FOUND)


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Search:
    """Neighbours (query_id, query_row, vec_id, row, score, rank), and how they were found."""

    found: DataFrame
    tree: Tree | None
    visits: int


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, recall: float = RECALL, sample: int = SAMPLE, rows_per_block: int = ROWS) -> Search:
    """The k nearest rows of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = staged(valid_vectors(vectors))
    size = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), F.max(F.size("x"))).first()
    if size[0] is None:
        return Search(spark.createDataFrame([], f"{_FOUND}, rank int"), None, 0)
    norm, width = float(np.sqrt(size[0])), 8 * int(size[1])
    tree = grow(_sample(rows, max(1, min(sample, SAMPLE_BYTES // width)), 1)[0], norm)
    queries = staged(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "row"]))
    trial, *own = _sample(queries, max(1, min(TRIAL, TRIAL_BYTES // width)), 2)
    if not len(trial):
        return Search(spark.createDataFrame([], f"{_FOUND}, rank int"), tree, 0)
    visits = calibrate(rows, tree, trial, tuple(own), k, recall)
    parts = np.ones(int(tree.bins.max()) + 1, np.int64)
    for b, n in rows.select("x").mapInArrow(lambda batches: _bins(batches, tree), "bin int").groupBy("bin").count().collect():  # one row a bin
        parts[b] = -(-n // rows_per_block)
    sides = -(-queries.count() // rows_per_block)

    def visited(qs, skip, most):
        return _search(_row_messages(rows, tree, parts, sides).unionByName(_query_messages(qs, tree, parts, sides, skip, most)), k)

    early = min(visits, max(1, round(FIRST * tree.leaves)))
    first = staged(_nearest_of(visited(queries.withColumn("floor", F.lit(float("-inf"))), 0, early), k).drop("rank"))
    if early == visits:
        return Search(_nearest_of(first, k), tree, visits)
    floors = first.groupBy(F.col("query_id").alias("vec_id"), F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("floor")
    known = queries.join(floors, ["vec_id", "row"], "left").select("vec_id", "x", "row", floor)
    return Search(_nearest_of(first.unionByName(visited(known, early, visits)), k), tree, visits)


def _bins(batches, tree: Tree):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(tree.bins[tree.leaf_of(_matrix(column(batch, "x")))].astype(np.int32))], ["bin"])


def op12(vectors: DataFrame) -> DataFrame:
    """The contract of query op12."""
    return nearest(vectors).found.select("query_id", "rank", "vec_id", "score")
