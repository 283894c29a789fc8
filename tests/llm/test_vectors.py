"""The k-means tree search against a plain search of all rows."""

import numpy as np
import pytest

from lexloom.llm import vector_tree as m

SCHEMA = "vec_id long, embedding array<float>, row string, x int"


def plain(rows, every=20, k=20):
    good = {}
    for i, v, *_ in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i, tuple(np.float32(v).astype(float) + 0.0)] = True
    sizes = [len(v) for _, v in good]
    width = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    good = [g for g in good if len(g[1]) == width]
    out = {}
    for q in good:
        if q[0] is None or q[0] % every:
            continue
        found = []
        for c in good:
            if c != q:
                score = 0.0
                for a, b in zip(q[1], c[1], strict=True):
                    score += a * b
                found.append((-score, c[0] is None, c[0], score))
        out.setdefault(q[0], []).append([(c[2], c[3]) for c in sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k]])
    return out


def data(n=900, d=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32) * rng.choice([1, 1, 1, 5], (n, 1)).astype(np.float32)
    x[300:600] = x[300]  # a third is one vector
    rows = [(i, v.tolist(), "row", 1) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * d, [-0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] * d, [1.0] * (d + 1)]
    rows += [(100_000 + 20 * k, v, "row", 1) for k, v in enumerate(bad)]
    rows += [(40, x[40].tolist(), "again", 2), (60, x[61].tolist(), "same id", 3), (None, x[300].tolist(), None, None)]
    return rows


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_exact_when_every_leaf_is_visited(spark):
    rows = data()
    got = m.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), recall=1.0, sample=200, rows_per_block=70)
    assert got.tree.leaves > 3
    rows_of = {}
    for r in got.found.collect():
        rows_of.setdefault((r["query_id"], r["query_row"]), []).append((r["rank"], r["vec_id"], r["score"]))
    want = plain(rows)
    if got.visits == got.tree.leaves:
        have = sorted([i, [(v, s) for _, v, s in sorted(r)]] for (i, _), r in rows_of.items())
        assert have == sorted([i, one] for i, lists in want.items() for one in lists)
    assert sorted(i for i, _ in rows_of) == sorted(i for i, lists in want.items() for _ in lists)


def test_recall_and_scores_of_the_query(spark, monkeypatch):
    monkeypatch.setattr(m, "LEAF", 20)
    rows = [r for r in data(3000, 16, 2) if r[0] is not None and r[2] == "row"]
    df = m.op12(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = collected(df), {i: lists[0] for i, lists in plain(rows).items()}
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[i]} & {v for v, _ in want[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {i: v for i, v, *_ in rows}
    for i, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20
        assert all(s == sum_in_order(exact[i], exact[v]) for v, s in found)


def sum_in_order(a, b):
    s = 0.0
    for x, y in zip(np.float32(a).astype(float).tolist(), np.float32(b).astype(float).tolist(), strict=True):
        s += x * y
    return s


def test_a_part_of_the_leaves_reaches_the_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12)) * 4
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 12))).astype(np.float32)
    rows = [(i, v.tolist(), "row", 1) for i, v in enumerate(x)]
    search = m.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert search.visits < search.tree.leaves / 2
    got, s = collected(search.found), x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    hits = sum(len({v for v, _ in got[i]} & set(np.argsort(-s[i])[:20].tolist())) for i in range(0, 4000, 20))
    assert hits >= 0.9 * 200 * 20


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0], "a", 1)], [(None, [1.0], "a", 1), (3, [2.0], "a", 1)], [(0, None, "a", 1)]])
def test_no_neighbours(spark, rows):
    assert m.op12(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0], "a", 1), (1, [0.5, 0.0], "a", 1), (2, [0.5, 0.0], "a", 1), (3, [-1.0, 0.0], "a", 1)]
    got = [tuple(r) for r in m.op12(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, -1.0)]


def test_tree_size_is_bounded_by_the_sample():
    rng = np.random.default_rng(0)
    tree = m.grow(rng.normal(size=(5000, 6)), 10.0)
    assert tree.leaves <= 5000 // 2 and sorted(tree.leaf[tree.leaf >= 0]) == list(range(tree.leaves))
    q = rng.normal(size=(5, 6))
    assert (np.sort(tree.visits(q, tree.leaves), axis=1) == np.arange(tree.leaves)).all()
    same = m.grow(np.ones((500, 6)), 10.0)
    assert same.leaves == 1 and same.leaf_of(np.ones((3, 6))).tolist() == [0, 0, 0]
