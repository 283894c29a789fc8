"""Suffix, substring and SimHash deduplication against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash

from lexloom.llm import alike, blocks, simhash_dedup, substring_dedup, suffix_dedup
from lexloom.llm.common import LOWER, SPACE
from lexloom.llm.components import components

from .conftest import by_id

LAST = 1 << 62


def _bytes_brute(rows):
    first = {}
    for i, t in sorted(((LAST if r[0] is None else r[0]), r[1] or "") for r in rows):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for r in rows:
        b, i = (r[1] or "").encode(), LAST if r[0] is None else r[0]
        drop = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                drop[k + 1 : k + 51] = True
        kept = bytes(x for x, d in zip(b, drop[1:], strict=False) if not d)
        out.append((r[0], len(b), int(drop.sum()), int((drop[1:] & ~drop[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, repr(r)))


def _words_brute(rows):
    first = {}
    for i, t in sorted(((LAST if r[0] is None else r[0]), r[1] or "") for r in rows):
        w = t.encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for r in rows:
        w, i = (r[1] or "").encode().split(), LAST if r[0] is None else r[0]
        drop = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                drop[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, d in zip(w, drop, strict=True) if not d)
        out.append((r[0], len(w), sum(drop), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, repr(r)))


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_suffix_dedup(docs, rows, block):
    out = suffix_dedup.deduplicated(docs, block, 2 * block)
    assert by_id(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _bytes_brute(rows)


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_substring_dedup(docs, rows, block):
    out = substring_dedup.deduplicated(docs, block, 2 * block)
    assert by_id(out, "doc_id", "n_words", "n_removed", "kept_sha256") == _words_brute(rows)


def test_empty_tables(no_docs):
    assert suffix_dedup.op3(no_docs).collect() == []
    assert substring_dedup.op5(no_docs).collect() == []
    assert simhash_dedup.op9(no_docs).collect() == []
    assert simhash_dedup.deduplicated(no_docs).collect() == []


def test_index_family_merges_levels():
    rng = np.random.default_rng(3)
    family, all_keys, all_ids = blocks.IndexFamily(), [], []
    for i in range(40):
        k = np.unique(rng.integers(0, 500, 50)).astype(np.uint64)
        family.add(k, np.full(len(k), i))
        all_keys.append(k)
        all_ids.append(np.full(len(k), i))
    assert len(family.levels) <= 8
    k, ids = np.concatenate(all_keys), np.concatenate(all_ids)
    probe = np.arange(500, dtype=np.uint64)
    want = [min(ids[k == p], default=blocks.LAST) for p in probe]
    assert family.least(probe).tolist() == want


def test_keys_round_trip():
    rng = np.random.default_rng(4)
    for n in (1, 3, 5000):
        keys = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for bits in (2, 5):
            for _, p in blocks.by_slice(keys, bits):
                got = blocks.long_keys(blocks.short_keys(keys[p], bits))
                assert got.tolist() == ((keys[p] << np.uint64(bits)) >> np.uint64(32)).astype(np.int64).tolist()
    for ids in (np.array([5, 9, 2]), np.array([0, blocks.LAST])):
        assert blocks.unpacked_ids(blocks.packed_ids(ids)).tolist() == ids.tolist()


def _fingerprint(text):
    w = (text or "").encode().translate(bytes(LOWER)).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs, rows):
    fps = [_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", least.get(find(i))) for i, (r, f) in enumerate(zip(rows, fps, strict=True))), key=lambda r: (r[0] is None, repr(r)))
    assert by_id(simhash_dedup.op9(docs), "doc_id", "fingerprint", "component_id") == want


def test_xxh64_of_all_lengths():
    text = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    s = np.concatenate((np.zeros(700, np.int64), np.arange(700)))
    e = np.concatenate((np.arange(700), np.arange(700) + 33))
    got = simhash_dedup.xxh64(text, s, e)
    assert got.tolist() == [xxhash.xxh64_intdigest(text[a:b].tobytes(), seed=42) for a, b in zip(s, e, strict=True)]


@pytest.mark.parametrize("radius", [2, 4, 5])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    masks = simhash_dedup.covering_masks(list(range(64)), radius)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(m & diff == 0 for m in masks)
        m = next(m for m in masks if m & diff == 0)
        assert any(f & diff == 0 for f in simhash_dedup.finer_masks(m, radius))


def test_oversized_buckets_are_split_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    center = int(rng.integers(0, 1 << 62))
    fps = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(900)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    a = np.array(fps).view(np.uint64)
    root = list(range(len(a)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 4):
            root[find(i)] = find(int(j))
    want = {}
    for i in range(len(a)):
        want.setdefault(find(i), set()).add(fps[i])
    monkeypatch.setattr(simhash_dedup, "BUCKET", 40)
    monkeypatch.setattr(simhash_dedup, "FREE_BITS", 5)
    edges = simhash_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {}
    for r in components(edges).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    out = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["root"] for r in out.collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}}


def test_deduplicated_keeps_one_row_of_each_group(docs, rows):
    kept = simhash_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    some = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert 7 in some and not {8, 9, *range(200, 208)} & set(some)  # copies, and one changed word of 400
    assert some.count(16) == 2 and len(some) == len(set(some)) + 1  # two texts share this id
    assert [r["text"] for r in got if r["doc_id"] is None] == [r[1] for r in rows if r[0] is None and r[1]]  # the text; null is alike to empty
    assert set(range(100, 160)) - set(some) <= {r[0] for r in rows if r[1] and len(r[1].split()) < 8}


def test_deduplicated_with_one_id_or_none_and_columns_that_cannot_be_compared(spark):
    texts = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(40)]
    for ids in ([None] * 40, [5] * 40, [5 if i % 3 == 0 else None for i in range(40)]):
        rows = [(i, t, {"k": 1}, "n") for i, t in zip(ids, texts, strict=True)] * 2
        df = spark.createDataFrame(rows, "doc_id long, text string, h map<string, int>, row string").repartition(3)
        got = simhash_dedup.deduplicated(df)
        assert got.columns == df.columns and sorted(r["text"] for r in got.collect()) == sorted(texts)


def _pairs(sets, least):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]) > 0:
                root = [root[j] if x == root[i] else x for x in root]
    return root


def _same_parts(edges, root):
    got = list(range(len(root)))
    for a, b in edges:
        got = [got[b] if x == got[a] else x for x in got]
    part = lambda r: sorted(sorted(i for i, x in enumerate(r) if x == y) for y in set(r))
    return part(got) == part(root)


def _random_sets(rng, n, words):
    sets = []
    for _ in range(n):
        if sets and rng.random() < 0.7:
            s = set(sets[rng.integers(0, len(sets))])
            for _ in range(int(rng.integers(0, 4))):
                s.discard(next(iter(s)) if s else None)
                s.add(int(rng.integers(0, words)))
        else:
            s = set(rng.integers(0, words, int(rng.integers(1, 30))).tolist())
        sets.append(s)
    return sets


def test_forest_of_similar_sets():
    rng = np.random.default_rng(21)
    for words in (30, 100, 5000):
        for _ in range(20):
            sets = _random_sets(rng, 60, words)
            edges = alike.spanning_edges([np.array(sorted(s), np.int64) for s in sets], 0.8)
            assert _same_parts(edges, _pairs(sets, 0.8)) and len(edges) < 60


@pytest.mark.parametrize("weight", [10**6, 150, 30])
def test_links_of_groups_of_any_weight(spark, weight):
    sets = _random_sets(np.random.default_rng(22), 120, 60)
    sets = [s for i, s in enumerate(sets) if s not in sets[:i]]
    nodes = spark.createDataFrame([(1, i, len(s)) for i, s in enumerate(sets)] + [(2, i, len(s)) for i, s in enumerate(sets)] + [(3, 0, len(sets[0]))], "g long, node long, size long")
    known = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, shingles array<long>")
    found = alike.links(nodes, lambda wanted: wanted.join(known, "node").select("g", "node", "shingles"), 0.8, weight)
    edges = [tuple(r) for r in found.collect()]
    assert _same_parts(edges, _pairs(sets, 0.8)) and all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in edges)


def test_templated_pages_are_not_compared_in_pairs(monkeypatch):
    """One changed word of thirty: 0.68 alike, so no page can match another."""
    pages = [np.array([*range(21), *range(100 + 5 * i, 105 + 5 * i)], np.int64) for i in range(20_000)]
    monkeypatch.setattr(np, "add", None)  # the comparison of sets is never reached
    assert alike.spanning_edges(pages, 0.8) == []


def test_space_table():
    assert [i for i in range(256) if SPACE[i]] == [9, 10, 11, 12, 13, 32]


@pytest.mark.parametrize("radius", [4, 5])
def test_finer_masks_always_have_more_bits(radius):
    todo, seen = simhash_dedup.covering_masks(list(range(64)), radius), 0
    while todo and seen < 3000:
        mask = todo.pop()
        if 64 - mask.bit_count() > simhash_dedup.FREE_BITS:
            finer = simhash_dedup.finer_masks(mask, radius)
            assert all(m & mask == mask and m.bit_count() > mask.bit_count() for m in finer)
            todo += finer[:5]
            seen += 1


def test_oversized_bucket_of_31_free_bits_ends(spark):
    radius = 5
    mask = next(m for m in simhash_dedup.covering_masks(list(range(64)), radius) if m.bit_count() == 33)
    free = [b for b in range(64) if not mask >> b & 1]
    assert len(free) == 31
    rng = np.random.default_rng(9)
    fps = sorted({sum(1 << int(b) for b in rng.choice(free, 4, replace=False)) for _ in range(120)})
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, bucket=100, free_bits=11)
    got = {}
    for r in components(edges).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    a, root = np.array(fps).view(np.uint64), list(range(len(fps)))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= radius):
            old, new = root[i], root[int(j)]
            root = [new if x == old else x for x in root]
    want = {}
    for f, x in zip(fps, root, strict=True):
        want.setdefault(x, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def _sets(text):
    w = (text or "").encode().translate(bytes(LOWER)).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_texts_are_linked_and_others_not(spark):
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(7, 11)))) for _ in range(2000)]
    some = lambda n: [vocab[i] for i in rng.integers(0, len(vocab), n)]
    table, long, short = some(120), some(1500), some(14)
    swapped = list(table)
    rng.shuffle(swapped)
    rows = [(1, table), (2, swapped), (3, swapped[:60] + ["instead"] + swapped[61:]), (4, table), (5, long), (6, [w if i % 55 else "another" for i, w in enumerate(long)]), (13, [*long, *some(300)])]
    rows += [(7, short), (8, [*short, "appended"]), (9, short[:7] + some(7)), (10, ["one"]), (11, ["ONE"]), (12, None)]
    rows += [(20 + i, some(int(rng.integers(1, 60)))) for i in range(20)]
    rows = [(i, w and " ".join(w)) for i, w in rows]
    sets, fps, root = [_sets(t) for _, t in rows], [_fingerprint(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
            if alike or (fps[i] ^ fps[j]).bit_count() <= 4:
                root = [root[j] if x == root[i] else x for x in root]
    want = [(rows[i][0], min(r[0] for r, x in zip(rows, root, strict=True) if x == root[i])) for i in range(len(rows))]
    assert dict(want)[2] == 2 and dict(want)[3] == 2 and dict(want)[8] == 7 and dict(want)[9] == 9 and dict(want)[6] == 5 and dict(want)[13] == 5
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=True)
    assert by_id(got, "doc_id", "component_id") == sorted(want, key=lambda r: repr(r))
