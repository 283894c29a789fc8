"""Quotient filters and collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexloom.llm import collocations as m
from lexloom.llm.quotient_filter import Layout, build, merge


@pytest.mark.parametrize("bits,quotient_bits", [(9, 8), (34, 8), (47, 10), (64, 12)])
def test_keys_come_back_whole(bits, quotient_bits):
    rng = np.random.default_rng(bits)
    keys = np.unique(rng.integers(0, 1 << bits, 2000, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**63, 2000, dtype=np.uint64) * 2)
    layout = Layout(bits, quotient_bits)
    x = layout.permuted(keys)
    assert len(np.unique(x)) == len(keys) and (layout.restored(x) == keys).all()
    quotient, rest = layout.divided(x)
    assert (layout.unpack(layout.pack(rest)) == rest).all()
    for q in np.unique(quotient)[:20]:
        assert sorted(layout.whole(int(q), rest[quotient == q])) == sorted(keys[quotient == q])


def test_merged_filters_count_like_one():
    rng = np.random.default_rng(3)
    layout, runs, plain = Layout(20, 4), defaultdict(list), Counter()
    for _ in range(7):
        keys = rng.integers(0, 3000, 5000).astype(np.uint64)
        plain.update(keys.tolist())
        quotient, ends, rest, counts = build(keys, layout)
        for q, a, b in zip(quotient.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            runs[q].append((rest[a:b], counts[a:b]))
    got = {}
    for q, parts in runs.items():
        r, c = merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        got |= dict(zip(layout.whole(q, r).tolist(), c.tolist(), strict=True))
    assert got == dict(plain)


def test_keys_beyond_64_bits_are_refused():
    with pytest.raises(ValueError):
        Layout(65, 8)


def plain(rows, min_count, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, count in f.items():
        often = {g: a for g, a in count.items() if a >= min_count}
        found = []
        for g, a in often.items():
            if len(g) == 1:
                continue
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in often.items()):
                continue
            score, k = min((2_000_000 * a // (count[g[:k]] + count[g[k:]]), k) for k in range(1, len(g)))
            found.append((lang, " ".join(g), a, count[g[:k]], count[g[k:]], n[lang], score))
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(found[:top])]
    return sorted(out)


def texts():
    rng = random.Random(13)
    words = ["The", "new", "york", "Times", "of", "é", "\x01x", "über"]
    rows = [(None, "New York, new york. NEW YORK\tnew  york\x0bnew york"), ("en", None), ("en", ""), ("en", " ,.; "), ("de", "a" * 3000)]
    for k in range(80):
        rows.append((["en", "de", None, "und"][k % 4], "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n"]) for _ in range(rng.randint(0, 120)))))
    return rows + [("en", "of the new york times")] * 40


def test_query_equals_plain_counting(spark, monkeypatch):
    rows = texts()
    monkeypatch.setattr(m, "SHARD_BYTES", 700)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, shard long, phrase string").repartition(3)
    got = sorted(tuple(r) for r in m.op13(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(rows, 30, 2000) and len(got) > 30


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 10**13
    every = spark.createDataFrame([("en", ["a"], big, "a"), ("en", ["b"], 3 * big, "b"), ("en", ["a", "b"], big - 1, "a b")], "lang string, words array<string>, a long, phrase string")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    monkeypatch.setattr(m, "counted", lambda *a: (every, totals))
    row = m.collocations(None).collect()[0]
    assert row["score"] == 2_000_000 * (big - 1) // (4 * big) and row["inside"] is False


def test_nothing_frequent(spark, no_docs, docs):
    assert m.op13(no_docs).collect() == []
    assert m.op13(docs.limit(3)).collect() == []


def test_python_gets_few_shards_at_once(spark, monkeypatch):
    frame, seen = type(spark.range(0)), []
    run, many = frame.mapInArrow, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, **b: seen.append((f.__qualname__.split(".")[0], int(spark.conf.get(many)))) or run(self, f, schema, *a, **b))
    docs = spark.createDataFrame([("en", "one two three four. " * 20)] * 40, "lang string, text string").coalesce(1)
    every, totals = m.counted(docs)
    assert {tuple(r["words"]): r["a"] for r in every.collect()}["one", "two", "three", "four"] == 800
    limits = {name: max(n for x, n in seen if x == name) for name, _ in seen}
    assert limits["shards"] <= 500 and limits["word_states"] == limits["advanced"] == 1


def test_small_batches_fill_a_shard():
    batch = m.pa.RecordBatch.from_pydict({"lang": ["en"] * 10 + [None], "text": ["x" * 1000] * 9 + [None, "y" * (3 << 20)]})
    sizes = [[len(t or "") for t in b["text"].to_pylist()] for b in m._stretches([batch] * 300)]
    assert sum(map(len, sizes)) == 3300 and [3 << 20] in sizes
    plain = [sum(x) for x in [[len(t or "") for t in b["text"].to_pylist()] for b in m._stretches([batch.slice(0, 10)] * 1000)]]
    assert sum(plain) == 9_000_000 and max(plain) <= m.SHARD_BYTES and len(plain) == 5
