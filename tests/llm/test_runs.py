"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lexloom.llm.periodic_runs import find_runs, op11, periodic_runs, planted
from tests.llm.conftest import by_id


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    words = split(text)
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = None
    for s, length, p in runs:
        if best is None or length * best[2] > best[1] * p or (length * best[2] == best[1] * p and (s, p) < (best[0], best[2])):
            best = (s, length, p)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples():
    rng = random.Random(11)
    yield []
    yield [0] * 23
    yield [0] * 24
    yield [0, 1] * 12
    yield fibonacci(400)
    yield ([0] * 8 + [1]) * 5 + [2] * 30
    yield ([0, 1] * 4 + [0]) * 4  # a period whose windows have a smaller one
    for _ in range(150):
        size, letters = rng.randint(1, 300), rng.choice([1, 2, 2, 3, 50])
        words = [rng.randrange(letters) for _ in range(size)]
        for _ in range(rng.randint(0, 3)):
            root = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 5, 8, 9, 17, 18, 36, 70]))]
            k = rng.randint(0, len(words))
            words[k:k] = root * rng.randint(2, 6) + root[: rng.randint(0, len(root))]
        yield words


def test_runs_equal_the_plain_search():
    texts = list(samples())
    sizes = np.array([len(t) for t in texts])
    x = np.concatenate([np.array(t + [-1 - k]) for k, t in enumerate(texts)]).astype(np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    got = [[] for _ in texts]
    for s, e, p in find_runs(x, sizes).tolist():
        k = int(np.searchsorted(base, s, side="right")) - 1
        got[k].append((s - int(base[k]), e - s, p))
    for words, runs in zip(texts, got, strict=True):
        assert sorted(runs) == plain_runs(words)


def test_one_very_long_text_in_linear_time():
    n = 400_000
    x = np.concatenate((np.arange(n) % 1000, [-1])).astype(np.int64)
    assert find_runs(x, np.array([n])).tolist() == [[0, n, 1000]]


def test_equal_hashes_of_unequal_words_are_noticed(monkeypatch):
    from lexloom.llm import periodic_runs as module

    real = module._common
    monkeypatch.setattr(module, "_common", lambda *a: np.minimum(real(*a) + 3, a[3]))
    words = list(range(100, 112)) * 4 + list(range(200, 230))
    runs = find_runs(np.array([*words, -1], np.int64), np.array([len(words)]))
    assert runs.tolist() == [[0, 48, 12]]


def test_query_equals_brute_force(docs, rows):
    got = by_id(op11(docs), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, repr(r)))
    assert sum(r[1] for r in got) > 3


def test_texts_and_spans(spark):
    df = spark.createDataFrame([(None, "x " + "a b c " * 9 + "y", 1), (7, None, 2), (7, "", 3)], "doc_id long, text string, runs int")
    out = {(r["doc_id"], r["n_words"]): r for r in periodic_runs(df).collect()}
    assert out[None, 29]["collapsed"] == "x a b c y" and [tuple(r) for r in out[None, 29]["runs"]] == [(1, 27, 3)]
    assert out[7, 0]["collapsed"] == "" and len(periodic_runs(df).collect()) == 3


def test_no_rows(no_docs):
    assert op11(no_docs).collect() == []


@pytest.mark.parametrize("doc_id,n", [(None, 10), (1, 0)])
def test_nothing_is_planted_without_id_or_words(doc_id, n):
    assert planted(doc_id, n) is None
