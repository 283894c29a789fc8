"""The stored inverted index against a plain computation, over batches, and what it leaves closed."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators.lexical import LexicalIndex


def brute(queries, chunks, k):
    words = {i: (t or "").lower().split() for i, t in chunks}
    mean = sum(map(len, words.values())) / sum(t is not None for _, t in chunks)
    df = Counter(w for ws in words.values() for w in set(ws))
    found = {}
    for q, text in queries:
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(
                math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                for w in sorted(set((text or "").lower().split())) if tf[w]
            )
            if s:
                scores.append((-round(s, 6), i))
        found[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return found


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["chunk_id"], pytest.approx(r["score"], abs=2e-6)))
    return out


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.7)) % 60}" for _ in range(4000)]
    chunks = [(f"c{i:03}", " ".join(rnd.choices(words, k=rnd.choice((1, 3, 20, 200))))) for i in range(150)]
    chunks += [("empty", ""), ("null", None), ("tie_a", "w1 w2 w3"), ("tie_b", "W1  w2\nw3")]
    queries = [(i, " ".join(rnd.choices(words, k=4))) for i in range(20)] + [(98, "unheard of"), (99, None), (100, "")]
    return queries, chunks


def test_equals_brute_force_over_batches(spark, tmp_path, data):
    queries, chunks = data
    q = spark.createDataFrame(queries, "query_id int, query_text string")
    index = LexicalIndex(spark, str(tmp_path), shards=3, block_chunks=8)
    for batch, part in enumerate((chunks[:60], chunks[60:61], chunks[61:])):
        index.append(spark.createDataFrame(part, "chunk_id string, text string").repartition(3), batch)
    want = {i: hits for i, hits in brute(queries, chunks, 5).items() if hits}
    assert found(index.topk(q, 5)) == want and len(want) >= 20
    index.append(spark.createDataFrame(chunks[60:61], "chunk_id string, text string"), 1)  # a repeated batch replaces itself
    assert found(index.topk(q, 5)) == want


def test_blocks_below_the_floor_stay_closed(spark, tmp_path):
    rows = [(i, f"common topic{i // 16} topic{i // 16} " + "filler " * (i % 5)) for i in range(640)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1)
    index = LexicalIndex(spark, str(tmp_path), shards=2, block_chunks=4).append(chunks)
    query = [(1, "common topic7"), (2, "topic3 topic9")]
    stored, mean = index._read(), sum(len(t.split()) for _, t in rows) / 640
    table = pa.table({"query_id": [1, 2], "terms": [["common", "topic7"], ["topic3", "topic9"]]})
    opened, _ = index.opened(table, stored, 3, (640, mean, 1.2, 0.75))
    per_query = {r["q"]: r["n"] for r in opened.groupBy("q").agg(F.count("*").alias("n")).collect()}
    assert per_query[0] <= 8 and per_query[1] <= 8  # of 160 blocks
    assert found(index.topk(spark.createDataFrame(query, "query_id int, query_text string"), 3)) == brute(query, rows, 3)


def test_nothing_to_search_or_ask(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "drug")], "query_id int, query_text string")
    assert LexicalIndex(spark, f"{tmp_path}/a").append(none).topk(asked, 3).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "chunk_id long, text string")
    assert LexicalIndex(spark, f"{tmp_path}/b").append(blank).topk(asked, 3).count() == 0
    full = LexicalIndex(spark, f"{tmp_path}/c").append(spark.createDataFrame([(1, "drug")], "chunk_id long, text string"))
    assert full.topk(asked.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        LexicalIndex(spark, f"{tmp_path}/d").topk(asked, 3)
