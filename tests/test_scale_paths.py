"""Large-input paths: tiny bounds must give what no bound gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.operators import chunking, hierarchy, questions, retrieval, structure
from lexloom.plans.ingest import ingest_texts
from lexloom.sources import store
from lexloom.sources.manifest import typed_manifest


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture
def corpus(spark):
    words = ["drug", "patent", "license", "herb", "court", "section", "rule", "food"]
    text = lambda i: " ".join(words[(i * k + k) % 8] for k in range(1, 6))
    chunks = spark.createDataFrame([(f"c{i}", text(i)) for i in range(60)], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, f"{words[i % 8]} {words[(i + 3) % 8]} only{i}") for i in range(12)], "query_id int, query_text string")
    return queries, chunks


def test_bm25_in_slices(corpus, monkeypatch):
    queries, chunks = corpus
    whole = rows(retrieval.bm25_topk(queries, chunks, 4), "query_id", "chunk_id", "score", "rank")
    monkeypatch.setattr(retrieval, "BROADCAST_QUERY_BYTES", 200)
    monkeypatch.setattr(retrieval, "BM25_ROWS", 7)
    assert rows(retrieval.bm25_topk(queries, chunks, 4), "query_id", "chunk_id", "score", "rank") == whole and whole


def test_history_does_not_depend_on_block_borders(spark):
    gap = lambda i: i * 37 + (i % 5)
    text = lambda i: "a capsule with turmeric" if i % 9 == 0 else "can I patent it?"
    turns = spark.createDataFrame([("s", gap(i), "user", text(i)) for i in range(60)], "session_id string, turn_index long, role string, text string")
    value = {"v": F.when(F.col("text").contains("turmeric"), F.col("turn_index"))}
    want = rows(questions._with_history(turns, 8, value), "turn_index", "v")
    assert sum(v is not None for _, v in want) > 50
    for block in (8, 16, 1000):
        assert rows(questions._with_history(turns, 8, value, block), "turn_index", "v") == want


def test_paths_of_any_depth(spark):
    nodes = spark.createDataFrame(
        [("d", i, i - 1 if i else None, "section", str(i), None) for i in range(40)],
        "doc_id string, node_ix int, parent_ix int, node_type string, number string, title string",
    )
    got = {r["node_ix"]: [s["ix"] for s in r["path"]] for r in hierarchy.tree_paths(nodes).collect()}
    assert got == {i: list(range(i + 1)) for i in range(40)}


def test_subqueries_without_areas_or_category(spark):
    chunks = spark.createDataFrame(
        [(f"c{i}", "k", ("patent", "food", None)[i % 3], ("all", "drug")[i % 2], [1.0, i / 10]) for i in range(12)],
        "chunk_id string, collection_name string, legal_area string, applicable_product string, embedding array<double>",
    )
    schema = "query_id int, area_ix int, collection string, filter_areas array<string>, product_category string, embedding array<double>"
    subs = spark.createDataFrame(
        [(1, 0, "k", None, None, [1.0, 0.5]), (2, 0, "k", [], "all", [1.0, 0.5]), (3, 0, "k", ["patent"], "drug", [1.0, 0.5]), (4, 0, "other", None, None, [1.0, 0.0])],
        schema,
    )
    got = rows(retrieval.filtered_topk(subs, chunks, 20), "query_id", "chunk_id")
    ids = lambda q: [c for i, c in got if i == q]
    assert len(ids(1)) == 12 and sorted(ids(2)) == sorted(f"c{i}" for i in range(0, 12, 2))
    assert sorted(ids(3)) == sorted(f"c{i}" for i in range(0, 12, 3)) and ids(4) == []
    assert len(got) == len(set(got))


def test_vectors_that_are_null_or_short_take_no_part(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id int, embedding array<double>")
    for blocked in (None, True):
        assert rows(retrieval.cosine_topk(queries, chunks, 5, blocked=blocked), "query_id", "chunk_id", "rank") == [(1, "a", 1), (1, "d", 2)]


@pytest.mark.parametrize("size", [4, 1000])
def test_equal_spans_stay_two(spark, size):
    docs = spark.createDataFrame([("d", "say hello to all")], "doc_id string, text string")
    spans = spark.createDataFrame([("d", 4, 9), ("d", 4, 9), ("d", 0, 3), ("d", 3, 3)], "doc_id string, start_char int, end_char int")
    assert rows(structure.slice_spans(spans, docs, size=size), "original_text") == [("",), ("hello",), ("hello",), ("say",)]


def exchanges(df):
    """The exchanges of a plan, one line each, with all joins by hash."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [line for line in plan.splitlines() if "Exchange " in line]


def test_cut_spans_equal_sliced_spans(spark):
    rng = random.Random(3)
    docs = [(f"d{i}", "".join(rng.choice("ab é\U0001d11e\n") for _ in range(rng.randint(0, 60)))) for i in range(12)] + [("none", None)]
    docs = spark.createDataFrame(docs, "doc_id string, text string")
    spans = [(f"d{rng.randint(0, 13)}", rng.randint(-2, 55), rng.choice([None, rng.randint(-2, 70)])) for _ in range(200)]
    spans = spark.createDataFrame(spans + spans[:5] + [("d1", None, 4), ("none", 0, 3)], "doc_id string, start_char int, end_char int")
    cols = ("doc_id", "start_char", "end_char", "original_text")
    for size in (7, 4096):
        assert rows(structure.cut_spans(spans, docs, size=size), *cols) == rows(structure.slice_spans(spans, docs, size=7), *cols)


def test_texts_of_nodes_are_exchanged_by_document_only(spark):
    docs = spark.createDataFrame([("d", "<<<HEADING>>>Section 1. One<<<END_HEADING>>>\ntext of it")], "doc_id string, text string")
    nodes = spark.createDataFrame([("d", 0, 56)], "doc_id string, start_char int, end_char int")
    found = exchanges(hierarchy.slice_text(nodes, docs))
    assert len(found) == 2 and all(re.search(r"hashpartitioning\(doc_id#\d+, \d+\)", x) for x in found)


def test_ids_without_repeats_need_no_join(spark):
    chunks = spark.createDataFrame([("x", 1, "a"), ("y", 1, "b")], "chunk_id string, position long, text string")
    assert exchanges(store.unique_ids(chunks)) == []
    assert rows(store.unique_ids(chunks), "chunk_id") == [("x",), ("y",)]


def test_character_windows_equal_joined_characters():
    rng = random.Random(4)
    for _ in range(500):
        text = rng.choice("\nab") + "".join(rng.choice("abc .") for _ in range(rng.randint(0, 40)))
        size = rng.randint(2, 12)
        overlap = rng.randint(0, size - 1)
        assert list(chunking._char_windows(text, size, overlap)) == list(chunking._windows(list(text), size, overlap))


def test_repealed_texts_pass_the_first_look():
    for text in ("REPEALED", "was Om\u0131t", "OM\u0130TTED", "deleted.", "Repeal"):
        assert structure._REPEALED.search(text) and structure.may_be_repealed(text)
    assert not structure.may_be_repealed("in force")


def test_equal_ids_and_positions_get_unique_ids(spark):
    chunks = spark.createDataFrame(
        [("x", 1, "a"), ("x", 1, "b"), ("x", 1, "b"), ("x", 2, "c"), ("y", 1, "d")], "chunk_id string, position long, text string"
    )
    got = rows(store.unique_ids(chunks), "chunk_id")
    assert got == [("x",), ("x_dup1_1",), ("x_dup1_2",), ("x_dup2",), ("y",)]
    assert store.unique_ids(chunks).select("point_id").distinct().count() == 5


def test_documents_have_their_own_chunk_sizes(spark):
    text = "word " * 300
    docs = spark.createDataFrame([("a", text), ("b", text), ("c", text)], "doc_id string, text string")
    manifest = typed_manifest(spark.createDataFrame(
        [("a", "A", "x", "200", "0", "no"), ("b", "B", "x", "", "", "yes")],
        "source_id_external string, title string, collection_name string, chunk_size string, chunk_overlap string, enable_contextual_retrieval string",
    ))
    rows_ = ingest_texts(docs, manifest, dim=8).collect()
    longest = {i: max(len(r["split_text"]) for r in rows_ if r["source_id"] == i) for i in "abc"}
    assert longest["a"] <= 200 and longest["b"] > 900 and longest["c"] > 900
    assert {r["generated_context"] for r in rows_ if r["source_id"] == "a"} == {""}
    assert all(r["generated_context"] for r in rows_ if r["source_id"] == "b")


def test_lines_of_words_in_any_order(spark):
    rng = random.Random(5)
    words = [
        (doc, page, ix, rng.choice(["a", "b c", "", None, "\x01", "é"]), rng.choice([0.2, 12.7, 12.9, None]),
         rng.choice([None, 0.0, 10.1, 14.2]), rng.choice([None, "Serif", "Serif-BOLD"]))
        for doc, page, n in (("d", 1, 40), ("d", 3, 25), ("e", 1, 9), (None, 1, 3), ("f", None, 2)) for ix in range(n)
    ]
    schema = "doc_id string, page int, word_ix int, text string, top double, size double, fontname string"
    expected = []
    for doc, page in (("d", 1), ("d", 3), ("e", 1)):
        here = [w for w in words if w[:2] == (doc, page)]
        sizes = [round(w[5]) for w in here if w[5]]
        modal = max(sizes, key=lambda s: (sizes.count(s), -sizes.index(s))) if sizes else 12
        parts = []
        for y in sorted({w[4] if w[4] is None else round(w[4]) for w in here}, key=lambda y: (y is not None, y)):
            line = [w for w in here if (w[4] if w[4] is None else round(w[4])) == y]
            text = " ".join(w[3] for w in line if w[3] is not None)
            head = max(round(w[5] or 0) for w in line) > modal or any("bold" in (w[6] or "").lower() for w in line)
            parts.append(f"\n<<<HEADING>>>{text}<<<END_HEADING>>>" if head else text)
        expected.append((doc, page, "\n".join(parts), modal, 3 if doc == "d" else 1))
    cols = ("doc_id", "page", "text", "modal_size", "total_pages")
    shuffled = rng.sample(words, len(words))
    plain = [(w[0], w[1], w[2], "w", 0.2, 10.1, None) for w in words if w[0] == "d"]
    for given in (words, shuffled):
        df = spark.createDataFrame(given, schema)
        assert rows(structure.assemble_lines(df), *cols) == sorted(expected, key=repr)
        assert rows(structure.assemble_lines(df, structure.modal_font_size(df)), *cols) == sorted(expected, key=repr)
        assert len(exchanges(structure.assemble_lines(df))) == 1
    one = rows(structure.assemble_lines(spark.createDataFrame(plain, schema)), "page", "text")
    assert one == [(1, " ".join(["w"] * 40)), (3, " ".join(["w"] * 25))]
