import uuid

from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions.text import strip, uuid5
from lexloom.operators import citations as T
from lexloom.operators import questions as Q
from lexloom.sources import manifest as M
from lexloom.streaming.sessions import session_machine, session_machine_batch


def _classified(spark, *texts, facts=None):
    df = spark.createDataFrame([(i, t, facts or {}) for i, t in enumerate(texts)], "query_id long, query string, facts map<string,string>")
    return {r.query_id: r for r in Q.classify(Q.understand(df), "facts").collect()}


def test_golden_questions(spark):
    r = _classified(
        spark, "Hello, who are you?", "I have a special herbal extract, can I protect it?", "classical ashwagandha churna patent", "license for my proprietary neem blend",
        "What is novelty for an invention?")
    assert r[0].intent == "general_info" and r[0].raw_product_description is None
    assert r[1].category == "unclassified" and r[1].missing_facts == ["category"]
    assert r[2].category == "classical" and r[2].ingredients == ["Ashwagandha (Withania somnifera)"] and r[2].missing_facts == []
    assert r[3].category == "proprietary" and r[3].missing_facts == ["route_of_administration"]
    assert r[4].missing_facts == []
    seeded = _classified(spark, "I have a special herbal extract, can I protect it?", facts={"category": "proprietary", "route_of_administration": "oral"})
    assert seeded[0].category == "proprietary" and seeded[0].missing_facts == []


def test_areas_follow_category_then_enumeration(spark):
    df = spark.createDataFrame([("cosmetic", "is section 3 law about benefit", ["Neem (x)"])], "c string, q string, i array<string>")
    got = df.select(R.select_areas(F.col("c"), F.col("q"), F.col("i"))).first()[0]
    assert got == ["trademark", "drug_regulation", "patent", "abs", "tk_prior_art", "gi"] or got == ["trademark", "drug_regulation", "patent", "abs", "tk_prior_art"]


def _turns():
    return [
        ("s1", 1, "compliance for my proprietary neem blend"), ("s1", 2, "it is an oral tablet"), ("s1", 3, "license for the same"),
        ("s2", 1, "can I patent my herbal mixture"), ("s2", 2, "no idea"), ("s2", 3, "still nothing"), ("s2", 4, "can I patent my herbal mixture"),
        ("s3", 1, "hello"), ("s3", 2, "patent for a classical taila, india"),
    ]


def test_session_machine_rounds(spark):
    df = spark.createDataFrame(_turns(), "session_id string, turn_index long, text string")
    got = {(r.session_id, r.turn_index): r for r in session_machine_batch(df).collect()}
    assert got[("s1", 1)].status == "needs_clarification" and got[("s1", 1)].pending == ["route_of_administration"]
    assert got[("s1", 2)].status == "answered" and got[("s1", 2)].route_of_administration == "oral" and got[("s1", 2)].clarification_round == 1
    assert [got[("s2", i)].status for i in (1, 2, 3, 4)] == ["needs_clarification", "needs_clarification", "answered", "answered"]
    assert got[("s3", 1)].status == "answered" and got[("s3", 2)].known_facts["jurisdiction"] == "india"


def test_session_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(_turns(), "session_id string, turn_index long, text string")
    for i in (1, 2, 3, 4):  # one file per turn: state crosses micro-batches
        df.where(F.col("turn_index") == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"t{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = (session_machine(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    q.awaitTermination()
    cols = ["session_id", "turn_index", "status", "clarification_round", "pending", "category"]
    # files of one turn arrive in name order
    a = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()))
    b = sorted(map(str, session_machine_batch(df).select(*cols).collect()))
    assert a == b


def test_history_halo_equals_plain_frame(spark):
    rows = [("s", i, "user" if i % 2 else "assistant", "my neem cream" if i % 11 == 1 else "what about this") for i in range(60)]
    df = spark.createDataFrame(rows, "session_id string, turn_index long, role string, text string")
    vals = {"d": F.when(F.col("text") == "my neem cream", F.col("turn_index"))}
    a = Q._with_history(df, 5, vals).collect()
    b = Q._with_history(df, 5, vals, block=7).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_uuid_and_strip(spark):
    names = ["abc", "é-ü", "x_dup3", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    odd = spark.createDataFrame([("   a b　\n\x1f",)], "t string")
    assert odd.select(strip(F.col("t"))).first()[0] == "a b"


def test_manifest_csv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("﻿source_id_external,title,is_ingested,chunk_size,applicable_products,collection_name\nA-1, T ,TRUE,500,classical,\n,x,,,,\nA-2,U,maybe,-1,,c\n".encode())
    rows = {r.source_id: r for r in M.read_manifest(spark, str(p)).collect()}
    assert set(rows) == {"A-1", "A-2"}
    a, b = rows["A-1"], rows["A-2"]
    assert (a.title, a.is_ingested, a.chunk_size, a.applicable_product, a.collection_name) == ("T", True, 500, "classical", "legal_acts")
    assert (b.is_ingested, b.chunk_size, b.applicable_product, b.document_type) == (False, 1000, "all", "act")


def test_citation_numbers_follow_first_use(spark):
    ans = spark.createDataFrame([("a", "x (Ref: c2) y [Excerpt 1, Ref: c1] z (Ref: c2) (Ref: nope) (Ref: c1-sub)")], "answer_id string, answer string")
    src = spark.createDataFrame([("a", 1, "c1", "d1", ["c1"]), ("a", 2, "k", "d2", ["c2"])], "answer_id string, source_no int, id string, doc_id string, chunk_ids array<string>")
    r = T.index_citations(ans, src).first()
    assert r.processed_text == "x  [^1](#citation:c2)  y  [^2](#citation:c1)  z  [^1](#citation:c2)  (Ref: nope)  [^2](#citation:c1-sub) "
    assert r.cited_chunks == ["k", "c1"]


def test_highlight_span(spark):
    df = spark.createDataFrame(
        [("An Invention which, in effect, is old", " invention which, "), ("alpha beta gamma delta epsilon zeta", "alpha beta gamma xx delta epsilon zeta"), ("abc", "zz")], "f string, e string")
    got = [r[0] and (r[0].start, r[0].end) for r in df.select(T.highlight_span(F.col("f"), F.col("e"))).collect()]
    assert got == [(3, 19), (0, 35), None]
