"""Gates, hints, hooks and memory of the answer flow."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import evidence as E
from lexloom.operators import retrieval as V
from lexloom.plans.answer import answer, chat_result
from lexloom.plans.conversation import converse, merged_facts


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (f"c{i}", "legal_acts_patent", area, "all", "india", "1", "act", str(3 + i), "The Patents Act", f"{area} law on patent of herbal formulation section {3 + i}")
        for i, area in enumerate(["patent", "tk_prior_art", "patent", "trademark", "gi", "patent"])
    ]
    names = "chunk_id string, collection_name string, legal_area string, applicable_product string, jurisdiction string, authority_level string, document_type string, section string, source_title string, text string"
    return V.embed(spark.createDataFrame(rows, names), "text", dim=32)


QUERIES = [
    (1, "hello, what can you do?"),
    (2, "can i patent my herbal formulation made of ashwagandha roots and honey?"),
    (3, "can i patent section 3 of the patents act scope"),
]


def test_gates(spark, chunks):
    prompts = {}

    def generator(df):
        prompts.update({r["query_id"]: r["prompt"] for r in df.collect()})
        return df.select("query_id", F.concat(F.lit("reply "), F.col("query_id").cast("string")).alias("answer"))

    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    out = {r["query_id"]: r for r in answer(queries, chunks, dim=32, generator=generator).collect()}
    assert set(out) == {1, 2, 3}
    by_status = {i: r["status"] for i, r in out.items()}
    for i, r in out.items():
        if r["intent"] == "general_info":
            assert r["status"] == "answered" and r["sources"] is None and "Greet the user" in prompts[i]
        if by_status[i] == "needs_clarification":
            fields = [q["field"] for q in r["pending_questions"]]
            assert fields and set(fields) <= set(r["missing_facts"]) and r["pending_questions"][0]["question"] in r["final_answer"]
            assert i not in prompts
    assert "needs_clarification" in by_status.values() or all(not r["missing_facts"] for r in out.values())
    # asked often enough: the flow goes on with an assumption
    later = queries.withColumn("clarification_round", F.lit(2))
    assert all(r["status"] != "needs_clarification" for r in answer(later, chunks, dim=32, generator=generator).collect())
    assert chat_result(answer(queries, chunks, dim=32)).columns == ["query_id", "status", "answer", "sources", "questions"]


def test_hints_reach_the_retry(spark):
    seen = []

    def attempt(part, round_no):
        seen.append(part.columns)
        return part.drop("unverified").withColumns({"status": F.lit("abstained" if round_no == 0 else "answered"), "unverified": F.array(F.lit("Section 9"))})

    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")
    out = E.retry_loop(queries, attempt)
    assert seen == [["query_id", "query"], ["query_id", "query", "unverified"]] and out.first()["status"] == "answered"


def test_conversation(spark, chunks):
    requests = spark.createDataFrame(
        [(1, "s1", "can i patent section 3 of the patents act scope", 100, {"category": "proprietary"}), (2, "s2", "hello", 100, None)],
        "query_id long, session_id string, query string, ts long, known_facts map<string,string>",
    )
    turns = spark.createDataFrame(
        [("s1", 1, 10, "is turmeric old?", "yes"), ("s9", 1, 10, "other", "other")],
        "session_id string, turn_index int, ts long, user_query string, assistant_response string",
    )
    facts = spark.createDataFrame([("s1", {"category": "classical", "dosage_form": "oil"}, 5)], "session_id string, facts map<string,string>, seq long")
    answers, new_turns, after = converse(requests, turns, facts, chunks, dim=32)
    got = {r["session_id"]: r for r in answers.collect()}
    assert got["s1"]["turn_index"] == 2 and got["s2"]["turn_index"] == 1
    assert got["s1"]["facts"] == {"category": "proprietary", "dosage_form": "oil"} and "turmeric" in got["s1"]["history"]
    assert {r["session_id"] for r in new_turns.collect()} == {"s1", "s2"}
    assert {r["session_id"]: r["facts"] for r in after.collect()}["s1"] == {"category": "proprietary", "dosage_form": "oil"}


def test_merged_facts(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "1"}), (None, None)], "p map<string,string>, n map<string,string>")
    assert [r[0] for r in df.select(merged_facts(F.col("p"), F.col("n"))).collect()] == [{"a": "1", "b": "3"}, {"c": "1"}, {}]


def test_equal_questions_are_searched_once(spark, monkeypatch):
    from lexloom.plans import answer as plan

    rows = [(i, 0, "patent" if i < 4 else "gi", "neem oil" if i != 3 else "clove oil", None) for i in range(6)]
    subs = spark.createDataFrame(rows, "query_id long, area_ix int, legal_area string, query_text string, product_category string")
    texts = [(f"c{j}", a, t) for j, (a, t) in enumerate([("patent", "neem oil"), ("patent", "clove oil"), ("gi", "neem"), ("gi", "oil")])]
    chunks = plan.embed(spark.createDataFrame(texts, "chunk_id string, legal_area string, text string"), "text", dim=64)
    seen = []
    search = plan.filtered_topk
    monkeypatch.setattr(plan, "filtered_topk", lambda q, c, k: seen.append(q.count()) or search(q, c, k))
    got = {}
    for r in plan.retrieve(subs, chunks, dim=64, k=1).collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    each = {r.query_id: r.chunk_id for r in search(plan.embed(plan.route(subs), "query_text", dim=64), chunks, 1).collect()}
    assert seen == [3] and got == {q: [c] for q, c in each.items()} and len(got) == 6
