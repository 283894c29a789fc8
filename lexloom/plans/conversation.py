"""One turn of many conversations: history and facts in, answers and new history out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.questions import history_text
from lexloom.plans.answer import answer
from lexloom.session import checkpointed
from lexloom.sources import memory

HISTORY_TURNS = 4


def merged_facts(prior: Column, new: Column) -> Column:
    """Both maps; a key of the new one wins."""
    none = F.create_map().cast("map<string,string>")
    prior, new = F.coalesce(prior, none), F.coalesce(new, none)
    kept = F.map_filter(prior, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def messages(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The last ``n`` turns per session as messages: two rows per turn, question before reply."""
    last = memory.history_window(turns, n)
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("user_query").alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.col("assistant_response").alias("text")),
    )
    rows = last.select("session_id", "turn_index", F.posexplode(pair).alias("half", "m")).where("coalesce(m.text, '') <> ''")
    return rows.select("session_id", (F.col("turn_index") * 2 + F.col("half")).alias("turn_index"), "m.role", "m.text")


def converse(requests: DataFrame, turns: DataFrame, facts: DataFrame, chunks: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answer one request per session and round.

    ``requests``: query_id, session_id, query, ts, known_facts (map, may be null).
    ``turns``: session_id, turn_index, ts, user_query, assistant_response.
    ``facts``: session_id, facts, seq. ``options`` go to ``answer``.
    Returns the answers (with session_id and turn_index), the new turns to append, and the facts as
    they are afterwards.
    """
    mine = requests.select("session_id").distinct()
    said = history_text(messages(memory.get_history(turns, mine)))
    known = memory.get_facts(facts.join(mine, "session_id", "left_semi")).withColumnRenamed("facts", "__prior")
    asked = requests.join(said, "session_id", "left").join(known, "session_id", "left")
    asked = checkpointed(asked.withColumn("facts", merged_facts(F.col("__prior"), F.col("known_facts"))).drop("__prior", "known_facts"))
    answers = checkpointed(answer(asked, chunks, **options))
    said_now = answers.select(
        "query_id", "session_id", "ts", F.col("query").alias("user_query"), F.col("final_answer").alias("assistant_response")
    )
    new_turns = checkpointed(memory.append_turn(turns, said_now))
    out = answers.join(new_turns.select("query_id", "turn_index"), "query_id", "left")
    new_facts = asked.where(F.size("facts") > 0).select("session_id", "facts", F.col("ts").cast("long").alias("seq"))
    return out, new_turns.drop("query_id"), memory.save_facts(facts, new_facts)
