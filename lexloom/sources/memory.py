"""Session history and accumulated facts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.blocked import BLOCK, dense_index


def append_turn(turns: DataFrame, new_turns: DataFrame, order: str = "ts", block: int | None = BLOCK) -> DataFrame:
    """New turns with turn_index continuing the count of their session.

    ``block`` is a width in units of ``order``; it spreads one very busy session.
    """
    so_far = turns.groupBy("session_id").agg(F.count("*").alias("__n"))
    new = new_turns.withColumn("__pos", F.col(order).cast("long"))
    new = dense_index(new, ["session_id"], "__pos", "__i", block=block)
    out = new.join(so_far, "session_id", "left")
    ix = (F.coalesce("__n", F.lit(0)) + F.col("__i") + 1).cast("int")
    return out.withColumn("turn_index", ix).drop("__n", "__i", "__pos")


def get_history(turns: DataFrame, session_id) -> DataFrame:
    """Turns of one session (a value) or of several (a frame of session_id)."""
    if isinstance(session_id, DataFrame):
        return turns.join(session_id.select("session_id").distinct(), "session_id", "left_semi")
    return turns.where(F.col("session_id") == F.lit(session_id))


def clear_session(turns: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Turns without the given sessions. Facts are another table and stay."""
    return turns.join(session_ids.select("session_id"), "session_id", "left_anti")


def save_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Merge (session_id, facts, seq) rows key by key; the newest value of a key wins."""
    every = facts.select("session_id", "facts", "seq").unionByName(new.select("session_id", "facts", "seq"))
    pairs = every.select("session_id", "seq", F.explode("facts").alias("k", "v"))
    best = pairs.groupBy("session_id", "k").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))
    return best.groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("facts"),
        F.max("seq").alias("seq"),
    )


def get_facts(facts: DataFrame) -> DataFrame:
    """The record saved last per session."""
    return facts.groupBy("session_id").agg(F.max_by("facts", "seq").alias("facts"))


def history_window(turns: DataFrame, n: int = 4) -> DataFrame:
    """The last ``n`` turns per session; partial top-n runs before the shuffle."""
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").desc())
    return turns.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
