"""Clarification sessions: one state record per session, batch and streaming.

All text rules run natively before the stateful step; what remains per turn is a
small state transition. Rows stream through in order and only the state record is kept.
A long session is folded in blocks whose effects are composed (``entry_states``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions.blocked import dense_index
from lexloom.functions.constants import CATEGORIES, LOAD_BEARING_FIELDS, ROUTE_FACTS, USE_FACTS
from lexloom.session import checkpointed

OUT_SCHEMA = (
    "session_id string, turn_index long, status string, clarification_round int, awaiting boolean, "
    "pending array<string>, known_facts map<string,string>, category string, route_of_administration string"
)
MAX_ROUNDS = 2


def turn_features(turns: DataFrame) -> DataFrame:
    """Rule results per user turn, from session_id, turn_index and text (optionally new_topic)."""
    d = turns.withColumn("__low", F.lower("text")).withColumn("intent", R.intent(F.col("__low")))
    d = d.withColumns(
        {
            "desc": R.product_description(F.col("text"), F.col("__low"), F.col("intent")),
            "mention": R.jurisdiction_mention(F.col("__low")),
            "slots": F.to_json(R.slot_answers(F.col("__low"))),
            "new_topic": F.col("new_topic") if "new_topic" in turns.columns else F.lit(False),
        }
    )
    rule = F.col("desc").isNotNull()
    return d.select(
        F.col("session_id").cast("string").alias("session_id"), F.col("turn_index").cast("long").alias("turn_index"),
        "intent", "desc", "mention", "slots", "new_topic",
        F.when(rule, R.category(F.col("__low"))["category"]).alias("rule_category"),
        F.when(rule, R.route(F.col("__low"))).alias("rule_route"),
        F.when(rule, R.intended_use(F.col("__low"))).alias("rule_use"),
    )


def blank_state() -> dict:
    return {
        "facts": {}, "round": 0, "awaiting": False, "intent": "other", "has_desc": False, "rule": None,
        "category": "unclassified", "route": "unknown", "use": "unknown", "pending": [],
    }


def advance(s: dict, t: dict, max_rounds: int = MAX_ROUNDS) -> dict:
    """One turn: update the state and give the output row."""
    facts = s["facts"]
    if s["awaiting"] and not t["new_topic"]:
        facts.update(json.loads(t["slots"] or "{}"))
        s["round"] += 1
    else:
        s["intent"] = t["intent"]
        if s["awaiting"]:  # a model saw a new topic: rounds restart, facts are not merged
            s["round"] = 0
            s["has_desc"] = bool(t["desc"])
        else:
            if t["mention"] and "jurisdiction" not in facts:
                facts["jurisdiction"] = t["mention"]
            if t["desc"]:
                facts["raw_product_description"] = t["desc"]
            s["has_desc"] = bool(facts.get("raw_product_description"))
        if t["desc"]:
            s["rule"] = [t["rule_category"], t["rule_route"], t["rule_use"]]
    s["awaiting"], s["pending"], status = False, [], "answered"
    if s["intent"] != "general_info":
        if s["has_desc"] and s["rule"]:
            for field, value, unset in zip(("category", "route", "use"), s["rule"], ("unclassified", "unknown", "unknown")):
                if value != unset:
                    s[field] = value
        if "category" in facts:
            norm = facts["category"].lower().replace("_", "-").strip()
            s["category"] = norm if norm in CATEGORIES else "unclassified"
        if facts.get("route_of_administration", "").lower().strip() in ROUTE_FACTS:
            s["route"] = facts["route_of_administration"].lower().strip()
        if facts.get("intended_use", "").lower().strip() in USE_FACTS:
            s["use"] = facts["intended_use"].lower().strip()
        missing = []
        if s["category"] == "unclassified" and "category" not in facts and s["has_desc"]:
            missing.append("category")
        if (
            s["category"] == "proprietary" and s["intent"] == "compliance" and s["route"] == "unknown"
            and "route_of_administration" not in facts and s["has_desc"]
        ):
            missing.append("route_of_administration")
        bearing = [m for m in missing if m in LOAD_BEARING_FIELDS]
        if s["intent"] != "other" and bearing and s["round"] < max_rounds:
            s["awaiting"], s["pending"], status = True, missing, "needs_clarification"
    return {
        "status": status, "clarification_round": s["round"], "awaiting": s["awaiting"], "pending": list(s["pending"]),
        "known_facts": dict(facts), "category": s["category"], "route_of_administration": s["route"],
    }


def _clean(row: dict) -> dict:
    return {k: (None if isinstance(v, float) and pd.isna(v) else v) for k, v in row.items()}


class _Facts(dict):
    """Facts that remember what was written since the last ``take``."""

    def __init__(self, *args):
        super().__init__(*args)
        self.written: dict = {}

    def __setitem__(self, key, value):
        super().__setitem__(key, value)
        self.written[key] = value

    def update(self, other):
        super().update(other)
        self.written.update(other)


#: Facts that a transition reads; all others only pass through it.
_READ = ("jurisdiction", "raw_product_description", "category", "route_of_administration", "intended_use")
BLOCK = 65536


def _load(text: str | None) -> dict:
    state = json.loads(text) if text else blank_state()
    return state | {"facts": _Facts(state["facts"])}


def _read_part(state: dict) -> str:
    """What a run of turns can see of the state at its start."""
    return json.dumps(state | {"facts": {k: state["facts"][k] for k in _READ if k in state["facts"]}}, sort_keys=True)


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    d = dense_index(turn_features(turns), ["session_id"], "turn_index", "pos", block=block)
    return d.withColumn("blk", F.floor(F.col("pos") / block).cast("long")).drop("pos")


def _runs(blocks: DataFrame, entries: DataFrame, max_rounds: int, schema: str, rows: bool) -> DataFrame:
    """Fold every block from its entry state: a row per turn, or one row per block with what it did."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, start, out = None, None, None, []

        def closing():
            return {"session_id": current[0], "blk": current[1], "seen": start, "control": json.dumps(state | {"facts": {}}), "written": json.dumps(state["facts"].written)}

        for frame in frames:
            for row in frame.to_dict("records"):
                row = _clean(row)
                key = (row["session_id"], row["blk"])
                if key != current:
                    if current is not None and not rows:
                        out.append(closing())
                    current, state = key, _load(row["entry"])
                    start = _read_part(state)
                after = advance(state, row, max_rounds)
                if rows:
                    out.append({"session_id": key[0], "turn_index": row["turn_index"], **after})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            out = []
        if current is not None and not rows:
            yield pd.DataFrame([closing()])

    dealt = blocks.join(entries, ["session_id", "blk"], "left").repartition("session_id", "blk").sortWithinPartitions("session_id", "blk", "turn_index")
    return dealt.mapInPandas(run, schema)


_RUN = "session_id string, blk long, seen string, control string, written string"
_ENTRY = "session_id string, blk long, entry string, known boolean"


def _scan(frame: pd.DataFrame) -> pd.DataFrame:
    """The entry state of every block of one session, as far as its runs tell; ``known``: the run on record began in that state."""
    state, out = blank_state(), []
    for row in frame.sort_values("blk").to_dict("records"):
        out.append((row["session_id"], row["blk"], json.dumps(state), _read_part(state) == row["seen"]))
        state = json.loads(row["control"]) | {"facts": state["facts"] | json.loads(row["written"])}
    return pd.DataFrame(out, columns=["session_id", "blk", "entry", "known"])


def entry_states(blocks: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(session_id, blk, entry) of all sessions with more than one block.

    Every block is first folded from the blank state. A block's effect is the control part of its last state and
    the facts that it wrote, so effects compose: a scan over the blocks of a session (one row each) gives every
    block its entry. Blocks whose run began in another state, in what a transition can read, are folded
    again, all at once, until none is left. Facts are never taken back and a fresh turn forgets most of the
    control state, so blocks of thousands of turns need few rounds; each round settles at least one more block
    of every session, and very short blocks may need as many rounds as there are blocks.
    """
    ids = blocks.select("session_id", "blk").distinct()
    many = ids.where("blk > 0").select("session_id").distinct()
    if many.isEmpty():
        return blocks.sparkSession.createDataFrame([], "session_id string, blk long, entry string")
    long = checkpointed(blocks.join(many, "session_id", "left_semi"))
    todo = long.select("session_id", "blk").distinct().withColumn("entry", F.lit(None).cast("string"))
    done = None
    while True:
        part = long.join(todo.select("session_id", "blk"), ["session_id", "blk"], "left_semi")
        runs = _runs(part, todo, max_rounds, _RUN, rows=False)
        done = checkpointed(runs if done is None else done.join(todo, ["session_id", "blk"], "left_anti").unionByName(runs))
        scanned = checkpointed(done.groupBy("session_id").applyInPandas(_scan, _ENTRY))
        todo = scanned.where("NOT known").select("session_id", "blk", "entry")
        if todo.isEmpty():
            return scanned.select("session_id", "blk", "entry")


def session_machine_batch(turns: DataFrame, max_rounds: int = MAX_ROUNDS, block: int = BLOCK) -> DataFrame:
    """Status and state after every user turn of a finished log.

    A session is cut into blocks of ``block`` turns that run in parallel, so one that holds a large share of
    all turns is spread over the cluster; a task holds one state.
    """
    blocks = checkpointed(_blocks(turns, block))
    return _runs(blocks, entry_states(blocks, max_rounds), max_rounds, OUT_SCHEMA, rows=True)


def session_machine(turns_stream: DataFrame, max_rounds: int = MAX_ROUNDS, ttl_ms: int | None = None) -> DataFrame:
    """The same transition on a stream of turns, state kept by session.

    Needs the RocksDB state store provider. ``ttl_ms`` drops idle sessions; the
    default keeps them, as a file per session would.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Machine(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._state = handle.getValueState("session", "record string", ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            state = json.loads(self._state.get()[0]) if self._state.exists() else blank_state()
            frame = pd.concat(list(rows)).sort_values("turn_index")  # the turns of one micro-batch
            out = []
            for row in frame.to_dict("records"):
                row = _clean(row)
                out.append({"session_id": key[0], "turn_index": row["turn_index"], **advance(state, row, max_rounds)})
            self._state.update((json.dumps(state),))
            yield pd.DataFrame(out)

        def close(self) -> None:
            pass

    return (
        turn_features(turns_stream)
        .groupBy("session_id")
        .transformWithStateInPandas(Machine(), OUT_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
    )
