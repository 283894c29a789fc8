"""Sessions folded in blocks against the sequential fold."""

import random

import pytest

from lexloom.streaming import sessions as S

TEXTS = [
    "it is an oral capsule", "a proprietary neem cream", "for india, therapeutic", "can i patent my herbal mixture", "unrelated remark",
    "do i need a license for my proprietary tablet", "hello", "classical ashwagandha taila", "compliance for a herbal product",
]


def sequential(features):
    out, states = [], {}
    for t in sorted(features, key=lambda t: (t["session_id"], t["turn_index"])):
        state = states.setdefault(t["session_id"], S.blank_state())
        out.append((t["session_id"], t["turn_index"], *S.advance(state, t).values()))
    return [tuple(map(str, r)) for r in out]


@pytest.mark.parametrize("block", [30, 1000])
def test_blocks_equal_the_sequential_fold(spark, block):
    rng = random.Random(block)
    rows = [("hot" if rng.random() < 0.6 else f"s{rng.randrange(20)}", i * 7, rng.choice(TEXTS), rng.random() < 0.1) for i in range(400)]
    turns = spark.createDataFrame(rows, "session_id string, turn_index long, text string, new_topic boolean").repartition(3)
    want = sequential([r.asDict() for r in S.turn_features(turns).collect()])
    cols = ["session_id", "turn_index", "status", "clarification_round", "awaiting", "pending", "known_facts", "category", "route_of_administration"]
    got = [tuple(str(r[c]) for c in cols) for r in S.session_machine_batch(turns, block=block).orderBy("session_id", "turn_index").collect()]
    plain = lambda r: (*r[:6], str(sorted(eval(r[6]).items())), *r[7:])
    assert list(map(plain, got)) == list(map(plain, want))


def test_no_turns(spark):
    assert S.session_machine_batch(spark.createDataFrame([], "session_id string, turn_index long, text string")).collect() == []
