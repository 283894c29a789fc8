"""Stored contexts: each distinct key is generated once, over runs, repeats and a run that is killed."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators.chunking import context_key
from lexloom.sources.contexts import ContextStore

SCHEMA = "id int, parent_context string, split_text string, fallback_context string"


def rows(n):
    return [(i, f"p{i % 10}", f"text {i % 30}", f"fixed {i % 30}") for i in range(n)] + [(900, None, "x", "fixed null"), (901, "p", None, None)]


class Model:
    """Counts the prompts it is asked; gives nothing for some, fails when told to."""

    def __init__(self, fail_at=None):
        self.calls, self.asked, self.fail_at = 0, [], fail_at

    def __call__(self, prompts):
        self.calls += 1
        if self.calls == self.fail_at:
            raise RuntimeError("killed")
        self.asked += [r.key for r in prompts.collect()]
        text = F.when(F.col("prompt").contains("text 7\n"), "  ").otherwise(F.concat(F.lit("made "), F.substring("key", 1, 4)))
        return prompts.select("key", text.alias("context"))


def test_second_run_asks_nothing_and_a_killed_run_goes_on(spark, tmp_path):
    chunks = spark.createDataFrame(rows(100), SCHEMA)
    store = ContextStore(spark, str(tmp_path), parts=4)
    first = Model(fail_at=3)
    with pytest.raises(RuntimeError):
        store.lookup(chunks, first)
    assert first.asked and store.read().count() == len(first.asked)
    second = Model()
    found = {r.id: r.generated_context for r in store.lookup(chunks, second).collect()}
    assert len(first.asked + second.asked) == len(set(first.asked + second.asked)) == 30
    keys = {r.id: r.key for r in chunks.select("id", context_key(F.col("parent_context"), F.col("split_text")).alias("key")).collect()}
    for i, _, _, fixed in rows(100):
        assert found[i] == (fixed if i >= 900 or i % 30 == 7 else f"made {keys[i][:4]}")
    third = Model()
    again = store.lookup(chunks, third)
    assert third.calls == 0 and {r.id: r.generated_context for r in again.collect()} == found
    more = Model()
    assert store.fill(chunks.unionByName(spark.createDataFrame([(5, "new", "new", "f")], SCHEMA)), more) == 1 and len(more.asked) == 1


def test_without_generator_or_chunks(spark, tmp_path):
    store = ContextStore(spark, str(tmp_path))
    none = spark.createDataFrame([], SCHEMA)
    model = Model()
    assert store.lookup(none, model).count() == 0 and model.calls == 0
    assert {r.generated_context for r in store.lookup(spark.createDataFrame(rows(3), SCHEMA)).collect()} == {"fixed 0", "fixed 1", "fixed 2", "fixed null", None}


def test_prompts_are_made_only_for_what_a_generator_is_asked(spark, tmp_path, monkeypatch):
    def prompted(chunks):
        raise AssertionError("texts were made into prompts")

    chunks = spark.createDataFrame(rows(40), SCHEMA)
    store = ContextStore(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr("lexloom.sources.contexts.context_prompt", prompted)
        assert store.fill(chunks) == 30 and store.fill(chunks) == 0  # nobody to ask
        assert store.fill(chunks, Model()) == 0  # all stored
        found = {r.id: r.generated_context for r in store.lookup(chunks, Model()).collect()}
    assert all(found[i] == fixed for i, _, _, fixed in rows(40))
    assert len(list((tmp_path / "contexts").iterdir())) == 1
    model = Model()
    assert store.fill(chunks.withColumn("split_text", F.concat("split_text", F.lit("!"))), model) == 30 and len(model.asked) == 30
