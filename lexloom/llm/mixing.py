"""Mixing sources to target weights (2): Efraimidis-Spirakis sampling, DataFrame functions only.

Every source gets a word budget: its weight's share of all words, at most ``CAP`` times
its own words, what is over going to the other sources by weight until none is above.
A budget is spent in complete epochs over the source and then on one partial epoch, whose
documents come in the order of exponential keys ``-ln(u) / quality``: u is a hash of
document and seed, so reruns agree, and better documents tend to come first. Prefix sums
of the words in that order are cut at the budget; the document at the cut gives its first
words only.

No source is ever sorted as a whole. Keys are monotone in a bucket number, buckets are
summed with map-side combining, a running sum over the few bucket rows finds the one
bucket of each source where the budget ends, and only that bucket's rows are ranked.
The number of buckets grows with the largest source, so that a bucket stays bounded.

* Null texts have size 0 and null sources are a source of their own, last in order.
* A document without words takes 0. Rows that are equal in id and text share a key;
  which of them comes first is then open, their results are the same set.
* An empty table gives an empty result; a mix without words has targets of 0.
* Only ``doc_id``, ``source`` and ``text`` are read; further columns and the text are not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import WORD
from lexloom.session import checkpointed

CAP = 3
SEED = 20240607
BUCKET_ROWS = 2000
WIDE = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of characters that are no markup or junk symbols, squared."""
    n = F.greatest(F.length(text), F.lit(1))
    plain = F.length(F.translate(text, "#*$%&|<>!{}[]=~^_", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.pow(plain / n, F.lit(2)), F.lit(0.05)))


def sampling_keys(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key): all that the mix needs, without the texts."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        (-F.log(u) / quality_weight(F.col("text"))).alias("key"),
    )


def source_targets(keys: DataFrame, weights: tuple = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size, target, n_docs): one row per source.

    The uncapped sources share what is left in proportion to their weights, so a source
    is capped as soon as its ratio of cap to weight is below the common level. In the order of
    that ratio the capped ones come first: their caps are a running sum, the weights of the
    rest the remainder of the total. All windows run over one row per source.
    """
    per = keys.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (position % len(weights) + 1).cast("int"))
    per = per.select("*", w.alias("w"), (F.col("source_size") * cap).cast("double").alias("most"))
    everyone = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.select(
        "*",
        F.row_number().over(by_ratio).alias("place"),
        F.sum("source_size").over(everyone).alias("total"),
        F.sum("w").over(everyone).alias("all_w"),
        F.coalesce(F.sum("most").over(up_to), F.lit(0.0)).alias("used"),
        F.coalesce(F.sum("w").over(up_to), F.lit(0.0)).alias("used_w"),
    )
    level = (F.col("total") - F.col("used")) / (F.col("all_w") - F.col("used_w"))
    # the level if this source and all after it are uncapped; the first source that its own level doesn't cap has the common one
    ranked = ranked.select("*", level.alias("level"), (F.col("most") >= F.col("w") * level).alias("free"))
    common = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everyone)["level"]
    target = F.least(F.col("most"), F.col("w") * F.coalesce(common, F.lit(float("inf"))))
    return ranked.select("source", "source_size", "n_docs", F.when(F.col("total") > 0, target).otherwise(0.0).alias("target"))


def allot(keys: DataFrame, weights: tuple = (1, 2, 3), cap: int = CAP, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, epochs, taken)."""
    keys = checkpointed(keys)
    targets = source_targets(keys, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    targets = targets.select("*", epochs.alias("epochs"))
    budget = F.when(F.col("epochs") >= cap, 0).otherwise(F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long")
    targets = checkpointed(targets.select("source", "source_size", "target", "epochs", budget.alias("budget"), "n_docs"))
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    buckets = max(1, min(WIDE, 4 * -(-largest // bucket_rows)))
    # key / (1 + key) grows with the key and lies between 0 and 1
    share = F.col("key") / (F.col("key") + 1)
    keys = keys.withColumn("bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int"))

    sums = keys.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.select("source", "bucket", "words", F.sum("words").over(order).alias("upto"))
    t = targets.select(F.col("source").alias("s"), "budget")
    edge = (
        running.join(t, running["source"].eqNullSafe(t["s"]))
        .where(F.col("upto") > F.col("budget"))
        .groupBy("s", "budget")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
        .select("s", F.col("edge.bucket").alias("edge_bucket"), (F.col("budget") - F.col("edge.before")).alias("edge_words"))
    )
    t = targets.select(F.col("source").alias("t"), "source_size", "target", "epochs")
    plan = checkpointed(t.join(edge, t["t"].eqNullSafe(edge["s"]), "left").drop("s"))

    rows = keys.join(plan, keys["source"].eqNullSafe(plan["t"])).drop("t")
    place = F.col("bucket") - F.coalesce("edge_bucket", F.lit(buckets))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge_rows = rows.where(place == 0).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("edge_words") - F.col("before")))
    out = ["doc_id", "source", "size", "key", "source_size", "target", "epochs"]
    taken = F.col("epochs") * F.col("size")
    whole = rows.where(place != 0).select(*out, (taken + F.when(place < 0, F.col("size")).otherwise(0)).cast("long").alias("taken"))
    return whole.unionAll(edge_rows.select(*out, (taken + left).cast("long").alias("taken")))


def mixed(docs: DataFrame, weights: tuple = (1, 2, 3), cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Per document: (doc_id, source, size, key, source_size, target, epochs, taken)."""
    return allot(sampling_keys(docs, seed), weights, cap)


def op2(docs: DataFrame) -> DataFrame:
    """The contract of query op2."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "epochs")
