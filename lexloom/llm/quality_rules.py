"""Quality rules (4): counted text features and a hashed n-gram log-likelihood ratio, DataFrame functions only.

Words and word pairs are hashed into ``BUCKETS`` bins. Two multinomials over the bins
are counted over all documents: the raw corpus, and its trusted part (``trusted``:
enough words, varied ones, no markup symbols). A document's score is
the mean of ``log(p_trusted / p_raw)`` over its n-grams, and every document with a score
below ``THRESHOLD`` is rejected; nothing is drawn at random.

Texts are read twice: once to count (bins are summed before the shuffle, at most
``BUCKETS`` rows arrive), once to score in place. Documents are never shuffled. Repeated
8-word windows are found inside the row by sorting the hashes of its windows, and only
rows that have a repeated hash sort.

* Null and empty texts have no words, fail the base rules and have a score of 0.
* Repeated rows each get the same result. Without trusted documents every score is 0.
* Only ``doc_id`` and ``text`` are read; ``kept`` documents keep all their columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SMOOTHING = 1.0
THRESHOLD = -0.2
WINDOW = 8
VARIETY = 200
SYMBOLS = "#*$%&|<>"
BLANK = r"[\x20\x09-\x0D]"
SOLID = r"[^\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per word; all further steps work on these."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _count(text: Column, one: str) -> Column:
    """How many characters of the text match the class ``one`` (splitting is cheaper than replacing)."""
    return (F.size(F.split(F.coalesce(text, F.lit("")), one, -1)) - 1).cast("long")


def repeated_words(words: Column) -> Column:
    """Words covered by a window that occurs at least twice."""
    n = F.size(words)

    def spread(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda x, k: (F.get(sorted_windows, k - 1)["h"] == x["h"]) | (F.get(sorted_windows, k + 1)["h"] == x["h"]),
        )
        return _let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def of(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(pairs, spread)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n > WINDOW, _let(windows, of)).otherwise(0).cast("long")


def symbols(text: Column) -> Column:
    return _count(text, f"[{SYMBOLS}]")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(SOLID))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _bins(words: Column) -> Column:
    """Bins of all words, and of all pairs of neighbours (the last word has none after it)."""
    mask = F.lit(BUCKETS - 1)
    single = F.transform(words, lambda w: w.bitwiseAND(mask).cast("int"))
    after = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(words, after, lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(0))).bitwiseAND(mask).cast("int"))
    return F.concat(single, pairs)


def trusted(text: Column, words: Column) -> Column:
    """Documents that stand for what is wanted; variety is judged over all words, in runs of ``VARIETY``, and over repeated windows."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(VARIETY))
    different = F.aggregate(starts, F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice(words, i, VARIETY))))
    # last, since it costs most
    return (n >= 50) & (symbols(text) == 0) & (different * 10 >= n * 3) & (100 * repeated_words(words) <= 30 * n)


def bin_weights(docs: DataFrame) -> list[float]:
    """log(p_trusted / p_raw) of every bin, from counts over all documents: a list of ``BUCKETS`` numbers."""
    worded = docs.select("text", word_hashes(F.col("text")).alias("words"))
    # the verdict is a column of its own before the rows multiply
    judged = worded.select(_bins(F.col("words")).alias("bins"), trusted(F.col("text"), F.col("words")).cast("long").alias("good"))
    # the outer form: for the inner one the optimizer adds a filter that computes the bins twice
    rows = judged.select(F.explode_outer("bins").alias("bin"), "good").where("bin IS NOT NULL")
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect():
        raw[r["bin"]], good[r["bin"]] = r["n"], r["good"]
    all_raw, all_good = sum(raw) + SMOOTHING * BUCKETS, sum(good) + SMOOTHING * BUCKETS
    if not sum(good):
        return [0.0] * BUCKETS
    return [round(math.log((g + SMOOTHING) / all_good) - math.log((r + SMOOTHING) / all_raw), 3) for r, g in zip(raw, good, strict=True)]


#: What ``measured`` adds; columns of the input with these names are replaced.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", "_words", "_sum")


def measured(docs: DataFrame, weights: list[float]) -> DataFrame:
    """``docs`` with the counted features, the base verdict, the score and the final verdict."""
    # one constant array: the optimizer folds it before the plan runs
    folded = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    text = F.col("text")
    worded = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MEASURES], word_hashes(text).alias("_words"))
    words, n = F.col("_words"), F.col("n_words")
    out = worded.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MEASURES],
        F.size(words).cast("long").alias("n_words"),
        (F.length(F.coalesce(text, F.lit(""))) - _count(text, BLANK)).alias("word_chars"),
        symbols(text).alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.aggregate(_bins(words), F.lit(0.0), lambda a, b: a + F.get(folded, b)).alias("_sum"),
    )
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    score = F.when(n > 0, F.col("_sum") / (2 * n)).otherwise(0.0)
    return out.select("*", failed.alias("base_failed"), score.alias("score"), (~failed & (score >= THRESHOLD)).alias("kept")).drop("_sum")


def op4(docs: DataFrame) -> DataFrame:
    """The contract of query op4."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return measured(docs, bin_weights(docs)).drop("text")
