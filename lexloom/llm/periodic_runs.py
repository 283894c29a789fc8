"""Periodic runs (11): string synchronising sets over the words of each text.

A run is a maximal stretch of words with smallest period q whose length is at least
``LEAST`` words and three periods. All texts of a batch are one array of exact word
numbers, with a number of its own between texts, so every step is a whole-array step.

* Periods up to ``SMALL`` are found by comparing the array with itself.
* For each scale t (3, 6, 12, ...) the synchronising set holds the positions i where the
  least hash of the t-word windows that start in [i, i + t] is that of the first or the
  last. Windows with a period of t / 3 or less take no part: they lie in runs that smaller
  scales have found. Membership depends on the 2t words from i on only, and a stretch
  of 3t words without a member has a small period.
* A run of period p in [3t, 6t) spans three periods, so two members a period apart lie in it
  and have equal contexts of 2t words. All pairs of equal contexts at such a distance
  propose that distance; members of one context are at least t / 3 apart, so a member has few.
* Proposals are extended both ways with hashes and then compared word by word. Two
  proposals with one extent are a period and its multiple: the smaller one is kept.

The time is near linear in the words of a text, however often they repeat.

* Null and empty texts have no words, no runs and an empty collapsed text.
* Rows are kept one to one: repeated rows and ids each get a result.
* A very long text is a batch of its own; memory is linear in its words.
* Only ``doc_id`` and ``text`` are read; other columns never clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Spans, by_piece, column, compact, joined, mixed, text_column, word_numbers

LEAST = 24
SMALL = 8
FIRST_SCALE = 3
_NONE = np.uint64(2**64 - 1)

RUNS = "array<struct<start: long, length: long, period: long>>"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def of_period(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal extents [start, end) of period p that are at least three periods long."""
    if len(x) <= p:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(x) - p + 2, bool)
    np.equal(x[:-p], x[p:], out=same[1:-1])
    edge = np.flatnonzero(same[1:] != same[:-1])
    a, b = edge[::2], edge[1::2]
    long = b - a >= 2 * p
    return a[long], b[long] + p


def _common(spans: Spans, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from i and j on (or before them), at most ``most``."""
    got = np.zeros(len(i), np.int64)
    step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
    while step:
        fits = np.flatnonzero(got + step <= most)
        a, b = (i[fits] - got[fits] - step, j[fits] - got[fits] - step) if back else (i[fits] + got[fits], j[fits] + got[fits])
        equal = spans.of(a, a + step) == spans.of(b, b + step)
        got[fits[equal]] += step
        step //= 2
    return got


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the stretches."""
    diff = np.zeros(n + 1, np.int64)
    np.add.at(diff, starts, 1)
    np.add.at(diff, ends, -1)
    return np.cumsum(diff[:-1]) > 0


def synchronising(h: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Positions whose window of t + 1 hashes has its least at either end; periodic ones take no part."""
    h = np.where(periodic, _NONE, h)
    if len(h) <= t:
        return np.zeros(0, np.int64)
    least = sliding_min(h, t + 1)
    return np.flatnonzero(((least == h[: len(least)]) | (least == h[t:])) & (least != _NONE))


def proposals(spans: Spans, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of members with equal contexts at distances in [3t, 6t)."""
    context = spans.of(at, at + 2 * t)
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    found, lag = [], 1
    while lag < len(at):
        gap = at[lag:] - at[:-lag]
        near = (context[lag:] == context[:-lag]) & (gap < 6 * t)
        if not near.any():
            break
        near &= gap >= 3 * t
        found.append((at[:-lag][near], gap[near]))
        lag += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs of ``x`` as rows (start, end, period), by start and period.

    ``sizes`` holds the length of each text; every text is followed by one number that occurs nowhere else.
    """
    text_of = np.repeat(sizes, sizes + 1)
    known = [np.zeros((0, 3), np.int64)]
    for p in range(1, SMALL + 1):
        a, b = of_period(x, p)
        known.append(np.column_stack((a, b, np.full(len(a), p))))
    t = FIRST_SCALE
    while len(x) and 9 * t <= sizes.max(initial=0):
        kept = np.flatnonzero(text_of >= 9 * t)  # whole texts that can hold a run of this scale
        y = x[kept]
        spans = Spans(mixed(y.view(np.uint64)))
        h = spans.rolling(t)
        runs = np.concatenate(known)
        runs = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
        periodic = _covered(len(x), runs[:, 0], runs[:, 1] - t + 1)[kept][: len(h)]
        at = synchronising(h, periodic, t)
        i, p = proposals(spans, at[at + 2 * t <= len(y)], t)
        if len(i):
            ahead = _common(spans, i, i + p, len(y) - i - p, False)
            behind = _common(spans, i, i + p, i, True)
            start, end = i - behind, i + p + ahead
            long = end - start >= np.maximum(LEAST, 3 * p)
            checked = []
            for s, e, q in np.unique(np.column_stack((start[long], end[long], p[long])), axis=0):
                if np.array_equal(y[s : e - q], y[s + q : e]):
                    checked.append([[s, e, q]])
                else:  # equal hashes of unequal words: this period is compared plainly
                    a, b = of_period(y, int(q))
                    checked.append(np.column_stack((a, b, np.full(len(a), q))))
            if checked:
                rows = np.concatenate(checked)
                shift = kept[rows[:, 0]] - rows[:, 0]
                known.append(rows + np.column_stack((shift, shift, np.zeros(len(rows), np.int64))))
        t *= 2
    runs = np.concatenate(known)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, 3 * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapsed(data: memoryview, starts, ends, words) -> bytes:
    return b" ".join([data[a:b] for a, b in zip(starts[words].tolist(), ends[words].tolist(), strict=True)])


def _batch(batch: pa.RecordBatch, order) -> pa.RecordBatch:
    ids = column(batch, "doc_id").cast(pa.int64())
    buf, off = joined(text_column(column(batch, "text")))
    out, starts, ends, row = compact(buf, off)
    n = np.diff(row)
    source = np.arange(len(starts))
    changed = np.zeros(len(n), bool)
    if order is not None:
        for d, (doc_id, size) in enumerate(zip(ids.to_pylist(), n.tolist(), strict=True)):
            new = order(doc_id, size)
            if new is not None:
                source[row[d] : row[d + 1]] = row[d] + new
                changed[d] = True
    numbers = word_numbers(out, starts)[source] if len(starts) else np.zeros(0, np.int64)
    long = np.flatnonzero(n >= LEAST)
    size = n[long]
    base = np.cumsum(size + 1) - size - 1  # where each long text begins in x
    x = np.empty(int((size + 1).sum()), np.int64)
    x[base + size] = -1 - np.arange(len(long))
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    x[np.repeat(base, size) + inner] = numbers[np.repeat(row[long], size) + inner]
    runs = find_runs(x, size)
    mine = np.searchsorted(base, runs[:, 0], side="right") - 1
    dropped = np.zeros(len(starts), bool)
    if len(runs):
        inside = _covered(len(x), runs[:, 0] + runs[:, 2], runs[:, 1])
        dropped[np.repeat(row[long], size) + inner] = inside[np.repeat(base, size) + inner]
    data = out.tobytes()
    texts = []
    again = changed.copy()
    again[long[mine]] = True
    for d in range(len(n)):
        if again[d]:
            words = np.arange(row[d], row[d + 1])[~dropped[row[d] : row[d + 1]]]
            texts.append(_collapsed(data, starts, ends, source[words]))
        else:
            texts.append(data[starts[row[d]] : ends[row[d + 1] - 1]] if n[d] else b"")
    counts = np.zeros(len(n), np.int64)
    np.add.at(counts, long[mine], 1)
    begin = runs[:, 0] - base[mine] if len(runs) else runs[:, 0]
    values = pa.StructArray.from_arrays([pa.array(v) for v in (begin, runs[:, 1] - runs[:, 0], runs[:, 2])], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, order: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row.

    ``runs`` holds (start, length, period) in words by start, then period; ``collapsed`` is the text,
    words joined by one space, without the words that a run repeats. ``order(doc_id, n)`` may give
    the word numbers in which a text of n words is read (None: as it stands).
    """
    schema = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
    return by_piece(docs.select(F.col("doc_id").cast("long"), "text"), lambda batch: _batch(batch, order), schema)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The repetition that the contract of op11 writes into one text of ten (rows without id stay)."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11(docs: DataFrame) -> DataFrame:
    """The contract of query op11."""
    found = periodic_runs(docs, planted)
    # a longer relative length first: products of word numbers stay far below 64 bits
    better = lambda a, b: (
        F.when(a["length"] * b["period"] > b["length"] * a["period"], -1)
        .when(a["length"] * b["period"] < b["length"] * a["period"], 1)
        .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    )
    best = F.try_element_at(F.array_sort("runs", better), F.lit(1))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
