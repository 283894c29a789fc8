"""Benchmark decontamination (7): SimHash of item-sized windows, multi-index Hamming search, exact check.

For every benchmark item of n words, every window of n consecutive words of a document
that shares a shingle with the item is fingerprinted. The fingerprints of the items lie
in a multi-index: each of four 16-bit blocks lists the items by their value. A window asks
for all values within ``BLOCK_RADIUS`` bits of its own, so by the pigeonhole principle every
item within ``RADIUS`` bits is found under at least one block. What is found is compared exactly:
weighted Jaccard similarity of the shingle multisets, a shingle weighing the bytes of
its words, ``SIMILARITY`` or more.

Fingerprints of some pairs just above ``SIMILARITY`` lie further apart. So a row and an item
are also compared where the shingles they share weigh at least ``SIMILARITY`` of the item, in
all windows whose shared weight allows it; no pair is lost. A row with fewer words than
the item is one window.

Words are runs of letters and digits (any byte from 0x80 counts as a letter), lower case
for A-Z and the Latin-1 capitals. Shingles have five words; an item with fewer words is
one shingle. An item without words matches nothing.

* Null and empty texts match nothing. A null id is reported as null.
* Repeated rows each report their matches; equal items each match.
* Of equally similar windows the first counts.
* Documents are read once per slice of the benchmark and never shuffled. A slice has at
  most about ``SLICE_BYTES`` of text; a larger benchmark is taken slice by slice. The index of
  a slice is broadcast and grows with its items only (four entries an item); the driver
  builds one slice at a time and keeps none. Each further slice is one more pass.
* ``decontaminated`` keeps all columns; ``leaks`` reads ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, Spans, by_piece, column, joined, pieces, rows_of_words, small_batches, text_column, word_edges, word_hashes
from lexloom.llm.simhash_dedup import majority

SHINGLE = 5
SIMILARITY = 0.8
BLOCK_RADIUS = 3
RADIUS = 4 * (BLOCK_RADIUS + 1) - 1
SLICE_BYTES = 1 << 22
_WINDOWS = 1 << 15
_ASKED = 1 << 10
_NEAR = np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(16), r)], np.uint64)
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Words:
    """Normalised words of many rows: their hashes, byte widths and the word range of each row."""

    def __init__(self, col: pa.Array):
        buf, off = joined(col)
        buf = LOWER[buf]
        if len(buf) > 1:
            capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
            buf[1:][capital] += 32
        s, e = word_edges(buf, _APART)
        self.row = rows_of_words(s, off)
        self.hash = word_hashes(buf, s, e)
        self.width = np.concatenate(([0], np.cumsum(e - s)))
        self._spans = Spans(self.hash)
        self._rolling: dict[int, np.ndarray] = {}

    def shingles(self, k: int) -> np.ndarray:
        if k not in self._rolling:
            self._rolling[k] = self._spans.rolling(k)
        return self._rolling[k]

    def weights(self, at: np.ndarray, k: int) -> np.ndarray:
        return self.width[at + k] - self.width[at]


def _close_values(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, key) places of all 16-bit values and sorted distinct keys within BLOCK_RADIUS bits.

    Few keys are compared with every value, of many the values within the radius are looked up.
    """
    v, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(values), _ASKED):
        part = values[i : i + _ASKED, None]
        if len(keys) <= len(_NEAR):
            a, b = np.nonzero(np.bitwise_count(part ^ keys[None]) <= BLOCK_RADIUS)
        else:
            asked = part ^ _NEAR[None]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            a, c = np.nonzero(keys[at] == asked)
            b = at[a, c]
        v.append(a + i)
        k.append(b)
    return np.concatenate(v), np.concatenate(k)


def _multiset(hashes: np.ndarray, weights: np.ndarray) -> dict:
    out: dict[int, list] = {}
    for h, w in zip(hashes.tolist(), weights.tolist(), strict=True):
        out.setdefault(h, [0, w])[0] += 1
    return out


def similarity(a: dict, b: dict) -> float:
    """Weighted Jaccard of two shingle multisets {hash: [count, weight]}."""
    both = sum(min(n, b[h][0]) * w for h, (n, w) in a.items() if h in b)
    total = sum(n * w for n, w in a.values()) + sum(n * w for n, w in b.values()) - both
    return both / total if total else 0.0


class Index:
    """The items of one slice: shingle lists, fingerprints and the multi-index of each window size."""

    def __init__(self, ids: list, texts: list[str]):
        w = Words(pa.array(texts, pa.string()))
        self.ids, self.words = ids, np.diff(w.row)
        self.sets: list[dict] = []
        owner, hashes, fps = [], [], np.zeros(len(ids), np.uint64)
        for j, n in enumerate(self.words):
            k = min(SHINGLE, int(n))
            at = np.arange(w.row[j], w.row[j + 1] - k + 1) if n else np.zeros(0, np.int64)
            h = w.shingles(k)[at] if n else np.zeros(0, np.uint64)
            self.sets.append(_multiset(h, w.weights(at, k)))
            owner.append(np.full(len(self.sets[-1]), j))
            hashes.append(np.fromiter(self.sets[-1], np.uint64, len(self.sets[-1])))
            if n:
                fps[j] = majority(h, np.zeros(1, np.int64), np.array([len(h)]))[0]
        self.fp = fps
        self.weight = np.array([sum(c * x for c, x in t.values()) for t in self.sets], np.int64)
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.words if n})
        self.by_size = {k: self._postings(k, owner, hashes) for k in self.sizes}
        self.by_words = {int(n): self._blocks(np.flatnonzero(self.words == n)) for n in np.unique(self.words) if n}

    def _postings(self, k, owner, hashes):
        mine = [j for j in range(len(self.ids)) if self.words[j] and min(SHINGLE, self.words[j]) == k]
        h, o = np.concatenate([hashes[j] for j in mine]), np.concatenate([owner[j] for j in mine])
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        key, first = np.unique(h, return_index=True)
        seen = np.zeros(1 << 20, bool)
        seen[(key >> np.uint64(44)).astype(np.int64)] = True
        return key, np.append(first, len(h)), o, seen

    def _blocks(self, items):
        out = []
        for b in range(4):
            value = (self.fp[items] >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            order = np.argsort(value, kind="stable")
            key, first = np.unique(value[order], return_index=True)
            out.append((key, np.append(first, len(items)), items[order]))
        return out

    def near(self, n: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS among the items of n words."""
        win, item = [], []
        for b, (keys, first, items) in enumerate(self.by_words[n]):
            value, of = np.unique((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF), return_inverse=True)
            order = np.argsort(of, kind="stable")
            edge = np.searchsorted(of[order], np.arange(len(value) + 1))
            v, k = _close_values(value, keys)
            wide = first[k + 1] - first[k]
            count = (edge[v + 1] - edge[v]) * wide
            of_pair = np.repeat(np.arange(len(v)), count)
            place = np.arange(len(of_pair)) - np.repeat(np.cumsum(count) - count, count)
            w = order[edge[v][of_pair] + place // wide[of_pair]]
            i = items[first[k][of_pair] + place % wide[of_pair]]
            close = np.bitwise_count(fp[w] ^ self.fp[i]) <= RADIUS
            win.append(w[close])
            item.append(i[close])
        pair = np.unique(np.concatenate(win) * np.int64(len(self.ids)) + np.concatenate(item))
        return pair // len(self.ids), pair % len(self.ids)

    def matches(self, col: pa.Array) -> list[tuple]:
        """(row, item, similarity, first word, words) of the best window of each row and item."""
        w = Words(col)
        best: dict[tuple, tuple] = {}
        for k in self.sizes:
            key, first, owner, seen = self.by_size[k]
            g = w.shingles(k)
            at = np.flatnonzero(seen[(g >> np.uint64(44)).astype(np.int64)])
            where = np.minimum(np.searchsorted(key, g[at]), len(key) - 1)
            hit = key[where] == g[at]
            at, where = at[hit], where[hit]
            row = np.searchsorted(w.row, at, side="right") - 1
            inside = at + k <= w.row[row + 1]
            at, where, row = at[inside], where[inside], row[inside]
            if not len(at):
                continue
            count = first[where + 1] - first[where]
            item = owner[np.repeat(first[where] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
            at, row = np.repeat(at, count), np.repeat(row, count)
            for n in np.unique(self.words[item]):
                mine = self.words[item] == n
                for start in self._starts(at[mine], w.row[row[mine]], w.row[row[mine] + 1], int(n), k):
                    self._verify(w, g, start, int(n), k, best)
            self._weigh(w, g, at, row, item, k, best)
        return [(r, j, *v) for (r, j), v in sorted(best.items())]

    def _weigh(self, w, g, at, row, item, k, best):
        """Compare the rows and items whose shared shingles weigh enough, window by window."""
        pair, of = np.unique(row * np.int64(len(self.ids)) + item, return_inverse=True)
        shared = np.bincount(of, w.weights(at, k))
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(len(pair) + 1))
        for p in np.flatnonzero(shared >= SIMILARITY * self.weight[pair % len(self.ids)] * (1 - 1e-9)):
            r, j = int(pair[p]) // len(self.ids), int(pair[p]) % len(self.ids)
            low, high, hits = int(w.row[r]), int(w.row[r + 1]), np.sort(at[order[edge[p] : edge[p + 1]]])
            n = min(int(self.words[j]), high - low)
            m = n - k + 1
            both = np.concatenate(([0], np.cumsum(w.weights(hits, k))))
            all_ = np.concatenate(([0], np.cumsum(w.weights(np.arange(low, high - k + 1), k))))
            for start in self._starts(hits, np.full(len(hits), low), np.full(len(hits), high), n, k):
                common = both[np.searchsorted(hits, start + m)] - both[np.searchsorted(hits, start)]
                union = all_[start - low + m] - all_[start - low] + self.weight[j] - common
                for s in start[common >= SIMILARITY * union * (1 - 1e-9)]:
                    grid = np.arange(s, s + m)
                    self._keep(best, (r, j), similarity(_multiset(g[grid], w.weights(grid, k)), self.sets[j]), int(s) - low, n)

    @staticmethod
    def _keep(best, key, s, first, n):
        if s >= SIMILARITY and (key not in best or (-s, first) < (-best[key][0], best[key][1])):
            best[key] = (s, first, n)

    @staticmethod
    def _starts(at, low, high, n, k):
        """Starts of all windows of n words in their row that contain a hit, in blocks."""
        lo, hi = np.maximum(low, at - n + k), np.minimum(at, high - n)
        ok = lo <= hi
        lo, hi = np.unique(np.stack((lo[ok], hi[ok])), axis=1)
        step = max(1, _WINDOWS // n)
        last = -1
        for i in range(0, len(lo), step):
            count = hi[i : i + step] - lo[i : i + step] + 1
            s = np.repeat(lo[i : i + step] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            s = np.unique(s)
            s = s[s > last]  # ranges are sorted, so earlier blocks end no later than these start anew
            if len(s):
                last = int(s[-1])
                yield s

    def _verify(self, w, g, start, n, k, best):
        m = n - k + 1
        grid = start[:, None] + np.arange(m)
        fp = majority(g[grid].ravel(), np.arange(len(start)) * m, np.full(len(start), m))
        win, item = self.near(n, fp)
        if not len(win):
            return
        row = np.searchsorted(w.row, start, side="right") - 1
        for i in np.unique(win):
            at = grid[i]
            mine = _multiset(g[at], w.weights(at, k))
            for j in item[win == i]:
                s = similarity(mine, self.sets[j])
                self._keep(best, (int(row[i]), int(j)), s, int(start[i] - w.row[row[i]]), n)


def indexes(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> Iterator[Index]:
    """The benchmark as indexes of bounded size, one slice on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-total // slice_bytes) or 1
    for i in range(slices):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).orderBy("item_id", "text").toArrow()
        yield Index(got["item_id"].to_pylist(), got["text"].to_pylist())


def _sent(benchmark: DataFrame, slice_bytes: int) -> Iterator[Broadcast]:
    """Each index as a broadcast, which the driver keeps on disk only."""
    return map(benchmark.sparkSession.sparkContext.broadcast, indexes(benchmark, slice_bytes))


def _pairs(docs: DataFrame, sent: Broadcast) -> DataFrame:
    def run(batch):
        index = sent.value
        found = index.matches(text_column(column(batch, "text")))
        if not found:
            return None
        ids = column(batch, "doc_id").to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[r] for r, *_ in found], pa.int64()),
                pa.array([index.ids[j] for _, j, *_ in found], pa.int64()),
                *(pa.array([f[i] for f in found], t) for i, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))),
            ],
            ["doc_id", "item_id", "similarity", "first_word", "n_words"],
        )

    return by_piece(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, item_id long, similarity double, first_word long, n_words long")


def leaks(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row for each document and benchmark item that it holds: (doc_id, item_id, similarity, first_word, n_words)."""
    out = None
    for sent in _sent(benchmark, slice_bytes):
        part = _pairs(docs, sent)
        out = part if out is None else out.unionAll(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    small_batches(docs.sparkSession)

    def clean(sent):
        def run(batches):
            index = sent.value
            for batch in batches:
                for piece in pieces(batch):
                    bad = np.zeros(piece.num_rows, bool)
                    bad[[m[0] for m in index.matches(text_column(column(piece, "text")))]] = True
                    yield piece.filter(pa.array(~bad))

        return run

    for sent in _sent(benchmark, slice_bytes):
        docs = docs.mapInArrow(clean(sent), docs.schema)
    return docs


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Query op7: all matches; a document without one has no row."""
    return leaks(docs, benchmark)
