"""Substring dedup (5): fixed-block anchors over words.

A window is 13 words. Every document is cut into non-overlapping reference blocks of 7
words; every 7 consecutive words of any document are a probe. A window of 13 words
contains a whole reference block of each document that it occurs in, so two documents
that share a window share a reference block of one and a probe of the other. Where that
happens, all windows over the hit are extended to exact 13-word matches by
comparing window hashes (64 bits), and the words under matched windows form the maximal
repeats. A word goes if a window over it starts in a document with a smaller id.

* Null and empty texts have no words. Rows that repeat an id never remove each other's words.
* A null id counts as later than all others.
* The first document that has a window keeps it; ids, not row order, decide.
* Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm import blocks as B
from lexloom.llm.common import Spans, joined, rows_of_words, text_column, word_edges, word_hashes

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Words:
    """The words of one block of documents and their hashes."""

    def __init__(self, t: pa.Table):
        self.ids, text = B.columns(t)
        self.buf, off = joined(text_column(text))
        self.s, self.e = word_edges(self.buf)
        self.row = rows_of_words(self.s, off)
        counts = np.diff(self.row)
        self.owner = np.repeat(np.arange(len(self.ids)), counts)
        self.place = np.arange(len(self.s)) - np.repeat(self.row[:-1], counts)
        self.left = np.repeat(self.row[1:], counts) - np.arange(len(self.s))
        self._spans = Spans(word_hashes(self.buf, self.s, self.e))

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.left >= n)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return self._spans.of(at, at + n)

    def probes(self):
        """Probe starts, distinct hashes, where each probe is among them."""
        at = self.starts(BLOCK)
        key, where = np.unique(self.hashes(at, BLOCK), return_inverse=True)
        return at, key, where

    def windows(self, active: np.ndarray):
        """Starts of windows over any active probe start, distinct hashes with least ids, places."""
        mark = np.zeros(len(self.s) + 1, np.int64)
        low = np.maximum(active - (WINDOW - BLOCK), active - self.place[active])
        np.add.at(mark, low, 1)
        np.add.at(mark, active + 1, -1)
        at = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (self.left >= WINDOW))
        return at, *B.least_ids(self.hashes(at, WINDOW), self.ids[self.owner[at]])


def _probe(bits):
    def run(block, t, _):
        w = _Words(t)
        at, key, where = w.probes()
        n = len(key)
        ref = np.zeros(n, bool)
        ref[where[w.place[at] % BLOCK == 0]] = True
        ids = w.ids[w.owner[at]]
        low, high = np.full(n, B.LAST), np.full(n, -B.LAST - 1)
        np.minimum.at(low, where, ids)
        np.maximum.at(high, where, ids)
        shared = low != high
        return B.message([(s, block, B.short_keys(key[p], bits), B.packed_bits(ref[p], shared[p])) for s, p in B.by_slice(key, bits)])

    return run


def _hits(keys: list[bytes], info: list[bytes]) -> list[bytes]:
    """Keys that are a reference block somewhere and occur in more than one document."""
    parts = [B.long_keys(k) for k in keys]
    sizes = np.array([len(p) for p in parts])
    flags = np.hstack([B.unpacked_bits(i, n, 2) for i, n in zip(info, sizes, strict=True)])
    k = np.concatenate(parts)
    order = np.argsort(k, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], k[order][1:] != k[order][:-1])))
    count = np.diff(np.append(first, len(k)))
    ref = np.logical_or.reduceat(flags[0][order], first)
    shared = np.logical_or.reduceat(flags[1][order], first) | (count > 1)
    active = np.empty(len(k), bool)
    active[order] = np.repeat(ref & shared, count)
    return [B.packed_bits(a) for a in np.split(active, np.cumsum(sizes)[:-1])]


def _active(w: _Words, heard: pa.Table, bits: int) -> np.ndarray:
    at, key, where = w.probes()
    return at[B.answers_of(heard, 1, key, bits)[0][where]]


def _extend(bits):
    def run(block, t, heard):
        w = _Words(t)
        _, key, ids, _ = w.windows(_active(w, heard, bits))
        return B.window_message(block, key, ids, bits)

    return run


def _remove(bits):
    def run(block, t, heard):
        w = _Words(t)
        at, key, least, where = w.windows(_active(w, heard, bits))
        earlier = B.answers_of(heard, 2, key, bits)[0]
        gone = at[(w.ids[w.owner[at]] > least[where]) | earlier[where]]
        mark = np.zeros(len(w.s) + 1, np.int64)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + WINDOW, -1)
        drop = np.cumsum(mark[:-1]) > 0
        removed = np.bincount(w.owner, drop, len(w.ids)).astype(np.int64) if len(drop) else np.zeros(len(w.ids), np.int64)
        digest = []
        whole = w.buf.tobytes()
        for i in range(len(w.ids)):
            a, b = w.row[i], w.row[i + 1]
            keep = np.flatnonzero(~drop[a:b]) + a
            digest.append(hashlib.sha256(b" ".join([whole[x:y] for x, y in zip(w.s[keep], w.e[keep], strict=True)])).hexdigest())
        return pa.table({"doc_id": B.ids_out(w.ids), "n_words": pa.array(np.diff(w.row)), "n_removed": pa.array(removed), "kept_sha256": pa.array(digest)})

    return run


def deduplicated(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES, slice_bytes: int = B.SLICE_BYTES) -> DataFrame:
    """Per document: words, removed words and the digest of the words kept."""
    dealt, bits = B.blocked(docs, block_bytes, slice_bytes)
    hits = B.answer(B.send(dealt, _probe(bits)), 1, _hits)
    matched = B.answer(B.send(dealt, _extend(bits), hits), 2, B.owners)
    return B.finish(dealt, _remove(bits), hits.unionAll(matched), SCHEMA)


def op5(docs: DataFrame) -> DataFrame:
    """The contract of query op5."""
    return deduplicated(docs)
