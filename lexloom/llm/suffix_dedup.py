"""Suffix-array dedup (3): a logarithmic family of sparse suffix arrays over bytes.

Of every 50-byte string one suffix is indexed: the one that begins at the smallest hash
among its 31 grams of 20 bytes (the leftmost of equals). The choice depends on the string alone,
so equal strings anywhere meet at the same suffix; about one suffix in sixteen is
indexed. Suffixes are ordered by 64-bit fingerprints of their first 20 bytes and of their context
(all 50-byte strings that chose them) instead of letter by letter: only equality
matters here, and a fingerprint sorts in one step.

The documents of a block are a batch: its suffixes become a sorted array. In each
slice of the key space the arrays of all batches join a family of levels
(``blocks.IndexFamily``): equal-sized levels merge, so a suffix is merged a logarithmic number
of times, and every batch is scanned against the levels for the smallest id that has
its strings. Three rounds keep the traffic small:

1. anchors: which 20-byte heads occur in more than one document;
2. contexts of those: a context that an earlier document has too is removed as a whole, and
   a head with one context only is settled;
3. the single 50-byte strings of what is left.

A byte goes if a 50-byte string over it starts in a document with a smaller id.

* Null and empty texts, and texts under 50 bytes, lose nothing.
* Rows that repeat an id never remove each other's bytes. A null id is later than all others.
* Ids decide, not row order. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm import blocks as B
from lexloom.llm.common import byte_spans, joined, text_column

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM + 1
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TOP, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class _Suffixes:
    """The indexed suffixes of one block of documents."""

    def __init__(self, t: pa.Table):
        self.ids, text = B.columns(t)
        self.buf, self.off = joined(text_column(text))
        self.spans = byte_spans(self.buf)
        size = np.diff(self.off) - 1
        starts = np.maximum(size - LENGTH + 1, 0)
        total = int(starts.sum())
        if total == 0:
            self.at = self.s1 = self.s2 = self.owner = np.zeros(0, np.int64)
            return
        head = self.spans.rolling(GRAM)
        low = _sliding_min((head & _TOP) | np.arange(len(head), dtype=np.uint64), REACH)
        edge = np.zeros(len(self.buf) + 1, np.int8)
        full = starts > 0
        edge[self.off[:-1][full]] = 1
        edge[(self.off[:-1] + starts)[full]] -= 1
        valid = np.flatnonzero(np.cumsum(edge[:-1]))
        anchor = (low[valid] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        self.at, self.s1 = anchor[new], valid[new]
        self.s2 = valid[np.append(new[1:], len(valid)) - 1]
        self.owner = np.searchsorted(self.off, self.at, side="right") - 1
        self._head = head

    def heads(self):
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.unique(self._head[self.at], return_inverse=True)

    def shared(self) -> np.ndarray:
        """Heads (as in ``heads``) that several documents of this block have."""
        key, where = self.heads()
        ids = self.ids[self.owner]
        low, high = np.full(len(key), B.LAST), np.full(len(key), -B.LAST - 1)
        np.minimum.at(low, where, ids)
        np.maximum.at(high, where, ids)
        return low != high

    def contexts(self, pick: np.ndarray):
        """Distinct (head, context) pairs of the picked suffixes, least id of each, place of each suffix."""
        head = self._head[self.at[pick]] if len(pick) else np.zeros(0, np.uint64)
        context = self.spans.of(self.s1[pick], self.s2[pick] + LENGTH)
        ids = self.ids[self.owner[pick]]
        order = np.lexsort((context, head))
        h, c = head[order], context[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        where = np.empty(len(h), np.int64)
        where[order] = np.cumsum(new) - 1
        return h[first], c[first], np.minimum.reduceat(ids[order], first) if len(first) else ids[:0], where

    def strings(self, pick: np.ndarray):
        """Starts of all strings of the picked suffixes, distinct hashes with least ids, places."""
        count = self.s2[pick] - self.s1[pick] + 1
        at = np.repeat(self.s1[pick] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(pick) else np.zeros(0, np.int64)
        owner = np.repeat(self.owner[pick], count)
        return at, owner, *B.least_ids(self.spans.of(at, at + LENGTH), self.ids[owner])


def _anchors(bits):
    def run(block, t, _):
        x = _Suffixes(t)
        key, _ = x.heads()
        shared = x.shared()
        return B.message([(s, block, B.short_keys(key[p], bits), B.packed_bits(shared[p])) for s, p in B.by_slice(key, bits)])

    return run


def _repeated(keys: list[bytes], info: list[bytes]) -> list[bytes]:
    """Heads that occur in more than one document."""
    parts = [B.long_keys(k) for k in keys]
    sizes = [len(p) for p in parts]
    shared = np.concatenate([B.unpacked_bits(i, n)[0] for i, n in zip(info, sizes, strict=True)])
    k = np.concatenate(parts)
    order = np.argsort(k, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], k[order][1:] != k[order][:-1])))
    count = np.diff(np.append(first, len(k)))
    out = np.empty(len(k), bool)
    out[order] = np.repeat(np.logical_or.reduceat(shared[order], first) | (count > 1), count)
    return [B.packed_bits(a) for a in np.split(out, np.cumsum(sizes)[:-1])]


def _active(x: _Suffixes, heard: pa.Table, bits: int) -> np.ndarray:
    key, where = x.heads()
    return np.flatnonzero(B.answers_of(heard, 1, key, bits)[0][where]) if len(key) else np.zeros(0, np.int64)


def _contexts(bits):
    def run(block, t, heard):
        x = _Suffixes(t)
        head, context, ids, _ = x.contexts(_active(x, heard, bits))
        rows = [
            (s, block, head[p].astype("<u8").tobytes() + context[p].astype("<u8").tobytes(), B.packed_ids(ids[p]))
            for s, p in B.by_slice(head, bits)
        ]
        return B.message(rows)

    return run


def _settle(keys: list[bytes], info: list[bytes]) -> list[bytes]:
    """Two bits per context: an earlier document has it; its head has other contexts too."""
    pairs = [np.frombuffer(k, "<u8").reshape(2, -1) for k in keys]
    ids = [B.unpacked_ids(i) for i in info]
    both = [p[0] * np.uint64(0x9E3779B97F4A7C15) ^ p[1] for p in pairs]  # one key for the pair
    family = B.IndexFamily()
    orders = [np.argsort(b) for b in both]
    for b, i, o in zip(both, ids, orders, strict=True):
        family.add(b[o], i[o])
    earlier = []
    for b, i, o in zip(both, ids, orders, strict=True):
        out = np.empty(len(b), bool)
        out[o] = family.least(b[o]) < i[o]
        earlier.append(out)
    head, context = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.argsort(head, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], head[order][1:] != head[order][:-1])))
    c = context[order]
    several = np.empty(len(head), bool)
    several[order] = np.repeat(np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first), np.diff(np.append(first, len(head))))
    cuts = np.cumsum([len(i) for i in ids])[:-1]
    return [B.packed_bits(e, s) for e, s in zip(earlier, np.split(several, cuts), strict=True)]


def _judged(x: _Suffixes, heard: pa.Table, bits: int):
    """Suffixes whose strings all go, and suffixes whose strings must be looked up one by one."""
    active = _active(x, heard, bits)
    head, _, ids, where = x.contexts(active)
    earlier, several = B.answers_of(heard, 2, head, bits, 2)
    gone = earlier[where] | (x.ids[x.owner[active]] > ids[where])
    return active[gone], active[~gone & several[where]]


def _strings(bits):
    def run(block, t, heard):
        x = _Suffixes(t)
        _, _, key, ids, _ = x.strings(_judged(x, heard, bits)[1])
        return B.window_message(block, key, ids, bits)

    return run


def _remove(bits):
    def run(block, t, heard):
        x = _Suffixes(t)
        whole, single = _judged(x, heard, bits)
        at, owner, key, least, where = x.strings(single)
        gone = at[(x.ids[owner] > least[where]) | B.answers_of(heard, 3, key, bits)[0][where]]
        mark = np.zeros(len(x.buf) + 1, np.int32)
        for s, e in ((x.s1[whole], x.s2[whole] + LENGTH), (gone, gone + LENGTH)):
            np.add.at(mark, s, 1)
            np.add.at(mark, e, -1)
        drop = np.cumsum(mark[:-1]) > 0
        removed, spans, digest = [], [], []
        for a, b in zip(x.off[:-1], x.off[1:] - 1, strict=True):
            d = drop[a:b]
            removed.append(int(d.sum()))
            spans.append(int(d[:1].sum()) + int((d[1:] & ~d[:-1]).sum()))
            digest.append(hashlib.sha256(x.buf[a:b][~d].tobytes()).hexdigest())
        cols = [B.ids_out(x.ids), pa.array(np.diff(x.off) - 1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
        return pa.table(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def deduplicated(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES, slice_bytes: int = B.SLICE_BYTES) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the digest of the bytes kept."""
    dealt, bits = B.blocked(docs, block_bytes, slice_bytes)
    heard = B.answer(B.send(dealt, _anchors(bits)), 1, _repeated)
    settled = B.answer(B.send(dealt, _contexts(bits), heard), 2, _settle)
    heard = heard.unionAll(settled)
    matched = B.answer(B.send(dealt, _strings(bits), heard), 3, B.owners)
    return B.finish(dealt, _remove(bits), heard.unionAll(matched), SCHEMA)


def op3(docs: DataFrame) -> DataFrame:
    """The contract of query op3."""
    return deduplicated(docs)
