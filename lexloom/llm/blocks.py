"""Which windows of a corpus start in an earlier document: messages between document blocks and key slices.

Documents are dealt into blocks of about ``BLOCK_BYTES`` of text by a hash of the id, once;
every step reads that same exchange. A block sends the distinct hashes of its
windows, sorted and cut by their leading bits into slices; a slice sees the hashes of
all blocks and answers each block with one or two bits per hash, in the order sent.
A hash that is everywhere is one entry per block, whatever the number of documents
that hold it; blocks and slices grow in number, not in size, with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import small_batches

BLOCK_BYTES = 2 << 20
SLICE_BYTES = 16 << 20
LAST = (1 << 63) - 1  # stands for a null id: later than all others
MESSAGE = "slice long, block long, keys binary, info binary"
ANSWER = "block long, step int, slice long, bits binary"


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, int]:
    """(block, doc_id, text) and the number of leading bits that name a slice."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    bits = max(2, (total // slice_bytes).bit_length())
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    out = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), key.alias("doc_id"), "text")
    return out.repartition("block"), bits


# --- messages -------------------------------------------------------------------


def by_slice(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted keys with the same leading bits."""
    if not len(keys):
        return
    top = keys >> np.uint64(64 - bits)
    first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
        yield int(top[a]), slice(int(a), int(b))


def message(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("slice", "block", "keys", "info"), cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})


def short_keys(keys: np.ndarray, bits: int) -> bytes:
    """The 32 bits after the slice's of sorted keys, as 3-byte steps where they fit."""
    k = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.int64)
    step = np.diff(k, prepend=0)
    if step.max() < 1 << 24:
        return b"3" + step.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return b"4" + k.astype("<u4").tobytes()


def long_keys(data: bytes) -> np.ndarray:
    if data[:1] == b"4":
        return np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 3).astype(np.int64)
    return np.cumsum(raw[:, 0] + (raw[:, 1] << 8) + (raw[:, 2] << 16))


def packed_ids(ids: np.ndarray) -> bytes:
    low = ids.min()
    if int(ids.max()) - int(low) < 1 << 32:
        return b"4" + low.astype("<i8").tobytes() + (ids - low).astype("<u4").tobytes()
    return b"8" + ids.astype("<i8").tobytes()


def unpacked_ids(data: bytes) -> np.ndarray:
    if data[:1] == b"8":
        return np.frombuffer(data, "<i8", offset=1)
    return np.frombuffer(data, "<u4", offset=9).astype(np.int64) + np.frombuffer(data, "<i8", 1, 1)[0]


def unpacked_bits(data: bytes, n: int, planes: int = 1) -> np.ndarray:
    """(planes, n) booleans."""
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * planes)
    return flat.reshape(planes, n).astype(bool)


def packed_bits(*planes: np.ndarray) -> bytes:
    return np.packbits(np.concatenate(planes)).tobytes()


# --- exchange -------------------------------------------------------------------


def send(docs: DataFrame, fn: Callable[[int, pa.Table], pa.Table], heard: DataFrame | None = None) -> DataFrame:
    """Messages of every block; ``heard`` brings the answers that the block has so far."""
    return _per_block(docs, fn, heard, MESSAGE)


def _per_block(docs, fn, heard, schema):
    if heard is None:
        return docs.groupBy("block").applyInArrow(lambda key, t: fn(key[0].as_py(), t, None), schema)
    both = docs.groupBy("block").cogroup(heard.groupBy("block"))
    return both.applyInArrow(lambda key, t, a: fn(key[0].as_py(), t, a), schema)


def finish(docs: DataFrame, fn: Callable, heard: DataFrame, schema: str) -> DataFrame:
    return _per_block(docs, fn, heard, schema)


def answer(messages: DataFrame, step: int, decide: Callable[[list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    """Every slice decides over the messages of all blocks; one answer per message."""

    def run(key, t):
        bits = decide(t["keys"].to_pylist(), t["info"].to_pylist())
        n = t.num_rows
        return pa.table({"block": t["block"], "step": pa.array([step] * n, pa.int32()), "slice": t["slice"], "bits": pa.array(bits, pa.binary())})

    return messages.groupBy("slice").applyInArrow(run, ANSWER)


def answers_of(t: pa.Table, step: int, keys: np.ndarray, bits: int, planes: int = 1) -> np.ndarray:
    """The answered bits of sorted keys, as sent in ``step``."""
    got = {s: b for s, k, b in zip(t["slice"].to_pylist(), t["step"].to_pylist(), t["bits"].to_pylist(), strict=True) if k == step}
    out = np.zeros((planes, len(keys)), bool)
    for s, part in by_slice(keys, bits):
        out[:, part] = unpacked_bits(got[s], part.stop - part.start, planes)
    return out


# --- an index family ------------------------------------------------------------


class IndexFamily:
    """Sorted arrays of suffix keys in levels: a batch is scanned against all levels, and equal-sized levels merge.

    Each level holds distinct keys in order and the smallest id of each. A level is at least
    twice as large as the next, so a key takes part in a logarithmic number of merges.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        level = (keys, ids)
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = _merged(self.levels.pop(), level)
        self.levels.append(level)

    def least(self, keys: np.ndarray) -> np.ndarray:
        """Smallest id of each sorted key over all levels, by one merge scan per level."""
        out = np.full(len(keys), LAST)
        for k, ids in self.levels:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            hit = k[at] == keys
            out[hit] = np.minimum(out[hit], ids[at[hit]])
        return out


def _merged(a, b):
    k, ids = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(k, kind="stable")  # two sorted runs: a merge
    k, ids = k[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.minimum.reduceat(ids, first)


def owners(keys: list[bytes], info: list[bytes]) -> list[bytes]:
    """For each key of each message: does another message have it with a smaller id?"""
    family = IndexFamily()
    batches = [(np.frombuffer(k, "<u8"), unpacked_ids(i)) for k, i in zip(keys, info, strict=True)]
    for k, ids in batches:
        family.add(k, ids)
    return [packed_bits(family.least(k) < ids) for k, ids in batches]


def window_message(block: int, keys: np.ndarray, ids: np.ndarray, bits: int) -> pa.Table:
    return message([(s, block, keys[p].astype("<u8").tobytes(), packed_ids(ids[p])) for s, p in by_slice(keys, bits)])


def least_ids(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the smallest id of each, and where each hash is among them."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    where = np.empty(len(h), np.int64)
    where[order] = np.cumsum(new) - 1
    return h[first], np.minimum.reduceat(ids[order], first) if len(first) else ids[:0], where


def columns(t: pa.Table) -> tuple[np.ndarray, pa.Array]:
    text = t["text"].combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    return t["doc_id"].to_numpy(), text


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == LAST)
