"""Helpers shared by the operators: texts as byte arrays, hashed spans, batches of bounded size.

Texts arrive as Arrow columns. A piece of a batch (about a megabyte) is joined into
one byte array with a line feed between documents, so that words, byte windows and
word windows are found with whole-array numpy steps. Nulls count as empty texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = 0x9E3779B97F4A7C15
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches hold few rows, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


# --- texts as bytes -------------------------------------------------------------


def text_column(col) -> pa.Array:
    """The column as one string array without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "")


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the offset of each row in them."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows with a line feed after each; row i is ``buf[off[i] : off[i + 1] - 1]``."""
    data, off = raw_bytes(col)
    off = off + np.arange(len(off))
    out = np.full(off[-1], 10, np.uint8)
    keep = np.ones(off[-1], bool)
    keep[off[1:] - 1] = False
    out[keep] = data
    return out, off


def pieces(batch: pa.RecordBatch, name: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    width = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
    total = np.cumsum(width.to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def by_piece(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = PIECE_BYTES) -> DataFrame:
    """``mapInArrow`` with ``fn`` applied to pieces of bounded size."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, size=size):
                out = fn(piece)
                if out is not None:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# --- words ----------------------------------------------------------------------


def word_edges(buf: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are not in ``space``."""
    solid = np.zeros(len(buf) + 2, bool)
    np.logical_not(space[buf], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def rows_of_words(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Index of the first word of each row, and past the last."""
    return np.searchsorted(starts, off)


def compact(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
    """The words with one space after each, their edges, and the first word of each row."""
    s, e = word_edges(buf, space)
    keep = ~space[buf]
    keep[e] = True
    out = buf[keep]
    at = np.cumsum(keep)
    out[at[e] - 1] = 32
    return out, at[s] - 1, at[e] - 1, rows_of_words(s, off)


def word_numbers(out: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, from their bytes."""
    edges = np.append(starts, len(out)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(out))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


# --- hashes of spans ------------------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 1 << 21)
        for key, step in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Spans:
    """64-bit hashes of spans of a sequence, each in constant time from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self._down = _power(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sum[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sum[ends] - self._sum[starts]) * self._down[starts])

    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all windows of k items, by start."""
        n = len(self._sum) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self._sum[k:] - self._sum[:n]) * self._down[:n])


def byte_spans(buf: np.ndarray) -> Spans:
    return Spans(_BYTE_VALUE[buf])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_spans(buf).of(starts, ends)


def staged(df: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared folder and read again: cuts the lineage, and columns are read singly."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
