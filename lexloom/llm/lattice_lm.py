"""Language-model scores (8): unigram likelihood over the lattice of all subword segmentations.

The pieces are those of an existing public vocabulary file; their probabilities come from the
training documents (pieces of every training word, weighted by its count, plus one).
A word's probability is the sum over all its segmentations of the product of piece
probabilities, by forward recursion over its bytes in log space; byte pieces make every
word possible. A document is its words and one end, so its score is the sum of its
words' marginal log10 probabilities and that of the end.

The lattice is walked once per distinct word, not per token. Words and their training
counts form a table spread over the cluster that grows with the corpus. The most
frequent words (at most ``HEAD``, found from a histogram of counts) are sent to every
task; all other tokens meet their word by an equi-join, in which no key is frequent.

* Null and empty texts have one token, the end. Texts of one very long word are walked too.
* Repeated rows and ids each get their own result. A null id is hashed as the empty text.
* Without training documents all counts are 0 and pieces are equally likely.
* Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import (
    LOWER, byte_spans, column, crc_bucket, joined, pieces, rows_of_words, small_batches, staged, text_column, word_edges, word_hashes,
)

VOCABULARY = os.environ.get("SUBWORD_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
HEAD = 1 << 17
FOLDS = 7
HELD_OUT = 2
LONG_WORD = 256
_COUNT_PIECE = 4 << 20
_MARK = "▁"


# --- words and their counts -----------------------------------------------------


def word_counts(docs: DataFrame, training) -> DataFrame:
    """(h, word, c, n): every distinct lower-cased word, its count in training documents and in all."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, size=_COUNT_PIECE):
                buf, off = joined(text_column(column(piece, "text")))
                buf = LOWER[buf]
                s, e = word_edges(buf)
                h = word_hashes(buf, s, e)
                row = rows_of_words(s, off)
                train = np.repeat(column(piece, "training").to_numpy(zero_copy_only=False).astype(bool), np.diff(row))
                key, first, where = np.unique(h, return_index=True, return_inverse=True)
                taken = [buf[a:b].tobytes() for a, b in zip(s[first], e[first], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(taken, pa.binary()),
                        pa.array(np.bincount(where, train, len(key)).astype(np.int64)),
                        pa.array(np.bincount(where, minlength=len(key)).astype(np.int64)),
                    ],
                    ["h", "word", "c", "n"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select("text", F.coalesce(training, F.lit(False)).alias("training")).mapInArrow(run, "h long, word binary, c long, n long")
    return rows.groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n"))


# --- pieces ---------------------------------------------------------------------

_loaded: dict = {}


def _processor(path: str):
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def piece_bytes(path: str) -> dict[int, bytes]:
    """Id -> bytes of every piece that can be part of one word (a word begins with a space byte)."""
    sp = _processor(path)
    out = {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            p = sp.id_to_piece(i)
            if _MARK not in p[1:]:
                out[i] = p.replace(_MARK, " ").encode()
    return out


def piece_counts(words: DataFrame, path: str = VOCABULARY) -> dict[int, int]:
    """How often each piece occurs in the training words; at most one row per piece and task is shuffled."""

    def run(batches):
        sp = _processor(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in column(batch, "word").to_pylist()]
            c = column(batch, "c").to_numpy()
            for i in range(0, len(texts), 1000):
                ids = sp.encode(texts[i : i + 1000], num_threads=1)
                flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
                total += np.bincount(flat, np.repeat(c[i : i + 1000], [len(x) for x in ids]), len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n long")
    return {r["piece"]: r["n"] for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """Marginal log10 probability of words under the piece probabilities."""

    def __init__(self, logs: dict[bytes, float]):
        self.longest = max(map(len, logs))
        self._dict = logs
        texts = list(logs)
        buf, off = joined(pa.array(texts, pa.binary()))
        key = byte_spans(buf).of(off[:-1], off[1:] - 1)
        order = np.argsort(key)
        self._key, self._log = key[order], np.array([logs[t] for t in texts])[order]
        self._seen = np.zeros(1 << 22, bool)
        self._seen[(self._key >> np.uint64(42)).astype(np.int64)] = True

    def _logs(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -np.inf)
        at = np.flatnonzero(self._seen[(h >> np.uint64(42)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self._key, h[at]), len(self._key) - 1)
        hit = self._key[where] == h[at]
        out[at[hit]] = self._log[where[hit]]
        return out

    def one(self, word: bytes) -> float:
        """Natural log of one word of any length."""
        w = b" " + word
        alpha = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            parts = [alpha[i] + p for i in range(max(0, j - self.longest), j) if (p := self._dict.get(w[i:j])) is not None]
            top = max(parts)
            alpha[j] = top + math.log(sum(math.exp(x - top) for x in parts))
        return alpha[-1]

    def log10(self, words: list[bytes]) -> np.ndarray:
        size = np.array([len(w) for w in words]) + 1
        out = np.empty(len(words))
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = self.one(words[i])
        short = np.flatnonzero(size <= LONG_WORD)
        if len(short):
            buf = np.frombuffer(b"".join(b" " + words[i] for i in short), np.uint8)
            base = np.concatenate(([0], np.cumsum(size[short])[:-1]))
            spans = byte_spans(buf)
            for n in np.unique(size[short]):
                mine = size[short] == n
                out[short[mine]] = self._forward(spans, base[mine], int(n))
        return out / math.log(10)

    def _forward(self, spans, base: np.ndarray, n: int) -> np.ndarray:
        alpha = np.full((n + 1, len(base)), -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                p = self._logs(spans.of(base + i, base + j))
                ok = p > -np.inf
                alpha[j, ok] = np.logaddexp(alpha[j, ok], alpha[i, ok] + p[ok])
        return alpha[n]


def lattice(counts: dict[int, int], ends: int, path: str = VOCABULARY) -> tuple[Lattice, float]:
    """The lattice of all pieces and the log10 probability of the end; one is added to every count."""
    found = piece_bytes(path)
    total = sum(counts.get(i, 0) for i in found) + len(found) + ends + 1
    logs: dict[bytes, float] = {}
    for i, b in found.items():
        p = math.log((counts.get(i, 0) + 1) / total)
        logs[b] = p if b not in logs else float(np.logaddexp(logs[b], p))  # a byte and a character may be one string
    return Lattice(logs), math.log10((ends + 1) / total)


def with_scores(words: DataFrame, model: Lattice) -> DataFrame:
    """(h, c, n, lp): the marginal of every distinct word."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lp = model.log10(column(batch, "word").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "h"), column(batch, "c"), column(batch, "n"), pa.array(lp)], ["h", "c", "n", "lp"])

    words.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return words.select("h", "word", "c", "n").mapInArrow(run, "h long, c long, n long, lp double")


# --- scoring --------------------------------------------------------------------


def head_words(words: DataFrame, head: int = HEAD) -> dict:
    """The most frequent words as arrays: all with at least the count that keeps them within ``head``."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()
    total, floor = 0, None
    for r in levels:
        if total + r["k"] > head:
            break
        total, floor = total + r["k"], r["level"]
    if floor is None:
        return {"h": np.zeros(0, np.uint64), "c": np.zeros(0), "lp": np.zeros(0)}
    got = words.where(level >= floor).select("h", "c", "lp").toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return {"h": h[order], "c": got["c"].to_numpy()[order], "lp": got["lp"].to_numpy()[order]}


_ROWS = "row long, doc_id long, held_out boolean, words long, known long, base double, lp double, tail_h array<long>, tail_n array<long>"


def _head_part(docs: DataFrame, head: dict) -> DataFrame:
    """Per document: what its frequent words add, and its other words with their counts."""
    key, log_c, known, lp = head["h"], np.log10(head["c"] + 1.0), head["c"] > 0, head["lp"]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                buf, off = joined(text_column(column(piece, "text")))
                buf = LOWER[buf]
                s, e = word_edges(buf)
                h = word_hashes(buf, s, e)
                edge = rows_of_words(s, off)
                n = piece.num_rows
                row = np.repeat(np.arange(n), np.diff(edge))
                if len(key):
                    where = np.minimum(np.searchsorted(key, h), len(key) - 1)
                    hit = key[where] == h
                else:
                    where, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                w, r = where[hit], row[hit]
                order = np.lexsort((h[~hit], row[~hit]))
                th, tr = h[~hit][order], row[~hit][order]
                new = np.flatnonzero(np.concatenate(([True], (th[1:] != th[:-1]) | (tr[1:] != tr[:-1])))) if len(th) else np.zeros(0, np.int64)
                count = np.diff(np.append(new, len(th)))
                lists = np.searchsorted(tr[new], np.arange(n + 1)).astype(np.int32)
                sums = [np.bincount(r, v, n) if len(r) else np.zeros(n) for v in (known[w].astype(float), log_c[w], lp[w])]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(piece, "row"), column(piece, "doc_id"), column(piece, "held_out"), pa.array(np.diff(edge)),
                        pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(th[new].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(count.astype(np.int64))),
                    ],
                    ["row", "doc_id", "held_out", "words", "known", "base", "lp", "tail_h", "tail_n"],
                )

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, _ROWS)


def scored(docs: DataFrame, path: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    held = crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    words = staged(word_counts(docs, ~F.col("held_out")))
    total = words.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1))).first()
    ends = docs.where("NOT held_out").count()
    n = (total[0] or 0) + ends
    v = (total[1] or 0) + (ends > 0)
    model, end_lp = lattice(piece_counts(words, path), ends, path)
    table = staged(with_scores(words, model))
    rows = staged(_head_part(docs, head_words(table, head)))

    tail = rows.select("row", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("row", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("k"))
    met = tail.join(table.select("h", "c", F.col("lp").alias("wlp")), "h")
    more = met.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("tb"),
        F.sum(F.col("k") * F.col("wlp")).alias("tl"),
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tk"),
    )
    norm = math.log10(n + v + 1)
    tokens = F.col("words") + 1
    return (
        rows.drop("tail_h", "tail_n")
        .join(more, "row", "left")
        .select(
            "doc_id",
            "held_out",
            tokens.alias("n_tokens"),
            (F.col("known") + F.coalesce("tk", F.lit(0)) + int(ends > 0)).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("tb", F.lit(0.0)) + math.log10(ends + 1) - tokens * norm).alias("base_score"),
            (F.col("lp") + F.coalesce("tl", F.lit(0.0)) + end_lp).alias("score"),
        )
    )


def op8(docs: DataFrame) -> DataFrame:
    """The contract of query op8."""
    return scored(docs)
