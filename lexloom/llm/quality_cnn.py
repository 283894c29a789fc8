"""Quality classifier (10): a byte-level convolutional network in numpy.

Every text is cut into overlapping chunks that cover it from end to end. Learned
filters slide over the embedded bytes of a chunk, each filter keeps its largest
response, a small layer describes the chunk, and the mean and the maximum over all
chunks of the document give one probability.

* Null and empty texts are one chunk of padding and get a score like any other text.
* Scores have five decimals, so equal texts get equal scores; repeated rows and ids keep their rows.
* Further columns of ``docs`` are passed through; a column of the names that this
  operator adds (``score``, ``predicted``, ``held_out``) is replaced.
* No labelled row of a usable class: the model answers with the smoothed share of label 1.

Labels are learned from at most ``TRAIN_DOCS`` rows, chosen by a hash of the id, and
from at most ``TRAIN_CHUNKS`` evenly spaced chunks of each; scoring reads every byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import column, crc_bucket, pieces, raw_bytes, small_batches, text_column

TRAIN_DOCS = 6000
TRAIN_CHUNKS = 12
CHUNK = 256
STEP = 224
WIDTH = 8
STRIDE = 2
EMBED = 6
FILTERS = 24
HIDDEN = 16
EPOCHS = 14
BATCH = 64
THRESHOLD = 0.3
PAD = 256
_AT = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
_BLOCK = 512


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of a text of n bytes; the last one ends with the text."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - CHUNK, STEP, dtype=np.int64)
    return np.append(s, n - CHUNK)


def chunk_codes(data: np.ndarray, off: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes of all chunks (padded with PAD), and the number of chunks of each row."""
    starts, counts = [], np.empty(len(off) - 1, np.int64)
    for i in range(len(off) - 1):
        s = chunk_starts(int(off[i + 1] - off[i]))
        if most is not None and len(s) > most:
            s = s[np.linspace(0, len(s) - 1, most).astype(np.int64)]
        starts.append(s + off[i])
        counts[i] = len(s)
    at = np.concatenate(starts)
    stop = np.repeat(off[1:], counts)
    grid = at[:, None] + np.arange(CHUNK)
    inside = grid < stop[:, None]
    codes = np.full(grid.shape, PAD, np.int16)
    codes[inside] = data[grid[inside]]
    return codes, counts


def _windows(embedded: np.ndarray) -> np.ndarray:
    """Rows of WIDTH embedded bytes, STRIDE apart: (chunks, positions, WIDTH * EMBED)."""
    n, _, e = embedded.shape
    a, b, c = embedded.strides
    return np.lib.stride_tricks.as_strided(embedded, (n, len(_AT), WIDTH, e), (a, b * STRIDE, b, c)).reshape(n, len(_AT), WIDTH * e)


def chunk_features(m: dict, codes: np.ndarray) -> np.ndarray:
    """Hidden description of each chunk."""
    out = np.empty((len(codes), HIDDEN), np.float32)
    for i in range(0, len(codes), _BLOCK):
        x = _windows(m["embed"][codes[i : i + _BLOCK]])
        n = len(x)
        y = (x.reshape(-1, WIDTH * EMBED) @ m["conv"]).reshape(n, len(_AT), FILTERS)
        pooled = np.maximum(y.max(axis=1) + m["conv_b"], 0)
        out[i : i + n] = np.maximum(pooled @ m["dense"] + m["dense_b"], 0)
    return out


def doc_scores(m: dict, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    h = chunk_features(m, codes)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    pooled = np.hstack((np.add.reduceat(h, first, axis=0) / counts[:, None], np.maximum.reduceat(h, first, axis=0)))
    z = pooled.astype(np.float64) @ m["out"].astype(np.float64) + float(m["out_b"][0])
    # single precision sums differ in the last digits with the rows that share a batch
    return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 5)


def train(codes: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 7) -> dict:
    """Adam on the logistic loss; everything is seeded, so reruns agree."""
    rng = np.random.default_rng(seed)
    m = {
        "embed": rng.normal(0, 0.5, (257, EMBED)),
        "conv": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)),
        "conv_b": np.zeros(FILTERS),
        "dense": rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)),
        "dense_b": np.full(HIDDEN, 0.1),
        "out": rng.normal(0, 0.1, 2 * HIDDEN),
        "out_b": np.zeros(1),
    }
    m = {k: v.astype(np.float32) for k, v in m.items()}
    share = (labels.sum() + 1) / (len(labels) + 2)
    m["out_b"][0] = np.log(share / (1 - share))
    if len(labels) == 0 or labels.min() == labels.max():
        m["out"][:] = 0
        return m
    first = np.concatenate(([0], np.cumsum(counts)))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step, steps = 0, EPOCHS * -(-len(labels) // BATCH)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(labels)), -(-len(labels) // BATCH)):
            step += 1
            pick = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            g = _gradients(m, codes[pick], counts[rows], labels[rows])
            rate = 0.004 * min(1, step / 50) * (1 - 0.9 * step / steps)
            for k, d in g.items():
                a, b = moment[k]
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                m[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def _gradients(m: dict, codes: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict:
    n, rows = len(codes), len(counts)
    x = _windows(m["embed"][codes])
    y = (x.reshape(-1, WIDTH * EMBED) @ m["conv"]).reshape(n, len(_AT), FILTERS)
    top = y.argmax(axis=1)
    pooled = np.maximum(np.take_along_axis(y, top[:, None], 1)[:, 0] + m["conv_b"], 0)
    h = np.maximum(pooled @ m["dense"] + m["dense_b"], 0)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    owner = np.repeat(np.arange(rows), counts)
    mean, high = np.add.reduceat(h, first, axis=0) / counts[:, None], np.maximum.reduceat(h, first, axis=0)
    both = np.hstack((mean, high))
    p = 1 / (1 + np.exp(-np.clip(both @ m["out"] + m["out_b"][0], -30, 30)))
    d = ((p - labels) / rows).astype(np.float32)
    g = {"out": both.T @ d, "out_b": np.array([d.sum()], np.float32)}
    up = d[:, None] * m["out"][None]
    ties = (h == high[owner]).astype(np.float32)
    ties /= np.add.reduceat(ties, first, axis=0)[owner]
    dh = (up[:, :HIDDEN] / counts[:, None])[owner] + up[:, HIDDEN:][owner] * ties
    dh *= h > 0
    g["dense"], g["dense_b"] = pooled.T @ dh, dh.sum(0)
    dp = (dh @ m["dense"].T) * (pooled > 0)
    g["conv_b"] = dp.sum(0)
    best = x[np.arange(n)[:, None], top]  # (chunks, filters, window)
    g["conv"] = np.einsum("nfk,nf->kf", best, dp)
    back = (dp[:, :, None] * m["conv"].T[None]).reshape(n, FILTERS, WIDTH, EMBED)
    where = codes[np.arange(n)[:, None, None], _AT[top][:, :, None] + np.arange(WIDTH)]
    flat = where.ravel().astype(np.int64)
    back = back.reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(flat, back[:, e], 257) for e in range(EMBED)], axis=1).astype(np.float32)
    return {k: v.astype(np.float32) for k, v in g.items()}


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, train_docs: int = TRAIN_DOCS) -> dict:
    """Train on labelled documents. ``labels``: doc_id, quality. ``usable`` restricts the ids (a column over doc_id).

    The chosen ids are a bounded list; what reaches the driver is at most
    ``train_docs * TRAIN_CHUNKS * CHUNK`` bytes of chunks.
    """
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if usable is not None:
        ids = ids.where(usable)
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text of an id that repeats
    small_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch):
                data, off = raw_bytes(text_column(column(piece, "text")))
                codes, counts = chunk_codes(data, off, TRAIN_CHUNKS)
                codes = np.minimum(codes, PAD).astype("<i2")
                end = np.cumsum(counts)
                rows = [codes[e - c : e].tobytes() for c, e in zip(counts, end, strict=True)]
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id").cast(pa.int64()), column(piece, "quality").cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "quality", "codes"])

    got = sample.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(cut, "doc_id long, quality int, codes binary").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["codes"].to_pylist(), got["quality"].to_pylist(), strict=True))
    if not rows:
        return train(np.zeros((0, CHUNK), np.int16), np.zeros(0, np.int64), np.zeros(0))
    parts = [np.frombuffer(r[1], "<i2").reshape(-1, CHUNK) for r in rows]
    return train(np.concatenate(parts), np.array([len(p) for p in parts]), np.array([r[2] for r in rows], np.float64))


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted``; no shuffle."""
    docs = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double, predicted int"

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                data, off = raw_bytes(text_column(column(piece, "text")))
                codes, counts = chunk_codes(data, off)
                score = doc_scores(model, codes, counts)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    [*piece.schema.names, "score", "predicted"],
                )

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of query op10: labels only from rows whose remainder is not 0."""
    held = crc_bucket(F.col("doc_id"), 5) == 0
    model = fit(docs, labels, ~held)
    scored = classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
