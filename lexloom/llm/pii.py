"""Personal data (1): candidate spans, boosted trees, calibrated thresholds.

Four fixed formats (email, ip, card, phone) are always found. Beside them, generous
generators propose overlapping spans around digits, at signs and assignments; boosted
trees over format and context features score each proposal; isotonic calibration on
held-out documents turns scores into probabilities, and each kind has the lowest
threshold at which the calibrated precision reaches ``PRECISION``. Selected spans never
overlap a fixed one or each other (higher probability first, then the longer, then the
earlier).

The trees learn from weak labels on at most ``TRAIN_DOCS`` documents (chosen by a hash
of the id) and at most ``PER_DOC`` proposals of each: valid fixed formats, values that
are assigned to a secret's name and tokens with a key's prefix are positive, all other
proposals negative. The label rules are not features; only what a span and its
surroundings look like is.

* Null and empty texts have no spans. Offsets are code points, ends exclusive.
* Repeated rows each get the same result; only ``doc_id`` and ``text`` are read by
  ``detect``, and ``redacted`` keeps all columns in their order.
* An empty table, or one without proposals, gives a model that adds nothing.
* A text of any length is one Python call whose time is linear in the text.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import column, pieces, small_batches, text_column

TRAIN_DOCS = 4000
PER_DOC = 64
TREES = 40
DEPTH = 3
RATE = 0.2
BINS = 32
PRECISION = 0.9
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("contact", "number", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_IP_HINT = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HOT = re.compile(r"[0-9@=]")
_GROUPS = re.compile(r"[0-9](?:[\x20().\-/]{0,2}[0-9]){5,}+")
_ASSIGNED = re.compile(r"(?i)(?<![A-Za-z])(password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)\x20?[=:]\x20?[\"']?([^\s\"']{6,})")
_PREFIXED = re.compile(r"^(?:AKIA|ASIA|ghp_|sk_live_|sk-|xox[bp]-)[A-Za-z0-9_-]{10,}$")
_BLANK = frozenset(" \t\n\v\f\r")
_EDGE = "\"'()[]{}<>,;:!?."


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple]:
    """Fixed formats as (start, end, kind), by start, then kind as listed."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if _IP_HINT.search(text):
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], BASE_KINDS.index(s[2])))
    return out


def proposals(text: str) -> list[tuple]:
    """(start, end, kind, weak label) of all generators; spans may overlap."""
    found: dict[tuple, int] = {}

    def add(start, end, kind, label):
        key = (start, end, kind)
        found[key] = max(found.get(key, 0), label)

    m = _HOT.search(text)
    if m is None:
        return []
    for s, e, kind in base_spans(text):
        add(s, e, "contact" if kind in ("email", "phone") else "number", 1)
    pos = m.start()
    while True:
        start = end = pos
        while start > 0 and text[start - 1] not in _BLANK:
            start -= 1
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        a, b = start, end
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        token = text[a:b]
        if len(token) >= 6:
            if "@" in token:
                add(a, b, "contact", 0)
            elif len(token) >= 12 and "=" not in token:
                add(a, b, "secret", int(_PREFIXED.match(token) is not None))
        m = _HOT.search(text, end)
        if m is None:
            break
        pos = m.start()
    for m in _GROUPS.finditer(text):
        add(m.start(), m.end(), "number", 0)
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            e = m.end(2)
            while e > m.start(2) and text[e - 1] in _EDGE:
                e -= 1
            if e - m.start(2) >= 6:
                add(m.start(2), e, "secret", int(any(c.isdigit() for c in text[m.start(2) : e])))
    return [(s, e, k, label) for (s, e, k), label in sorted(found.items())]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and of what stands around it."""
    s = text[start:end]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    upper = sum("A" <= c <= "Z" for c in s)
    lower = sum("a" <= c <= "z" for c in s)
    hexa = sum(c in "0123456789abcdef" for c in s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    turns = sum((a.isdigit() != b.isdigit()) for a, b in zip(s, s[1:], strict=False))
    before = text[max(0, start - 16) : start]
    word = re.search(r"([A-Za-z]*)[^A-Za-z]*$", before).group(1)
    return [
        ADDED_KINDS.index(kind), n, digits / n, upper / n, lower / n, hexa / n, len(counts), entropy, turns,
        s.count("@"), s.count("."), s.count("-"), s.count(" "), sum(c in "()/" for c in s),
        float(s[0] == "+"), float(start > 0 and text[start - 1] in "=:\"'"), float("=" in before), float(":" in before),
        float(start == 0 or text[start - 1] in _BLANK), float(end == len(text) or text[end] in _BLANK),
        float(end < len(text) and text[end] in "\"'"), len(word), digits, s.rfind(".") - s.rfind("@"),
    ]


# --- boosted trees --------------------------------------------------------------


def _bins(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)


def _grow(b, g, h, rows, depth) -> tuple:
    """A node: (feature, bin, left, right) or a leaf value."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        for f in range(b.shape[1]):
            cg = np.cumsum(np.bincount(b[rows, f], g[rows], BINS))[:-1]
            ch = np.cumsum(np.bincount(b[rows, f], h[rows], BINS))[:-1]
            gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
            gain[(ch < 1e-3) | (total_h - ch < 1e-3)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        return (float(-total_g / (total_h + 1)),)
    f, k = best[1]
    low = b[rows, f] <= k
    return (f, k, _grow(b, g, h, rows[low], depth - 1), _grow(b, g, h, rows[~low], depth - 1))


def _apply(tree, b, rows, out):
    if len(tree) == 1:
        out[rows] += RATE * tree[0]
        return
    f, k, left, right = tree
    low = b[rows, f] <= k
    _apply(left, b, rows[low], out)
    _apply(right, b, rows[~low], out)


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["prior"])
    if len(x):
        b = _binned(x, model["edges"])
        for tree in model["trees"]:
            _apply(tree, b, np.arange(len(x)), out)
    return out


def _isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: score limits and the probability from each limit on."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([s, v, 1])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][0] == blocks[-1][0]):
            s2, v2, n2 = blocks.pop()
            s1, v1, n1 = blocks[-1]
            blocks[-1] = [s1, (v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    limit, value = model["calibration"]
    return value[np.maximum(np.searchsorted(limit, margins(model, x), side="right") - 1, 0)]


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> dict | None:
    """Trees on the rows not held, calibration and thresholds on those held. None if there is nothing to learn."""
    fit = ~held
    if not held.any() or not fit.any() or y[fit].min() == y[fit].max():
        return None
    edges = _bins(x[fit])
    b, target = _binned(x[fit], edges), y[fit].astype(float)
    share = target.mean()
    model = {"edges": edges, "prior": float(np.log(share / (1 - share))), "trees": []}
    score = np.full(len(target), model["prior"])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(b, p - target, p * (1 - p), np.arange(len(target)), DEPTH)
        model["trees"].append(tree)
        _apply(tree, b, np.arange(len(target)), score)
    model["calibration"] = _isotonic(margins(model, x[held]), y[held].astype(float))
    p = probabilities(model, x[held])
    model["threshold"] = {}
    for k, kind in enumerate(ADDED_KINDS):
        mine = x[held][:, 0] == k
        pk, yk = p[mine], y[held][mine]
        good = [t for t in np.unique(pk) if t > 0.5 and yk[pk >= t].mean() >= PRECISION]
        model["threshold"][kind] = float(min(good)) if good else 2.0
    return model


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict | None:
    """Learn from a bounded sample: about ``train_docs`` documents, ``PER_DOC`` proposals each.

    Documents are told apart by id and text, so one id may have any share of the rows, and copies count once.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit("pii"))
    n = docs.agg(F.approx_count_distinct(key)).first()[0]
    share = min(1 << 20, math.ceil((1 << 20) * train_docs / max(n, 1)))
    part = docs.where(F.pmod(key, F.lit(1 << 20)) < share).select(key.alias("key"), "text")
    sample = part.groupBy("key").agg(F.first("text").alias("text"))
    small_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            out: list = []
            for key, text in zip(column(batch, "key").to_pylist(), text_column(column(batch, "text")).to_pylist(), strict=True):
                found = proposals(text)
                step = -(-len(found) // PER_DOC) or 1
                out += [(key, label, features(text, s, e, k)) for s, e, k, label in found[::step]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.float64()))],
                ["key", "label", "x"],
            )

    got = sorted(map(tuple, sample.mapInArrow(rows, "key long, label int, x array<double>").collect()))
    if not got:
        return None
    return train(np.array([r[2] for r in got]), np.array([r[1] for r in got]), np.array([r[0] % 4 == 0 for r in got]))


def added_spans(model: dict | None, text: str, base: list[tuple]) -> list[tuple]:
    """What the trees select beside the fixed spans."""
    if model is None:
        return []
    found = [p for p in proposals(text) if not any(s < p[1] and p[0] < e for s, e, _ in base)] if len(base) < 8 else _free(proposals(text), base)
    if not found:
        return []
    p = probabilities(model, np.array([features(text, s, e, k) for s, e, k, _ in found]))
    chosen = [(-q, s - e, s, e, k) for q, (s, e, k, _) in zip(p, found, strict=True) if q >= model["threshold"][k]]
    taken: list[tuple] = []  # by start; they never overlap
    for *_, s, e, k in sorted(chosen):
        at = bisect.bisect_left(taken, (s, e, k))
        if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
            taken.insert(at, (s, e, k))
    return taken


def _free(spans: list[tuple], taken: list[tuple]) -> list[tuple]:
    """Spans that overlap none of ``taken`` (sorted by start)."""
    if not taken:
        return spans
    starts = np.array([t[0] for t in taken])
    reach = np.maximum.accumulate([t[1] for t in taken])
    out = []
    for x in spans:
        k = int(np.searchsorted(starts, x[1]))
        if k == 0 or reach[k - 1] <= x[0]:
            out.append(x)
    return out


def all_spans(model: dict | None, text: str) -> tuple[list[tuple], list[tuple]]:
    """(fixed spans, all spans by start)."""
    base = base_spans(text)
    if _HOT.search(text) is None:
        return base, base
    kinds = BASE_KINDS + ADDED_KINDS
    return base, sorted(base + added_spans(model, text, base), key=lambda s: (s[0], kinds.index(s[2])))


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def detect(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per row: doc_id, counts and digest of the fixed spans, all spans, number of added ones."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for text in text_column(column(piece, "text")).to_pylist():
                    base, spans = all_spans(model, text)
                    if not spans:
                        out.append((0, 0, 0, 0, empty, "", 0))
                        continue
                    kinds = [k for *_, k in base]
                    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                    out.append((*(kinds.count(k) for k in BASE_KINDS), digest, _joined(spans), len(spans) - len(base)))
                cols = list(zip(*out, strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], NAMES)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with all spans masked in ``text``; a column ``n_chars`` is set to the new length. Nulls stay null."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                texts = []
                for text in column(piece, "text").to_pylist():
                    spans = all_spans(model, text)[1] if text else []
                    texts.append(masked(text, spans) if spans else text)
                yield piece.set_column(piece.schema.get_field_index("text"), piece.schema.field("text"), pa.array(texts, piece.schema.field("text").type))

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out


def op1(docs: DataFrame) -> DataFrame:
    """The contract of query op1."""
    return detect(docs, fit(docs))
