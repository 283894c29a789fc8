"""SimHash near-duplicates (9): covering locality-sensitive hashing.

A fingerprint has a bit set where more than half of the text's shingle hashes have
it. Two fingerprints link if at most ``RADIUS`` bits differ. The tables of the
covering code are the masks ``mask_v = {i : <m(i), v> = 1}`` for all nonzero v of
RADIUS + 1 bits: up to RADIUS differing bits span too few dimensions to meet every
v, so some mask leaves them all out and the pair collides there. No link is lost.

Equal fingerprints are one node. A bucket larger than ``BUCKET`` is split by a second
covering code over the bits its mask leaves out, and again if need be; fingerprints
in it are distinct and every finer mask has more bits, so this ends with at most
``2 ** FREE_BITS`` of them. A bucket
gives the edges of a spanning forest of its links, never all its pairs.

The stage of the corpus pipeline links further texts (``words=True``): those whose sets of
five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more, checked exactly
(equality of shingles is equality of 64-bit hashes). Texts with equal sets are one node. What
is compared (``alike.links``) are texts that share rare shingles: of a text with fewer than
``2 * LEAST_SAMPLE`` shingles all count, of one with up to twice as many every second (by hash), and so on;
a text near the upper end of its level is also in the next, so two alike texts meet in one. Ordered from
the rarest, the first shingles that two texts with ``SIMILARITY`` (``LOOSE`` among a part of the shingles)
cannot both lack are their groups. No pair of texts below ``2 * LEAST_SAMPLE`` shingles is lost; of longer ones a
pair at the very bound is lost if its part of at least about ``LEAST_SAMPLE`` shingles shows less than ``LOOSE``,
more than three standard deviations off.

* Null and empty texts have fingerprint zero and link like any other.
* Rows are kept one to one: repeated rows and ids each get a result.
* A null id can belong to a component but never name it, unless no row of the
  component has an id (then ``component_id`` is null).
* Only ``doc_id`` and ``text`` are read; other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import alike
from lexloom.llm.common import LOWER, SPACE, by_piece, column, joined, mixed, pieces, rows_of_words, small_batches, text_column, word_edges
from lexloom.llm.components import components
from lexloom.session import checkpointed

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 2048
FREE_BITS = 11
SIMILARITY = 0.8
LOOSE = 0.6
LEAST_SAMPLE = 48
COMPARED = 5
_LONG = 512

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of one byte array at once."""
    padded = np.concatenate((buf, np.zeros(40, np.uint8)))
    at8 = np.ndarray((len(padded) - 8,), "<u8", padded.data, strides=(1,))
    at4 = np.ndarray((len(padded) - 4,), "<u4", padded.data, strides=(1,))
    size = ends - starts
    s = np.uint64(seed)
    pos = starts.copy()
    with np.errstate(over="ignore"):
        h = np.full(len(starts), s + _P5, np.uint64)
        idx = np.flatnonzero((size >= 32) & (size <= _LONG))
        if len(idx):
            v = [np.full(len(idx), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            p, left, act = starts[idx].copy(), size[idx] // 32, np.arange(len(idx))
            while len(act):
                q = p[act]
                for k in range(4):
                    v[k][act] = _round(v[k][act], at8[q + 8 * k])
                p[act] += 32
                left[act] -= 1
                act = act[left[act] > 0]
            g = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for k in range(4):
                g = (g ^ _round(np.uint64(0), v[k])) * _P1 + _P4
            h[idx], pos[idx] = g, p
        h += size.astype(np.uint64)
        for _ in range(3):
            idx = np.flatnonzero(ends - pos >= 8)
            idx = idx[size[idx] <= _LONG]
            if not len(idx):
                break
            h[idx] = _rot(h[idx] ^ _round(np.uint64(0), at8[pos[idx]]), 27) * _P1 + _P4
            pos[idx] += 8
        idx = np.flatnonzero(ends - pos >= 4)
        idx = idx[size[idx] <= _LONG]
        h[idx] = _rot(h[idx] ^ (at4[pos[idx]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        pos[idx] += 4
        for _ in range(3):
            idx = np.flatnonzero(ends - pos >= 1)
            idx = idx[size[idx] <= _LONG]
            if not len(idx):
                break
            h[idx] = _rot(h[idx] ^ (padded[pos[idx]].astype(np.uint64) * _P5), 11) * _P1
            pos[idx] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed=seed)
    return h


def compact_words(buf: np.ndarray, off: np.ndarray):
    """Lower-cased text with one space after each word; edges of the words in it; words of each row."""
    buf = LOWER[buf]
    s, e = word_edges(buf)
    keep = ~SPACE[buf]
    keep[e] = True
    out = buf[keep]
    at = np.cumsum(keep)
    out[at[e] - 1] = 32
    return out, at[s] - 1, at[e] - 1, rows_of_words(s, off)


def majority(h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit-wise majority of the hashes of each row; rows are consecutive, counts positive."""
    segs = -(-counts // 255)
    row_seg = np.concatenate(([0], np.cumsum(segs)[:-1]))
    inner = np.arange(segs.sum()) - np.repeat(row_seg, segs)
    seg_start = np.repeat(first, segs) + 255 * inner
    out = np.zeros(len(counts), np.uint64)
    ones = np.uint64(0x0101010101010101)
    for j in range(8):
        lane = np.add.reduceat((h >> np.uint64(j)) & ones, seg_start)
        per_byte = lane.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(per_byte, row_seg, axis=0)
        set_bits = 2 * total > counts[:, None]
        for b in range(8):
            out |= set_bits[:, b].astype(np.uint64) << np.uint64(8 * b + j)
    return out


def fingerprints_of(col: pa.Array) -> np.ndarray:
    """Shingle fingerprints."""
    buf, off = joined(col)
    return _shingle_fingerprints(*compact_words(buf, off))


def _distinct(h, owner, rows):
    """Distinct hashes of each row, in order, and how many each row has."""
    order = np.lexsort((h, owner))
    h, own = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(own[new], minlength=rows)


def _shingles(text, s, e, row, k, seed):
    """Hashes of the k-word shingles of the rows (a shorter text is one), and how many each row has."""
    words = np.diff(row)
    counts = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    first = np.cumsum(counts) - counts
    begin = np.repeat(row[:-1] - first, counts) + np.arange(counts.sum())
    last = np.minimum(begin + k, np.repeat(row[1:], counts)) - 1
    return xxh64(text, s[begin], e[last], seed), counts


def _shingle_fingerprints(text, s, e, row):
    h, counts = _shingles(text, s, e, row, SHINGLE, SEED)
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if len(full):
        c = counts[full]
        out[full] = majority(h, np.concatenate(([0], np.cumsum(c)[:-1])), c)
    return out


def _compared(text, s, e, row):
    """Distinct five-word shingles of the rows, how many each has, and one hash of the set of each."""
    h, counts = _shingles(text, s, e, row, COMPARED, SEED + 2)
    h, counts = _distinct(h, np.repeat(np.arange(len(counts)), counts), len(counts))
    node, full = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    if len(full):
        node[full] = mixed(np.add.reduceat(mixed(h), (np.cumsum(counts) - counts)[full]))
    return h, counts, node


def fingerprints(docs: DataFrame, words: bool = False) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprints as longs.

    If ``words``, also the columns h and row of ``docs``, node (hash of the set of compared shingles, null for
    a text without words), size (of that set), and level and sample, higher (null or the sample of the next level).
    """

    def run(batch):
        buf, off = joined(text_column(column(batch, "text")))
        parts = compact_words(buf, off)
        out = {"doc_id": column(batch, "doc_id").cast(pa.int64()), "fp": pa.array(_shingle_fingerprints(*parts).view(np.int64))}
        if words:
            h, size, node = _compared(*parts)
            level = levels(size)
            out |= {"h": column(batch, "h"), "row": column(batch, "row"), "node": pa.array(node.view(np.int64), mask=size == 0)}
            out |= {"size": pa.array(size, pa.int64()), "level": pa.array(level, pa.int64()), "sample": _sampled(h, size, level, size > 0)}
            out["higher"] = _sampled(h, size, level + 1, size >= SIMILARITY * (2 * LEAST_SAMPLE << level))
        return pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, fp long" + (", h long, row long, node long, size long, level long, sample array<long>, higher array<long>" if words else "")
    return by_piece(docs.select(F.col("doc_id").cast("long"), "text", *(["h", "row"] if words else [])), run, schema)


def levels(size: np.ndarray) -> np.ndarray:
    """Level k holds sets of up to ``2 * LEAST_SAMPLE * 2 ** k`` shingles, of which one in ``2 ** k`` counts."""
    return np.maximum(0, np.floor(np.log2(np.maximum(size, 1) / LEAST_SAMPLE)).astype(np.int64))


def _sampled(h: np.ndarray, size: np.ndarray, level: np.ndarray, used: np.ndarray) -> pa.Array:
    """The shingles of each set whose hash ends in ``level`` zero bits; null where not ``used``."""
    owner = np.repeat(np.arange(len(size)), size)
    kept = used[owner] & (mixed(h.copy()) & ((np.uint64(1) << level[owner].astype(np.uint64)) - np.uint64(1)) == 0)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[kept], minlength=len(size)))))
    return pa.LargeListArray.from_arrays(offsets, pa.array(h[kept].view(np.int64))).cast(pa.list_(pa.int64()))


def _with_sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, node) -> (g, node, shingles), from one text (h, text) of each node (node, h)."""
    listed = wanted.groupBy("node").agg(F.collect_list("g").alias("gs")).join(nodes.select("node", "h"), "node").select("h", "gs")

    def rows(batch):
        buf, off = joined(text_column(column(batch, "text")))
        h, size, node = _compared(*compact_words(buf, off))
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(size))), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
        gs = column(batch, "gs")
        pick = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(gs).to_numpy()))
        return pa.RecordBatch.from_arrays([gs.flatten(), pa.array(node.view(np.int64)).take(pick), lists.take(pick)], ["g", "node", "shingles"])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                yield rows(piece)

    small_batches(texts.sparkSession)
    one = texts.groupBy("h").agg(F.first("text").alias("text"))  # copies go before the exchange
    return one.join(listed, "h").select("h", "text", "gs").sortWithinPartitions("h").mapInArrow(run, "g long, node long, shingles array<long>")


# --- covering tables ------------------------------------------------------------


@cache
def _vectors(n: int, radius: int) -> list[int]:
    """A vector of ``radius + 1`` bits for each of n bits, such that no mask is empty (n > radius) and the least is large."""
    space = (1 << (radius + 1)) - 1
    if n >= space:
        return [i % space + 1 for i in range(n)]
    units = [1 << i for i in range(radius + 1)]
    others = [v for v in range(1, space + 1) if v not in units]
    best: tuple[int, list[int]] = (-1, [])
    for seed in range(40):
        found = (units + np.random.default_rng(seed).permutation(others).tolist())[:n]
        least = min(sum((m & v).bit_count() % 2 for m in found) for v in range(1, space + 1))
        best = max(best, (least, found), key=lambda x: x[0])
    return best[1]


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits`` such that any ``radius`` of them are left out together by some mask."""
    space = (1 << (radius + 1)) - 1
    vectors = _vectors(len(bits), radius)
    masks = []
    for v in range(1, space + 1):
        masks.append(sum(1 << b for b, m in zip(bits, vectors, strict=True) if (m & v).bit_count() % 2))
    return sorted(set(masks))


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """The masks that split a bucket of ``mask`` further; each has more bits than it if more than ``radius`` are free."""
    free = [b for b in range(64) if not mask >> b & 1]
    return sorted({mask | m for m in covering_masks(free, radius)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[list, list]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, a, b = fp, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
    return a, b


def _scan(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all complete buckets in rows sorted by (mask, key)."""
    new = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
    size = np.diff(np.append(new, len(key)))
    two = new[size == 2]
    near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
    a, b = [fp[near]], [fp[near + 1]]
    for s, n in zip(new[size > 2], size[size > 2], strict=True):
        x, y = forest(fp[s : s + n], radius)
        a += x
        b += y
    return np.concatenate(a), np.concatenate(b)


_OUT = ["a", "b", "mask"]


def _rows(a, b, mask) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b, mask)], _OUT)


def _buckets(batches: Iterator[pa.RecordBatch], radius: int, bucket: int, free_bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> edges (mask 0) and the members of oversized buckets (a = b = fp, mask of the bucket)."""
    held = [np.zeros(0, np.uint64)] * 3
    over = None  # the bucket that is being passed on

    def oversized(m) -> bool:
        return 64 - int(m).bit_count() > max(free_bits, radius)

    for batch in batches:
        m, k, f = (np.concatenate((h, column(batch, n).to_numpy().view(np.uint64))) for h, n in zip(held, ("mask", "key", "fp"), strict=True))
        if over is not None:
            same = (m == over[0]) & (k == over[1])
            yield _rows(f[same], f[same], m[same])
            m, k, f = m[~same], k[~same], f[~same]
            if not len(m):
                held = [m, k, f]
                continue
            over = None
        tail = np.flatnonzero((m != m[-1]) | (k != k[-1]))
        cut = int(tail[-1]) + 1 if len(tail) else 0
        held = [m[cut:], k[cut:], f[cut:]]
        if cut:
            yield from _complete(m[:cut], k[:cut], f[:cut], oversized, radius, bucket)
        if len(held[0]) > bucket and oversized(held[0][0]):
            over = (held[0][0], held[1][0])
            yield _rows(held[2], held[2], held[0])
            held = [x[:0] for x in held]
    if len(held[0]):
        yield from _complete(*held, oversized, radius, bucket)


def _complete(m, k, f, oversized, radius, bucket) -> Iterator[pa.RecordBatch]:
    new = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (k[1:] != k[:-1]))))
    size = np.diff(np.append(new, len(m)))
    big = [i for i in np.flatnonzero(size > bucket) if oversized(m[new[i]])]
    keep = np.ones(len(m), bool)
    for i in big:
        part = slice(new[i], new[i] + size[i])
        keep[part] = False
        yield _rows(f[part], f[part], m[part])
    if keep.any():
        a, b = _scan(m[keep], k[keep], f[keep], radius)
        if len(a):
            yield _rows(a, b, np.zeros(len(a), np.uint64))


def _split(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Members of oversized buckets -> rows of the finer tables."""
    for batch in batches:
        fp, mask = (column(batch, n).to_numpy().view(np.uint64) for n in ("a", "mask"))
        for m in np.unique(mask):
            mine = fp[mask == m]
            for finer in finer_masks(int(m), radius):
                finer = np.uint64(finer)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (np.full(len(mine), finer), mine & finer, mine)], ["mask", "key", "fp"]
                )


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int | None = None, free_bits: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all links within the radius.

    ``bucket`` and ``free_bits`` stand for ``BUCKET`` and ``FREE_BITS``; workers get them from here.
    """
    bucket, free_bits = BUCKET if bucket is None else bucket, FREE_BITS if free_bits is None else free_bits
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(list(range(64)), radius)])
    rows = distinct.select(F.explode(masks).alias("mask"), "fp").select("mask", F.expr("fp & mask").alias("key"), "fp")
    edges = None
    while True:
        dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = checkpointed(dealt.mapInArrow(lambda batches: _buckets(batches, radius, bucket, free_bits), "a long, b long, mask long"))
        part = found.where("mask = 0").select("a", "b")
        edges = part if edges is None else edges.unionAll(part)
        rest = found.where("mask <> 0")
        if rest.isEmpty():
            return edges
        rows = rest.mapInArrow(lambda batches: _split(batches, radius), "mask long, key long, fp long").distinct()


def similar(texts: DataFrame, fps: DataFrame) -> DataFrame:
    """Edges (a, b) among nodes whose sets are ``SIMILARITY`` alike, as the module describes. ``texts`` has h and text."""
    firsts = [F.min(c).alias(c) for c in ("size", "level", "sample", "higher", "h")]  # equal for all rows of a node, but for h
    nodes = checkpointed(fps.where("node IS NOT NULL").groupBy("node").agg(*firsts))
    ranks = F.array(F.struct(F.col("level").alias("g"), F.col("sample").alias("shingles")), F.struct((F.col("level") + 1).alias("g"), F.col("higher").alias("shingles")))
    ranked = nodes.select("node", F.explode(ranks).alias("r")).select("r.g", "node", F.size("r.shingles").cast("long").alias("size"), "r.shingles").where("size > 0")
    groups = alike.by_rare_items(ranked, F.when(F.col("g") == 0, SIMILARITY).otherwise(LOOSE))
    together = groups.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    members = checkpointed(groups.select("g", "node").join(together, "g").join(nodes.select("node", "size"), "node").select("g", "node", "size"))
    return alike.links(members, lambda wanted: _with_sets(texts, nodes, wanted), SIMILARITY)


def _named(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, least, root) of all fingerprints (fp, least)."""
    roots = components(edges)
    known = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return checkpointed(known)  # both sides of the next join are then plain, so a root with very many members can be split


def _hashes(docs: DataFrame) -> list:
    """h (hash of the text) and row (hash of all columns)."""
    odd = lambda f: any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if odd(f) else F.col(f"`{f.name}`") for f in docs.schema]
    return [F.xxhash64("text").alias("h"), F.xxhash64(*plain).alias("row")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *_hashes(docs))


def _all_links(docs: DataFrame, fps: DataFrame, groups: DataFrame) -> DataFrame:
    """Links of fingerprints and of compared sets; sets are a second kind of node, and every text joins its two nodes."""
    key = lambda c: F.xxhash64(c, F.lit("set"))
    pairs = similar(docs.select(F.xxhash64("text").alias("h"), "text"), fps)
    own = fps.where("node IS NOT NULL").select(F.col("fp").alias("a"), key("node").alias("b")).distinct()
    return links(groups.select("fp")).unionAll(pairs.select(key("a").alias("a"), key("b").alias("b"))).unionAll(own)


def near_duplicates(docs: DataFrame, words: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id reachable over links."""
    fps = checkpointed(fingerprints(_keyed(docs) if words else docs, words))
    groups = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    known = _named(groups, _all_links(docs, fps, groups) if words else links(groups.select("fp")))
    least = checkpointed(known.groupBy("root").agg(F.min("least").alias("component_id")))
    named = known.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group stays: the one with the smallest id, then the smallest hashes of text and row.

    A row is all its columns, so rows that share only an id are different documents; a row without id
    comes last in its group. Columns and their order are kept.
    """
    fps = checkpointed(fingerprints(_keyed(docs), True))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")
    groups = checkpointed(fps.groupBy("fp").agg(F.min(rank).alias("least")))
    known = _named(groups, _all_links(docs, fps, groups))
    same = fps.groupBy("doc_id", "h", "row").agg(F.count("*").alias("n"))
    kept = known.groupBy("root").agg(F.min("least").alias("k")).select("k.doc_id", "k.h", "k.row")
    match = lambda a, b: (a["row"] == b["row"]) & (a["h"] == b["h"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    kept = checkpointed(kept.join(same, match(kept, same)).select(kept["h"], kept["row"], kept["doc_id"], "n"))
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), *_hashes(docs))
    found = mine.join(kept, match(mine, kept)).select("d", mine["doc_id"], mine["h"], mine["row"], "n")
    repeated = found.where("n > 1").groupBy("doc_id", "h", "row").agg(F.first("d").alias("d"))
    return found.where("n = 1").select("d").unionByName(repeated.select("d")).select("d.*")


def op9(docs: DataFrame) -> DataFrame:
    """The contract of query op9."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
