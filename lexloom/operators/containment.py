"""Near-duplicates by containment in packs of any size: no two texts meet unless one may lie inside the other.

A contained text is found by one of its grams, its anchor: the gram of smallest hash. The same gram is the smallest of
a window of the containing text, so only smallest grams of windows are looked up there, and of these only what a
filter over all anchors of the packs lets through. What meets is checked by SHA-256 of the whole contained text. Texts
stay in their rows but for one copy of each that met an anchor; what is shuffled otherwise are hashes and offsets. Rows
are picked where they lie, by one bit each. Python sees a few hundred rows at a time and works on pieces of bounded size.
The greedy choice of a pack is made over the numbers of the rows that stand in a relation.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import strip
from lexloom.session import shared_folder

LONG = 80  # characters beyond which a text is dropped for containing or being contained
TIERS = ((64, 32), (24, 16), (8, 8), (4, 4), (2, 2), (1, 1))  # least bytes of a contained text, bytes of its anchor
FILTER_BITS = 1 << 26  # bits of a filter of a tier at most; more anchors only let more grams through
PROBES = 4  # bits of an anchor in a filter
PIECE_BYTES = 1 << 18  # text handled at once
BATCH_ROWS = 256  # rows that Python gets at once
NAME_BYTES = 16  # of the SHA-256 that stands for a text
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _runs(text: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(q, hash of every run of q bytes) for ascending sizes, by doubling."""
    text, step = text.astype(np.uint64), 1
    for q in sizes:
        if len(text) + step <= q:
            return
        while step < q:
            text = text[:-step] * (_C1 + np.uint64(2 * step)) + text[step:]
            step *= 2
        yield q, (text ^ np.uint64(q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _C1


def _key(x: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """Hash of a gram within a pack."""
    x = (x ^ pack) * _C1
    x = (x ^ (x >> np.uint64(32))) * _C2
    return x ^ (x >> np.uint64(29))


def _anchor_size(n: int) -> int:
    return next(q for least, q in TIERS if n >= least)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest value of a window of ``width`` around them; ties all count."""
    if width <= 1 or len(x) < width:
        return np.arange(len(x))

    def sliding(v, width, pick):
        span = 1
        while 2 * span <= width:
            v = pick(v[:-span], v[span:])
            span *= 2
        return pick(v[: len(v) - (width - span)], v[width - span:]) if width > span else v

    low = sliding(x, width, np.minimum)
    # no window around a position has a larger minimum than its value: it is the smallest of one if the largest equals it
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(x == sliding(np.concatenate([pad, low, pad]), width, np.maximum))


class _Piece:
    """The distinct texts of some rows, one after another (``buf``, ``off``), and every (text, pack) that occurs."""

    def __init__(self, rows: pa.RecordBatch):
        names = rows["__t"].dictionary_encode()
        number = names.indices.to_numpy()
        self.names = names.dictionary
        texts = rows["__low"].take(pa.array(np.unique(number, return_index=True)[1])).cast(pa.large_binary())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
        self.off = off - off[0]
        self.size = np.diff(self.off)
        pack = rows["__p"].to_numpy().view(np.uint64)
        order = np.lexsort((pack, number))
        text, pack = number[order], pack[order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (pack[1:] != pack[:-1])
        self.text, self.pack = text[new], pack[new]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    for b in batches:
        ends, at = np.cumsum(pc.binary_length(b["__low"]).to_numpy(), dtype=np.int64), 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
            yield _Piece(b.slice(at, stop - at))
            at = stop


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        sizes = np.array([_anchor_size(n) for n in piece.size.tolist()])
        gram, at = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64)
        for q in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == q)
            n = piece.size[mine]
            off = np.concatenate([[0], np.cumsum(n)])
            buf = piece.buf if len(mine) == len(sizes) else np.concatenate([piece.buf[piece.off[i]:piece.off[i + 1]] for i in mine.tolist()])
            _, x = next(_runs(buf, [q]))
            least = np.minimum.reduceat(np.append(x, np.uint64(0)), np.stack([off[:-1], off[1:] - q + 1], axis=1).ravel())[::2]
            found = np.flatnonzero(x == np.repeat(least, n)[: len(x)])
            own = np.searchsorted(off, found, side="right") - 1
            found, own = found[whole := found + q <= off[own + 1]], own[whole]
            own, first = np.unique(own, return_index=True)
            gram[mine], at[mine] = least, found[first] - off[own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_key(gram[piece.text], piece.pack).view(np.int64)), pa.array(gram[piece.text].view(np.int64)), pa.array(piece.pack.view(np.int64)),
             piece.names.take(pa.array(piece.text)), pa.array(at[piece.text].astype(np.int32)), pa.array(piece.size[piece.text].astype(np.int32))],
            ["k", "g", "p", "b", "at", "n"],
        )


def _marker(shared):
    """Grams of long texts that may be anchors: those of the sizes in use that are smallest in a window and pass the filter."""
    windows = {q: least - q + 1 for least, q in TIERS}

    def passing(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Places of the keys whose bits are all set; ``_filter`` sets them."""
        kept = np.arange(len(k))
        mask = np.uint64(len(words) * 64 - 1)
        for j in range(PROBES):
            low = ((k & mask) + np.uint64(j) * ((k >> np.uint64(32)) | np.uint64(1))) & mask
            ok = np.flatnonzero((words[(low >> np.uint64(6)).view(np.int64)] >> (low & np.uint64(63))) & np.uint64(1))
            k, kept = k[ok], kept[ok]
        return kept

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for piece in _pieces(batches):
            for q, x in _runs(piece.buf, sorted(tables)):
                grams, keys = tables[q]
                at = _smallest(x, windows[q])
                at = at[passing(grams, x[at])]
                own = np.searchsorted(piece.off, at, side="right") - 1
                whole = at + q <= piece.off[own + 1]
                at, own = at[whole], own[whole]
                first = np.searchsorted(own, np.arange(len(piece.size) + 1))
                n = np.diff(first)[piece.text]
                pair = np.repeat(np.arange(len(n)), n)
                at = at[np.repeat(first[piece.text] - (np.cumsum(n) - n), n) + np.arange(len(pair))]
                k = _key(x[at], piece.pack[pair])
                kept = passing(keys, k)
                if q == 1 and len(kept):  # the gram is the whole text: one place is enough
                    kept = kept[np.unique(np.stack([pair[kept], k[kept].view(np.int64)]), axis=1, return_index=True)[1]]
                if not len(kept):
                    continue
                text = piece.text[pair[kept]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[kept].view(np.int64)), piece.names.take(pa.array(text)), pa.array(piece.size[text].astype(np.int32)), pa.array((at[kept] - piece.off[text]).astype(np.int32))],
                    ["k", "a", "na", "ap"],
                )

    return marks


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, a, b, long) where the text of ``a`` holds the text of ``b`` at one of the places proposed."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch["__low"][i].as_buffer()
            found = batch["found"].slice(i, 1).flatten()
            start, n = (found.field(c).to_numpy() for c in ("s", "n"))
            # the same place for several packs, or the same text at several places, is read once
            names, ok, known = found.field("b"), np.zeros(len(found), bool), {}
            for j in range(len(found)):
                place = (int(start[j]), int(n[j]))
                if place not in known:
                    known[place] = hashlib.sha256(text[place[0]:place[0] + place[1]]).digest()[:NAME_BYTES]
                ok[j] = known[place] == names[j].as_py()
            hit = pa.array(np.flatnonzero(ok))
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [found.field("p").take(hit), pa.array([batch["__t"][i].as_py()] * len(hit), pa.binary()), names.take(hit), found.field("long").take(hit)],
                    ["p", "a", "b", "long"],
                )


def _choose(t: pa.Table) -> pa.Table:
    """Rows of one pack that the greedy rule keeps, in order of position; texts are numbers here."""
    t = t.sort_by([("position", "ascending"), ("__t", "ascending")]).combine_chunks()
    texts = t["__t"].combine_chunks().dictionary_encode()
    near = t["near"].combine_chunks()
    number = pc.fill_null(pc.index_in(near.flatten(), texts.dictionary), -1).to_numpy()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(near), 0).to_numpy(), dtype=np.int64)
    ends, number = np.searchsorted(np.flatnonzero(number >= 0), ends), number[number >= 0]
    kept = np.zeros(len(texts.dictionary), bool)
    ids: set = set()
    keep, start = [], 0
    for c, cid, end in zip(texts.indices.to_pylist(), t["__id"].to_pylist(), ends.tolist()):
        drop = kept[c] or (cid != "" and cid in ids) or (end > start and bool(kept[number[start:end]].any()))
        start = end
        keep.append(not drop)
        if not drop:
            kept[c] = True
            ids.add(cid)
    return t.filter(pa.array(keep)).select(["us"])


def _filter(anchors: DataFrame):
    """By size of anchor: bits of all its grams and of all its keys, ``PROBES`` for each, in two tables of bounded size that are sent to the tasks."""
    spark = anchors.sparkSession
    size = reduce(lambda c, x: c.when(F.col("n") >= x[0], x[1]), TIERS[1:], F.when(F.col("n") >= TIERS[0][0], TIERS[0][1]))
    sized = anchors.select(size.alias("q"), F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("k")) for i, c in enumerate("gk")])).alias("x")).select("q", "x.*")
    bits = {}
    for row in sized.groupBy("q").count().collect():
        bits[row["q"]] = 1 << 10
        while bits[row["q"]] < min(8 * row["count"], FILTER_BITS):
            bits[row["q"]] *= 2
    if not bits:
        return spark.sparkContext.broadcast({})
    mask = F.element_at(F.create_map(*[F.lit(x) for q, n in bits.items() for x in (q, n - 1)]), F.col("q")).cast("long")
    step = F.shiftrightunsigned("k", 32).bitwiseOR(F.lit(1))
    place = F.explode(F.array(*[(F.col("k").bitwiseAND(mask) + F.lit(j) * step).bitwiseAND(mask) for j in range(PROBES)]))
    words = sized.select("q", "kind", place.alias("i")).groupBy("q", "kind", F.shiftright("i", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(i & 63 AS INT))")).alias("v")
    ).toArrow()
    tables = {q: tuple(np.zeros(n // 64, np.uint64) for _ in "gk") for q, n in bits.items()}
    for q, pair in tables.items():
        for kind, table in enumerate(pair):
            mine = words.filter(pc.and_(pc.equal(words["q"], q), pc.equal(words["kind"], kind)))
            table[mine["w"].to_numpy()] = mine["v"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(tables)


def _picked(rows: DataFrame, numbers: DataFrame, folder: str) -> DataFrame:
    """Rows whose ``__u`` is among ``numbers`` (u), found where they lie: every task gets one bit for each row."""
    word = F.shiftright("u", 6).alias("__w")
    numbers.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, CAST(u & 63 AS INT))")).alias("__v")).write.parquet(folder)
    words = rows.sparkSession.read.parquet(folder)
    found = rows.withColumn("__w", F.shiftright("__u", 6)).join(F.broadcast(words), "__w")
    return found.where(F.expr("shiftrightunsigned(__v, CAST(__u & 63 AS INT)) & 1 = 1")).drop("__w", "__v")


def greedy_by_containment(scored: DataFrame, keys: Sequence[str], text: Column, chunk_id: Column) -> DataFrame:
    """Rows that are kept when every pack (``keys``) is read in order of ``position`` and a row is dropped if its text is
    blank, a kept row has its text or its chunk, or, beyond 80 characters, its text contains or lies in a kept one.

    Positions of a pack are distinct. The rows are written once to the shared folder.
    """
    spark = scored.sparkSession
    held = {name: spark.conf.get(name, None) for name in (_BATCH, _CLEAN)}
    spark.conf.set(_BATCH, str(BATCH_ROWS))  # one text may be long; all steps in Python end before this returns
    spark.conf.set(_CLEAN, "true")  # each step is written: what it shuffled is of no use after it
    try:
        return _greedy(scored, list(keys), text, chunk_id, f"{shared_folder(spark)}/containment-{uuid.uuid4().hex}")
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _greedy(scored: DataFrame, keys: list[str], text: Column, chunk_id: Column, folder: str) -> DataFrame:
    spark = scored.sparkSession

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    chars = strip(F.lower(F.coalesce(text, F.lit(""))))
    low = F.encode(chars, "UTF-8")
    known = F.when(F.length(low) > 0, F.unhex(F.substring(F.sha2(low, 256), 1, 2 * NAME_BYTES)))
    named = scored.withColumns({"__t": known, "__id": F.coalesce(chunk_id, F.lit("")), "__long": F.length(chars) > LONG})
    rows = staged(named.where("__t is not null").withColumn("__u", F.monotonically_increasing_id()), "rows")
    pack = F.xxhash64(*keys).alias("__p")  # two packs with one hash only share proposals, which name texts
    texts = rows.select("__t", pack, low.alias("__low"), "__long")

    proposed = texts.drop("__long").mapInArrow(_anchors, "k long, g long, p long, b binary, at int, n int")
    anchors = staged(proposed.dropDuplicates(["p", "b"]), "anchors")
    marks = texts.where("__long").drop("__long").mapInArrow(_marker(_filter(anchors)), "k long, a binary, na int, ap int")
    start = F.col("ap") - F.col("at")
    met = marks.join(anchors, "k").where((F.col("a") != F.col("b")) & (start >= 0) & (F.col("n") < F.col("na")) & (start + F.col("n") <= F.col("na")))
    met = staged(met.select("a", "p", "b", start.alias("s"), "n"), "met")
    long = rows.select(F.col("__t").alias("b"), "__long").where("__long").distinct()
    met = met.join(long, "b", "left").withColumn("long", F.col("__long").isNotNull())
    found = met.groupBy(F.col("a").alias("__t")).agg(F.collect_list(F.struct("p", "b", "s", "n", "long")).alias("found"))
    one = rows.select("__t", "__u").join(met.select(F.col("a").alias("__t")).distinct(), "__t", "left_semi").groupBy("__t").agg(F.min("__u").alias("u"))
    bodies = _picked(rows.select("__t", "__u", low.alias("__low")), one.select("u"), f"{folder}/bodies").select("__t", "__low")
    inside = staged(bodies.join(found, "__t").mapInArrow(_verified, "p long, a binary, b binary, long boolean"), "inside")
    # a short text is never dropped for what holds it, but has to be looked at with it
    related = inside.select("p", F.explode(F.array(F.struct(F.col("a").alias("__t"), F.col("b").alias("o")), F.struct(F.col("b").alias("__t"), F.when(F.col("long"), F.col("a")).alias("o")))).alias("r"))
    near = related.select(F.col("p").alias("__p"), "r.*").groupBy("__p", "__t").agg(F.collect_set("o").alias("near"))

    # a copy of a text under the same chunk never counts
    items = rows.select(*keys, "__t", "position", "__id", "__u")
    items = items.groupBy(*keys, "__t", "__id").agg(F.min("position").alias("position"), F.collect_list(F.struct("position", "__u")).alias("us"))
    items = items.withColumn("us", F.expr("transform(filter(us, x -> x.position <=> position), x -> x.__u)"))
    again = (F.col("__id") != "") & (F.count("*").over(Window.partitionBy(*keys, "__id")) > 1)
    items = items.withColumn("__again", again.cast("int"))
    of_text = Window.partitionBy(*keys, "__t")
    items = items.withColumns({"__open": F.max("__again").over(of_text) > 0, "__first": F.col("position") == F.min("position").over(of_text)})
    items = items.withColumn("__p", pack).join(near, ["__p", "__t"], "left").withColumn("__open", F.col("__open") | F.col("near").isNotNull())
    alone = items.where(~F.col("__open") & F.col("__first")).select("us")
    rest = items.where("__open").select(*keys, "__t", "position", "__id", "near", "us")
    chosen = rest.groupBy(*keys).applyInArrow(_choose, "us array<bigint>")
    kept = alone.unionByName(chosen).select(F.explode("us").alias("u"))
    return _picked(rows, kept, f"{folder}/kept").select(*scored.columns)
