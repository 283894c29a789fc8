"""Phrase collocations (13): n-grams counted in quotient filters, then cut and compared.

Texts are divided into shards (a few megabytes of text each); a shard holds its words as
numbers of its own dictionary, so texts are read once.

1. Words: the dictionaries of all shards are summed per language; words with ``MIN_COUNT``
   occurrences get dense numbers, which return to the shards that hold them.
2. Phrases of n words, n = 2, 3, 4: the key is the number of the phrase's first n - 1 words
   and the number of its last word, packed. A position counts only where both phrases of
   n - 1 words in it are frequent, which loses no candidate. Each shard counts its keys in a
   quotient filter; the runs of one quotient from all shards are merged, keys that reach
   ``MIN_COUNT`` get numbers, and these return to the shards that hold them.
3. Frequent phrases are spelled out by joins, cut in every way, compared with the longer
   phrases around them and ranked, as DataFrame operations.

A message is one non-empty run of a shard, so messages never outnumber keys. Quotients
grow with the corpus, so a merged group stays near ``GROUP`` keys. Nothing is sampled, and
only sizes (words, frequent phrases, partition counts) reach the driver. Scores and
comparisons use decimals of 38 digits.

* Null and empty texts have no words; a null language counts as ``und``.
* Every row counts: repeated rows and ids add their words again.
* A very long text is a shard of its own.
* Only ``lang`` and ``text`` are read; other columns never clash.
* A table without frequent phrases gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, column, compact, joined, pieces, small_batches, staged, text_column, word_edges, word_numbers
from lexloom.llm.quotient_filter import COUNTER, Layout, build, merge

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
SHARD_BYTES = 1 << 21
GROUP = 1 << 19
LEAST_QUOTIENT_BITS = 8

#: Bytes that end a piece, and all bytes that end a word.
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
APART = BREAK.copy()
APART[list(b" \t")] = True

_SHARD = "shard long, codes binary, entries array<struct<lang: string, word: string, n: long>>"
_STATE = "shard long, prefix binary, last binary"
_MESSAGE = "quotient long, shard long, remainders binary, counters binary"
_MERGED = "quotient long, shard long, keys binary, ids binary, counts binary"


# --- shards -----------------------------------------------------------------------


def _sequence(buf: np.ndarray, off: np.ndarray):
    """Word numbers, and the row of each word; True before each word that begins a piece."""
    out, starts, ends, row = compact(buf, off, APART)
    seen = np.concatenate(([0], np.cumsum(BREAK[buf])))
    s, _ = word_edges(buf, APART)
    begins = np.ones(len(s), bool)
    begins[1:] = seen[s[1:]] != seen[s[:-1]]
    return out, starts, ends, np.repeat(np.arange(len(row) - 1), np.diff(row)), begins


def _shard(batch: pa.RecordBatch, shard: int) -> pa.RecordBatch:
    buf, off = joined(text_column(column(batch, "text")))
    buf = LOWER[buf]
    out, starts, ends, row, begins = _sequence(buf, off)
    langs = pc.fill_null(column(batch, "lang"), "und").dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    number = word_numbers(out, starts) if len(starts) else np.zeros(0, np.int64)
    words = int(number.max(initial=-1)) + 1
    entry, first, local, n = np.unique(lang[row] * max(words, 1) + number, return_index=True, return_inverse=True, return_counts=True)
    data = out.tobytes()
    spelled = [data[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    at = np.arange(len(local)) + np.cumsum(begins)  # a zero stands before each piece
    codes = np.zeros(len(local) + int(begins.sum()) + 1, "<u4")
    codes[at] = local.reshape(-1) + 1
    values = pa.StructArray.from_arrays([langs.dictionary.take(pa.array(entry // max(words, 1))).cast(pa.string()), pa.array(spelled, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])
    lists = pa.ListArray.from_arrays(pa.array([0, len(entry)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([codes.tobytes()], pa.binary()), lists], ["shard", "codes", "entries"])


def _stretches(batches):
    """Batches of any size as batches of about ``SHARD_BYTES`` of text; a longer text is one of its own."""
    held, size = [], 0
    for batch in batches:
        for piece in pieces(batch, size=SHARD_BYTES):
            more = pc.sum(pc.binary_length(column(piece, "text"))).as_py() or 0
            if held and size + more > SHARD_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(piece)
            size += more
    if held:
        yield pa.concat_batches(held)


def shards(docs: DataFrame) -> DataFrame:
    """One row for each stretch of about ``SHARD_BYTES`` of text: its dictionary, and its words as numbers of it."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(_stretches(batches)):
            yield _shard(rows, base + k)

    small_batches(docs.sparkSession)  # a batch may be many times a shard otherwise
    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, _SHARD)


# --- numbers ----------------------------------------------------------------------


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows with a dense number ``id`` from 1, and how many there are. One count per partition reaches the driver."""
    kept = staged(df.withColumn("at", F.monotonically_increasing_id()))
    base, total = {}, 0
    for part, n in sorted(kept.groupBy(F.shiftright("at", 33).alias("p")).count().collect()):
        base[part] = total
        total += n
    if not base:
        return kept.withColumnRenamed("at", "id"), 0
    starts = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    return kept.withColumn("id", F.element_at(starts, F.shiftright("at", 33)) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at"), total


def _bytes(values, kind) -> bytes:
    return np.asarray(values).astype(kind).tobytes()


def _kind(most: int) -> str:
    return "<u4" if most < 1 << 32 else "<u8"


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """Positions to keep so that zeros never follow each other."""
    return np.flatnonzero((ids > 0) | np.concatenate(([True], ids[:-1] > 0))) if len(ids) else np.zeros(0, np.int64)


def _read(binary: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(binary[0].as_py(), kind)


def word_states(parts: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """Every shard as numbers of frequent words (``prefix``; other words and breaks are 0; ``last`` is the same)."""
    kind = _kind(n_words)
    entries = parts.select("shard", F.posexplode("entries").alias("local", "e")).select("shard", "local", "e.lang", "e.word")
    found = entries.join(words.select("lang", "word", "id"), ["lang", "word"])
    maps = found.groupBy("shard").agg(F.collect_list(F.struct("local", "id")).alias("ids"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                codes = _read(column(one, "codes"), "<u4").astype(np.int64)
                pairs = column(one, "ids").flatten()
                local, ids = (pairs.field(n).to_numpy(zero_copy_only=False) for n in ("local", "id"))
                table = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
                table[local + 1] = ids
                seq = table[codes]
                yield pa.RecordBatch.from_pydict({"shard": column(one, "shard"), "prefix": pa.array([_bytes(seq[_squeezed(seq)], kind)], pa.binary()), "last": pa.array([None], pa.binary())})

    small_batches(parts.sparkSession, 1)
    return staged(parts.select("shard", "codes").join(maps, "shard").mapInArrow(run, _STATE))


# --- counting ---------------------------------------------------------------------


def _pairs(batch: pa.RecordBatch, prefix_kind: str, word_kind: str, n_words: int):
    """Shard, prefix numbers, last words, positions that hold a phrase, and the key of each."""
    prefix = _read(column(batch, "prefix"), prefix_kind).astype(np.uint64)
    last = prefix if not column(batch, "last")[0].is_valid else _read(column(batch, "last"), word_kind).astype(np.uint64)
    at = np.flatnonzero((prefix[:-1] > 0) & (prefix[1:] > 0)) if len(prefix) else np.zeros(0, np.int64)
    return column(batch, "shard")[0].as_py(), last, at, prefix[at] * np.uint64(n_words + 1) + last[at + 1] if len(at) else np.zeros(0, np.uint64)


def _chunks(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One array of bytes as binary values that end at ``ends``."""
    edges = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def filters(states: DataFrame, layout: Layout, prefix_kind: str, n_words: int) -> DataFrame:
    """The non-empty runs of the filter of every shard."""
    word_kind = _kind(n_words)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, _, _, keys = _pairs(batch.slice(k, 1), prefix_kind, word_kind, n_words)
                quotient, ends, rest, counts = build(keys, layout)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(quotient.astype(np.int64)), pa.array(np.full(len(quotient), shard), pa.int64()),
                        _chunks(layout.pack(rest), ends * layout.width), _chunks(counts.astype(COUNTER).view(np.uint8), ends * COUNTER.itemsize),
                    ],
                    ["quotient", "shard", "remainders", "counters"],
                )

    small_batches(states.sparkSession, 8)
    return states.mapInArrow(run, _MESSAGE)


def _flat(col) -> np.ndarray:
    """The bytes of all values of a binary column, one after another."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8)


def merged(messages: DataFrame, layout: Layout, min_count: int) -> DataFrame:
    """Frequent keys: a row per quotient (shard null) with counts, and one for each shard that holds any of them.

    Numbers are dense enough: position in the quotient, times the quotients, plus the quotient, plus 1.
    """
    quotients = 1 << layout.quotient_bits

    def run(table: pa.Table) -> pa.Table:
        quotient = table.column("quotient")[0].as_py()
        remainders = layout.unpack(_flat(table.column("remainders")))
        counters = _flat(table.column("counters")).view(COUNTER)
        sizes = pc.binary_length(table.column("remainders")).to_numpy() // layout.width
        run_r, run_c = merge(remainders, counters)
        del counters
        often = run_c >= min_count
        run_r, run_c = run_r[often], run_c[often]
        ids = np.arange(len(run_r), dtype=np.int64) * quotients + quotient + 1
        keys = layout.whole(quotient, run_r)
        rows = {"shard": [None], "keys": [_bytes(keys, "<u8")], "ids": [_bytes(ids, "<u8")], "counts": [_bytes(run_c, "<u8")]}
        if len(run_r):
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for k, shard in enumerate(table.column("shard").to_pylist()):
                own = remainders[ends[k] : ends[k + 1]]  # sorted, as the run is
                mine = np.minimum(np.searchsorted(run_r, own), len(run_r) - 1)
                mine = mine[run_r[mine] == own]
                if len(mine):
                    for name, value in (("shard", shard), ("keys", _bytes(keys[mine], "<u8")), ("ids", _bytes(ids[mine], "<u8")), ("counts", None)):
                        rows[name].append(value)
        rows["quotient"] = [quotient] * len(rows["shard"])
        types = {"quotient": pa.int64(), "shard": pa.int64(), "keys": pa.binary(), "ids": pa.binary(), "counts": pa.binary()}
        return pa.table({n: pa.array(rows[n], t) for n, t in types.items()})

    return messages.groupBy("quotient").applyInArrow(run, _MERGED)


def phrases(found: DataFrame, n_words: int) -> DataFrame:
    """(id, prefix, last, f) of all frequent keys."""

    def run(batches):
        for batch in batches:
            keys, ids, counts = (_flat(column(batch, n)).view("<u8") for n in ("keys", "ids", "counts"))
            base = np.uint64(n_words + 1)
            yield pa.RecordBatch.from_pydict({n: pa.array(v.astype(np.int64)) for n, v in (("id", ids), ("prefix", keys // base), ("last", keys % base), ("f", counts))})

    return found.where("shard IS NULL").select("keys", "ids", "counts").mapInArrow(run, "id long, prefix long, last long, f long")


def advanced(states: DataFrame, found: DataFrame, prefix_kind: str, kind: str, n_words: int) -> DataFrame:
    """The shards as numbers of frequent phrases that are one word longer, where there are any."""
    word_kind = _kind(n_words)
    back = found.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("keys", "ids")).alias("found"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                shard, last, at, mine = _pairs(one, prefix_kind, word_kind, n_words)
                pairs = column(one, "found").flatten()
                keys, ids = (_flat(pairs.field(n)).view("<u8") for n in ("keys", "ids"))
                order = np.argsort(keys)
                keys, ids = keys[order], ids[order]
                where = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                seq = np.zeros(len(last), np.uint64)
                seq[at] = np.where(keys[where] == mine, ids[where], 0)
                kept = _squeezed(seq)
                ends = last[np.minimum(kept + 1, len(last) - 1)]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard]), "prefix": pa.array([_bytes(seq[kept], kind)], pa.binary()), "last": pa.array([_bytes(ends, word_kind)], pa.binary())})

    small_batches(states.sparkSession, 1)
    return staged(states.join(back, "shard").mapInArrow(run, _STATE))


# --- phrases ----------------------------------------------------------------------


def counted(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, words, a), single words included, and all word occurrences (lang, n)."""
    parts = staged(shards(docs))
    entries = parts.select(F.explode("entries").alias("e")).select("e.*")
    totals = staged(entries.groupBy("lang").agg(F.sum("n").alias("n")))
    words, n_words = numbered(entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count))
    spelled = words.select("id", "lang", F.array("word").alias("words"), "f")
    out = [spelled.select("lang", "words", F.col("f").alias("a"))]
    total = totals.agg(F.sum("n")).first()[0] or 0
    quotient_bits = max(LEAST_QUOTIENT_BITS, math.ceil(math.log2(max(1, total / GROUP))))
    last = words.select(F.col("id").alias("last"), "word")
    states, kind, most = word_states(parts, words, n_words), _kind(n_words), n_words
    for n in range(2, longest + 1 if n_words else 0):
        bits = max(quotient_bits + 1, ((most + 1) * (n_words + 1)).bit_length())
        layout = Layout(bits, quotient_bits)
        found = staged(merged(filters(states, layout, kind, n_words), layout, min_count))
        table = staged(phrases(found, n_words).join(last, "last").join(spelled.select(F.col("id").alias("prefix"), "lang", "words"), "prefix").select("id", "lang", F.concat("words", F.array("word")).alias("words"), "f"))
        most = table.agg(F.max("id")).first()[0]
        out.append(table.select("lang", "words", F.col("f").alias("a")))
        if most is None or n == longest:
            break
        states, kind, spelled = advanced(states, found, kind, _kind(most), n_words), _kind(most), table
    every = reduce(DataFrame.unionByName, out)
    return staged(every.withColumn("phrase", F.concat_ws(" ", "words"))), totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, inside): all candidates; ``inside``: a longer one holds it at least four times of five."""
    every, totals = counted(docs, min_count, longest)
    part = lambda at, size: F.concat_ws(" ", F.slice("words", at, size))
    long = every.where(F.size("words") > 1)
    cut = long.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words")).alias("rest"))
    left = every.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = every.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = F.expr(f"({SCALE} * CAST(a AS DECIMAL(20, 0))) DIV CAST(l + r AS DECIMAL(20, 0))")
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = long.where(F.size("words") > 2).select("lang", "words", F.col("a").alias("f"), F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    spans = spans.select("lang", "words", "f", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    around = spans.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("f"))
    inside = F.expr("coalesce(100 * CAST(f AS DECIMAL(20, 0)) >= 80 * CAST(a AS DECIMAL(20, 0)), false)")
    out = lowest.join(around, ["lang", "phrase"], "left").join(totals, "lang")
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", inside.alias("inside"))


def op13(docs: DataFrame) -> DataFrame:
    """The contract of query op13: the first ``TOP`` of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs).where("NOT inside").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """op13 in DuckDB SQL: every n-gram of every piece, counted."""
    breaks, blanks = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '{breaks}')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '{blanks}') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, size, w[k:k + size - 1] AS g
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM words, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)
), freq AS (
  SELECT lang, size, g, array_to_string(g, ' ') AS phrase, count(*) AS a FROM grams GROUP BY lang, size, g HAVING count(*) >= {MIN_COUNT}
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, CAST({SCALE} * CAST(c.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score
  FROM (SELECT lang, phrase, g, size, a, unnest(generate_series(1, size - 1)) AS k FROM freq WHERE size > 1) c
  JOIN freq l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN freq r ON r.lang = c.lang AND r.g = c.g[c.k + 1:]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), spans AS (
  SELECT lang, a, g, k, unnest(generate_series(k + 1, size)) AS e, size
  FROM (SELECT lang, a, g, size, unnest(generate_series(1, size - 1)) AS k FROM freq WHERE size > 2)
), around AS (
  SELECT lang, array_to_string(g[k:e], ' ') AS phrase, max(a) AS f FROM spans WHERE e - k + 1 < size GROUP BY 1, 2
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, t.n, c.score
  FROM lowest c JOIN totals t ON t.lang = c.lang LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE NOT coalesce(100 * CAST(o.f AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT), false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}"""
