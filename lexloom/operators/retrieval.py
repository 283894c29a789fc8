"""Filters, similarity search and candidate records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import constants as K
from lexloom.functions.text import filled, fixed, let, lookup, strip, tokens
from lexloom.operators.lexical import LexicalIndex
from lexloom.session import shared_folder

BROADCAST_QUERY_BYTES = 64 << 20  # query vectors copied to every task at most
BLOCK_ROWS = 20_000  # vectors per side of one block product


# --- embedding ---------------------------------------------------------------------------
def embed(df: DataFrame, col: str, encoder: Callable | None = None, dim: int = 256, out: str = "embedding") -> DataFrame:
    """Add L2-normalised vectors.

    ``encoder`` is a pandas UDF text → array<float> (load the model once per task
    with the iterator form). Without one, hashed term counts are used.
    """
    if encoder is not None:
        return df.withColumn(out, l2_normalised(encoder(F.col(col))))
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("__w", tokens(F.lower(F.coalesce(col, F.lit("")))))
    tf = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="__tf", outputCol="__u", p=2.0).transform(tf)
    return unit.withColumn(out, vector_to_array("__u", "float32")).drop("__w", "__tf", "__u")


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


# --- filters -----------------------------------------------------------------------------
def expand_areas(areas: Column) -> Column:
    """All spellings an area filter accepts: aliases, as given, upper, capitalised."""
    low = F.transform(F.filter(areas, lambda a: F.coalesce(a, F.lit("")) != ""), lambda a: F.lower(strip(a)))

    def spellings(a):
        cap = F.concat(F.upper(F.substring(a, 1, 1)), F.lower(F.substring(a, 2, 2147483647)))
        return F.concat(F.array(a), lookup(a, K.AREA_ALIASES, []), F.array(F.upper(a), cap))

    return F.array_distinct(F.flatten(F.transform(low, spellings)))


def legal_area_filter(areas: Column, chunk_area: Column) -> Column:
    """True when the chunk's area is accepted; no areas, no filter."""
    wanted = expand_areas(F.coalesce(areas, F.array().cast("array<string>")))
    return (F.size(wanted) == 0) | F.coalesce(F.array_contains(wanted, chunk_area), F.lit(False))


def accepted_products(category: Column) -> Column:
    """Product values a category accepts; null when there is no filter."""
    norm = F.regexp_replace(F.lower(strip(category)), "[- ]", "_")
    skip = F.coalesce(F.lower(strip(category)), F.lit("")).isin("", "unclassified")
    return F.when(~skip, F.array(F.lit("all"), norm))


def product_filter(category: Column, chunk_product: Column) -> Column:
    """"all" or the exact category; a list value such as "a;b" does not match."""
    values = accepted_products(category)
    return values.isNull() | F.coalesce(F.array_contains(values, chunk_product), F.lit(False))


def merge_filters(*filters: Column | None) -> Column:
    out = F.lit(True)
    for f in filters:
        if f is not None:
            out = out & f
    return out


def store_filter(chunks: DataFrame, areas: Column, category: Column) -> Column:
    """Filters that the store's columns allow: an absent column drops its filter."""
    have = set(chunks.columns)
    return merge_filters(
        legal_area_filter(areas, F.col("legal_area")) if "legal_area" in have else None,
        product_filter(category, F.col("applicable_product")) if "applicable_product" in have else None,
    )


# --- routing -----------------------------------------------------------------------------
def route(sub_queries: DataFrame) -> DataFrame:
    """Add collection, filter_areas and top_k by legal area; one plan for all areas."""
    coll = lookup(F.col("legal_area"), {a: c for a, c, _ in K.ROUTING}, K.ROUTING_DEFAULT[0])
    areas = lookup(F.col("legal_area"), {a: f for a, _, f in K.ROUTING}, K.ROUTING_DEFAULT[1])
    return sub_queries.withColumns(
        {"collection": coll, "filter_areas": areas, "top_k": F.lit(K.RETRIEVAL_DEPTH)}
    )


def collect_packs(*packs: DataFrame) -> DataFrame:
    """Union of parallel retrieval results."""
    out = packs[0]
    for p in packs[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --- exact similarity top-k ----------------------------------------------------------------
def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column without nulls and of one length, straight from its buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


BM25_ROWS = 1024  # chunks in a block of the lexical index
SCORE_CELLS = 4_000_000  # scores held at once in a task
KEPT_QUERIES = 8_192  # queries whose best rows are merged at once
BEST_GROUP = 32  # columns of which one maximum stands for all
BLOCKS = 16  # blocks of a side before blocks grow instead


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """(row, id, score) of the k best columns per row: score of nine decimals descending, id ascending.

    The k-th largest of the maxima of column groups bounds the k-th best from below; only what reaches it is rounded and sorted.
    """
    n = scores.shape[1]
    if n >= BEST_GROUP * k:
        whole = n // BEST_GROUP * BEST_GROUP
        tops = scores[:, :whole].reshape(len(scores), -1, BEST_GROUP).max(axis=2)
    else:
        tops = scores
    kk = min(k, tops.shape[1])
    kth = np.partition(tops, tops.shape[1] - kk, axis=1)[:, tops.shape[1] - kk]
    rows, cols = np.nonzero(scores >= kth[:, None] - 2e-9)
    vals, names = np.round(scores[rows, cols], 9), ids[cols]
    real = np.isfinite(vals)
    rows, vals, names = rows[real], vals[real], names[real]
    order = np.lexsort((names, -vals, rows))
    rows, vals, names = rows[order], vals[order], names[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], names[keep], vals[keep]


def _score_block(q_ids, q_mat, c_ids, c_mat, k, not_self):
    ids = np.asarray(list(c_ids))
    tile = max(1, SCORE_CELLS // max(1, len(ids)))
    sorter = np.argsort(ids, kind="stable") if not_self else None
    odd = np.flatnonzero(~np.isfinite(c_mat).all(axis=1))
    out = []
    for start in range(0, len(q_ids), tile):
        scores = q_mat[start:start + tile] @ c_mat.T
        scores[~np.isfinite(q_mat[start:start + tile]).all(axis=1)] = -np.inf
        scores[:, odd] = -np.inf
        if not_self:
            own = np.asarray(list(q_ids[start:start + tile]))
            low, high = (np.searchsorted(ids, own, side, sorter=sorter) for side in ("left", "right"))
            for row in np.flatnonzero(low < high):
                scores[row, sorter[low[row]:high[row]]] = -np.inf
        r, n, v = _best(scores, ids, k)
        out.append((r + start, n, v))
    return tuple(np.concatenate(x) for x in zip(*out))


def _top_k(hits: DataFrame, q_keys: Sequence[str], c_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(*q_keys).orderBy(F.col("score").desc(), F.col(c_id))
    # row_number ≤ k directly above the score: Spark prunes per task before the shuffle.
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    q_id: str = "query_id",
    c_id: str = "chunk_id",
    on: Sequence[str] = (),
    blocked: bool | None = None,
    not_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine top-k: (q_id, c_id, score, rank).

    ``on`` lists columns of both sides that must be equal: filters become an
    equality before any product is computed (explode a query to one row per
    accepted value; the final top-k merges them).

    Two exact plans. If the query vectors fit ``BROADCAST_QUERY_BYTES`` (checked)
    they go to every task and the chunks are scanned in place without a shuffle;
    each task keeps k per query. Otherwise both sides are cut into blocks of
    ``block_rows`` (more, up to ``BLOCK_ROWS``, where that would give over ``BLOCKS``
    blocks) and every pair of blocks is one task-sized product that emits
    k rows per query. ``blocked`` forces the choice.

    Rows whose vector is null or has another length than the queries' longest take
    no part; a null in an ``on`` column equals nothing.
    """
    on = list(on)
    key = F.to_json(F.struct(*on)) if on else F.lit("")
    known = F.lit(True)
    for name in on:
        known &= F.col(name).isNotNull()
    q = queries.where(known).select(key.alias("__k"), F.col(q_id).alias("__q"), F.col("embedding").alias("__qv"))
    c = chunks.where(known).select(key.alias("__k"), F.col(c_id).alias("__c"), F.col("embedding").alias("__cv"))
    dim = q.agg(F.max(F.size("__qv"))).first()[0] or 0
    q, c = q.where(F.size("__qv") == dim), c.where(F.size("__cv") == dim)
    schema = T.StructType(
        [
            T.StructField("__q", q.schema["__q"].dataType),
            T.StructField("__c", c.schema["__c"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    local = None
    if not blocked:
        local = _bounded_queries(q, dim)
        if local is None and blocked is False:
            raise ValueError("query vectors exceed the broadcast bound; use blocked=True")
    hits = _scan_in_place(local, c, k, schema, not_self) if local is not None else _blocked(
        q, c, k, schema, not_self, block_rows
    )
    out = _top_k(hits, ["__q"], "__c", k)
    return out.select(F.col("__q").alias(q_id), F.col("__c").alias(c_id), "score", "rank")


def _bounded_queries(q: DataFrame, dim: int):
    """The query rows, if their total size passes the check; else None."""
    n = q.count()
    if n * dim * 8 > BROADCAST_QUERY_BYTES:
        return None
    return q.toArrow()


def _scan_in_place(local: pa.Table, c, k, schema, not_self) -> DataFrame:
    spark = c.sparkSession
    if not local.num_rows:
        return spark.createDataFrame([], schema)
    keys = np.array(local.column("__k").to_pylist(), dtype=object)
    ids = np.array(local.column("__q").to_pylist())
    vecs = _vectors(local.column("__qv"))
    q_type = local.column("__q").type
    shared = spark.sparkContext.broadcast({key: (ids[keys == key], vecs[keys == key]) for key in set(keys)})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        kept: dict = {}
        c_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c_type = batch.column("__c").type
            coded = batch.column("__k").dictionary_encode()
            codes = coded.indices.to_numpy()
            found = [(i, key) for i, key in enumerate(coded.dictionary.to_pylist()) if key in table]
            if not found:
                continue
            c_ids = np.asarray(batch.column("__c").to_pylist())
            mat = _vectors(batch.column("__cv"))
            for i, key in found:
                take = np.flatnonzero(codes == i)
                q_ids, q_mat = table[key]
                r, cid, val = _score_block(q_ids, q_mat, c_ids[take], mat[take], k, not_self)
                kept[key] = _kept(kept.get(key), (r.astype(np.int32), cid, val), k)
        for key, part in kept.items():
            yield _hits(table[key][0], q_type, part, c_type, ["__q", "__c", "score"])

    return c.mapInArrow(scan, schema)


def _hits(q_ids: np.ndarray, q_type: pa.DataType, part: tuple, c_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """Kept rows with the id types of their tables."""
    r, c, s = part
    return pa.RecordBatch.from_arrays([pa.array(q_ids[r], q_type), pa.array(c, c_type), pa.array(s, pa.float64())], names)


def _kept(before: tuple | None, part: tuple, k: int) -> tuple:
    """The k best rows per query (r) of what a task has seen: score (s) descending, id (c) ascending."""
    if before is None:
        return part
    out = []
    # by ranges of queries, so that only one range is held twice
    for first in range(0, int(max(before[0][-1:].max(initial=-1), part[0][-1:].max(initial=-1))) + 1, KEPT_QUERIES):
        cut = [slice(*np.searchsorted(x[0], (first, first + KEPT_QUERIES))) for x in (before, part)]
        r, c, s = (np.concatenate([before[i][cut[0]], part[i][cut[1]]]) for i in range(3))
        order = np.lexsort((c, -s, r))
        order = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < k]
        out.append((r[order], c[order], s[order]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else part


def _blocked(q, c, k, schema, not_self, block_rows) -> DataFrame:
    """Block-by-block products as a cogroup; both group sides are bounded by the block size."""

    def counts(df, name):
        # every row is sent once per block of the other side: blocks grow to BLOCK_ROWS before their number does
        rows = F.greatest(F.lit(block_rows), F.least(F.lit(max(block_rows, BLOCK_ROWS)), F.ceil(F.count("*") / F.lit(BLOCKS))))
        n = F.ceil(F.count("*") / rows).cast("int")
        return df.groupBy("__k").agg(n.alias(name))

    plan = counts(q, "__nq").join(counts(c, "__nc"), "__k")
    # hash of the id: an even, deterministic block number, stable when tasks are rerun
    q = q.join(plan, "__k").withColumn("__qb", F.pmod(F.xxhash64("__q"), "__nq").cast("int"))
    q = q.withColumn("__cb", F.explode(F.sequence(F.lit(0), F.col("__nc") - 1)))
    c = c.join(plan, "__k").withColumn("__cb", F.pmod(F.xxhash64("__c"), "__nc").cast("int"))
    c = c.withColumn("__qb", F.explode(F.sequence(F.lit(0), F.col("__nq") - 1)))
    bkeys = ["__k", "__qb", "__cb"]
    qg = q.select(*bkeys, "__q", "__qv").groupBy(*bkeys)
    cg = c.select(*bkeys, "__c", "__cv").groupBy(*bkeys)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"__q": left["__q"][:0], "__c": right["__c"][:0], "score": pa.array([], pa.float64())})
        ids, names = np.asarray(left["__q"].to_pylist()), np.asarray(right["__c"].to_pylist())
        r, cid, val = _score_block(ids, _vectors(left["__qv"]), names, _vectors(right["__cv"]), k, not_self)
        return pa.table({"__q": pa.array(ids[r], left["__q"].type), "__c": pa.array(cid, right["__c"].type), "score": pa.array(val)})

    return qg.cogroup(cg).applyInArrow(product, schema)


def overfetch(queries: DataFrame, chunks: DataFrame, k: int, multiplier: int = 3, **kw) -> DataFrame:
    """k × multiplier candidates, to be reranked and cut to k."""
    return cosine_topk(queries, chunks, k * multiplier, **kw)


def filtered_topk(sub_queries: DataFrame, chunks: DataFrame, k: int = K.RETRIEVAL_DEPTH) -> DataFrame:
    """Routed, filtered retrieval of sub-queries (keyed by query_id, area_ix).

    The area and product filters turn into equality with exploded accepted
    values, so only matching (sub-query, chunk) pairs are ever scored. No areas or
    no category means no such filter.
    """
    have = set(chunks.columns)
    sq = sub_queries.withColumn("__sub", F.concat_ws("#", F.col("query_id").cast("string"), F.col("area_ix").cast("string")))
    keyed = chunks
    always = []
    if "collection_name" in have:
        sq, keyed = sq.withColumn("__coll", F.col("collection")), keyed.withColumn("__coll", F.col("collection_name"))
        always.append("__coll")
    wanted: dict = {}
    if "legal_area" in have:
        areas = expand_areas(F.coalesce("filter_areas", F.array().cast("array<string>")))
        wanted["__area"] = F.when(F.size(areas) > 0, areas)
        keyed = keyed.withColumn("__area", F.col("legal_area"))
    if "applicable_product" in have:
        wanted["__prod"] = F.array_distinct(accepted_products(F.col("product_category")))
        keyed = keyed.withColumn("__prod", F.col("applicable_product"))
    # Sub-queries without areas or category have no such filter. They are searched
    # apart, on fewer keys, so that no chunk is ever listed under several values.
    flags = [c.isNotNull().alias(name) for name, c in wanted.items()]
    hits = None
    for row in sq.select(*flags, F.lit(True).alias("any")).distinct().collect():
        part, on = sq, list(always)
        for name, values in wanted.items():
            part = part.where(values.isNotNull() if row[name] else values.isNull())
            if row[name]:
                part = part.withColumn(name, F.explode_outer(values))
                on.append(name)
        found = cosine_topk(part, keyed, k, q_id="__sub", on=on)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = cosine_topk(sq, keyed, k, q_id="__sub")
    subs = sub_queries.withColumn(
        "__sub", F.concat_ws("#", F.col("query_id").cast("string"), F.col("area_ix").cast("string"))
    )
    return hits.join(subs.select("__sub", "query_id", "area_ix"), "__sub").drop("__sub")


# --- candidates --------------------------------------------------------------------------
def keyword_overlap(query: Column, text: Column) -> Column:
    """Share of query words (longer than two) contained in the text, without case."""
    words = F.filter(F.transform(tokens(query), F.lower), lambda t: F.length(t) > 2)

    def share(low):
        return let(words, lambda ws: F.size(F.filter(ws, lambda t: F.contains(low, t))) / F.nullif(F.size(ws), F.lit(0)))

    return F.coalesce(F.bround(F.least(let(F.lower(text), share), F.lit(1.0)), 4), F.lit(0.0))


def to_candidate(hits: DataFrame) -> DataFrame:
    """Candidate record from a hit joined with its chunk; absent columns count as missing."""
    have = set(hits.columns)

    def first_of(names: Sequence[str], default: str) -> Column:
        cols = [F.col(n).cast("string") for n in names if n in have]
        return filled(cols[0], *cols[1:], default) if cols else F.lit(default)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    text = F.coalesce(*[F.col(n) for n in ("original_content", "page_content", "text") if n in have])
    out = hits.select(
        *[c for c in ("query_id", "area_ix", "query_text") if c in have],
        F.coalesce(col("chunk_id"), F.lit("unknown")).alias("chunk_id"),
        text.alias("text"),
        first_of(["provision_ref", "section", "section_number"], "N/A").alias("provision"),
        first_of(["section_title", "source_title", "title"], "N/A").alias("title"),
        F.coalesce(col("chapter"), F.lit("N/A")).alias("chapter"),
        F.concat(
            F.coalesce(col("start_page"), F.lit("?")), F.lit(" to "), F.coalesce(col("end_page"), F.lit("?"))
        ).alias("pages"),
        first_of(["source_title", "title", "document_id", "source_id"], "Unknown Document").alias("source_authority"),
        col("authority_level").alias("authority_level"),
        col("document_type").alias("document_type"),
        F.when(F.lower(F.coalesce(col("jurisdiction"), F.lit("india"))) == "india", "india")
        .otherwise("international").alias("jurisdiction"),
        col("legal_area").alias("legal_area"),
        F.bround(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)), 4).alias("vector_score"),
        *([F.col("rank")] if "rank" in have else []),
    )
    if "query_text" not in have:
        return out
    return out.withColumn("keyword_score", keyword_overlap(F.col("query_text"), F.col("text")))


def context_blocks(ranked: DataFrame, keep: int) -> DataFrame:
    """Single-store context text of the best ``keep`` candidates per query."""
    top = ranked.where(F.col("position") <= keep)
    block = F.concat(
        F.lit("["), "provision", F.lit(" - "), "title", F.lit("] (Chapter: "), "chapter", F.lit(", Pages: "), "pages",
        F.lit(", Type: "), F.coalesce("document_type", F.lit("N/A")), F.lit(", Effective: "),
        F.coalesce(F.col("effective_from").cast("string"), F.lit("N/A")), F.lit(", Re-rank score: "),
        fixed(F.col("final_score"), 4), F.lit(")\n"), "text",
    )
    return top.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))), lambda x: x["b"]),
            "\n\n---\n\n",
        ).alias("context")
    )


# --- lexical search (opt-in) ---------------------------------------------------------------
def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over white-space words; off in the answer flow. For one search only: a corpus that is searched again keeps a ``LexicalIndex``."""
    spark = chunks.sparkSession
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    return LexicalIndex(spark, folder, shards=1, block_chunks=BM25_ROWS).append(chunks).topk(queries, k, k1, b)
