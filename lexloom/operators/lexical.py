"""A stored inverted index for lexical search (opt-in).

Texts are tokenised once, when they are appended. A task cuts its chunks into blocks and writes, per block, a
header (chunk ids, lengths) and one row per word: the chunks that hold it, how often, and maxima. Rows are
filed by shard of the word, so a search reads the shards of its own words only, and nothing is shuffled to build.

A search first reads the maxima alone. A word's best chunk of a block proves that some chunk scores at least
so much, so the k-th best block gives a threshold per query; a block whose summed maxima stay below it holds
no result and is not opened. What is opened is scored exactly, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import tokens

BATCH = "batch"
HEADERS = -1  # the shard of the headers
SLACK = 2e-6  # scores are rounded to six decimals


def _schema(chunk_type: T.DataType) -> T.StructType:
    def listed(name: str, of: T.DataType) -> T.StructField:
        return T.StructField(name, T.ArrayType(of))

    numbers = [T.StructField(n, T.IntegerType()) for n in ("n_docs", "max_tf", "min_dl", "top_tf", "top_dl")]
    return T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), *numbers, T.StructField("words", T.LongType()),
         listed("ids", chunk_type), listed("dl", T.IntegerType()), listed("docs", T.IntegerType()), listed("tf", T.IntegerType())]
    )


def _block(block: int, part: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Header and postings of one block of chunks (chunk_id, w: words or null)."""
    words, n = part.column("w"), part.num_rows
    dl = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + pc.list_parent_indices(words).to_numpy()
    key, tf = np.unique(key, return_counts=True)
    code, doc = key // n, key % n
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    n_docs = np.diff(np.append(starts, len(code)))
    n_terms = len(starts)
    if n_terms:
        max_tf, min_dl = np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl[doc], starts)
        # the shortest of the chunks with the most occurrences: a score that some chunk reaches
        top_dl = np.minimum.reduceat(np.where(tf == np.repeat(max_tf, n_docs), dl[doc], np.iinfo(np.int64).max), starts)
    else:
        max_tf = min_dl = top_dl = np.zeros(0, np.int64)

    def numbers(head: int, rest: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(np.append(head, rest), kind)

    def lists(values: np.ndarray) -> pa.Array:
        ends = np.append(0, np.append(starts, len(code))).astype(np.int32)  # the header's list is empty
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))

    def headed(values: pa.Array, kind: pa.DataType) -> pa.Array:
        ends = np.append(0, np.full(n_terms + 1, n)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values).cast(kind)

    terms = pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.take(pa.array(code[starts])).cast(pa.string())])
    n_known = n - words.null_count  # in a header min_dl counts the chunks that have a text
    columns = [
        pa.array(np.full(n_terms + 1, block), pa.int64()), terms, numbers(n, n_docs, pa.int32()), numbers(0, max_tf, pa.int32()),
        numbers(n_known, min_dl, pa.int32()), numbers(0, max_tf, pa.int32()), numbers(0, top_dl, pa.int32()),
        numbers(int(dl.sum()), np.zeros(n_terms, np.int64), pa.int64()),
        headed(part.column("chunk_id"), schema.field("ids").type), headed(pa.array(dl, pa.int32()), schema.field("dl").type),
        lists(doc).cast(schema.field("docs").type), lists(tf).cast(schema.field("tf").type),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class LexicalIndex:
    """Postings under ``path``: ``batch=N/shard=S``, each batch appended once and counted when it is complete.

    Chunks without a text count as chunks, not in the mean length. Texts of any length, no chunks and no queries
    are fine. A chunk that is appended twice is two chunks; ``append`` of the same batch number replaces that batch.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 16, block_chunks: int = 1024):
        self.spark, self.path, self.shards, self.block_chunks = spark, path.rstrip("/"), shards, block_chunks

    def _shard(self, term: Column) -> Column:
        return F.when(term.isNull(), HEADERS).otherwise(F.pmod(F.xxhash64(term), F.lit(self.shards)).cast("int"))

    def append(self, chunks: DataFrame, batch: int = 0) -> LexicalIndex:
        """Tokenise chunks (chunk_id, text) and write their blocks; one pass, no exchange."""
        from pyspark.sql.pandas.types import to_arrow_schema

        size, schema = self.block_chunks, _schema(chunks.schema["chunk_id"].dataType)
        arrow = to_arrow_schema(schema)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a repeated task numbers its blocks alike
            number = (batch << 48) + (TaskContext.get().partitionId() << 24)
            for rows in batches:
                for at in range(0, rows.num_rows, size):
                    yield _block(number, rows.slice(at, size), arrow)
                    number += 1

        worded = chunks.select("chunk_id", tokens(F.lower("text")).alias("w"))
        # a header of no chunks, so that a batch without rows can be read as well
        empty = self.spark.createDataFrame([(-1, None, 0, 0, 0, 0, 0, 0, [], [], [], [])], schema)
        filed = worded.mapInArrow(blocks, schema).unionByName(empty).withColumn("shard", self._shard(F.col("term")))
        filed.sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/{BATCH}={batch}")
        return self

    def _read(self) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(path(f"{self.path}/{BATCH}=*/_SUCCESS")) or []
        folders = [f.getPath().getParent().toString() for f in done]
        if not folders:
            raise ValueError(f"no complete batch under {self.path}")
        return self.spark.read.option("basePath", self.path).parquet(*sorted(folders))

    def topk(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best chunks that share a word with the query; ties to the smaller id.

        Query words go to every task in slices of bounded size; all else stays distributed.
        """
        from lexloom.operators import retrieval

        stored = self._read()
        asked = queries.select("query_id", F.array_distinct(tokens(F.lower("query_text"))).alias("terms")).where(F.size("terms") > 0)
        total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
        n_slices = max(1, -(-total * 32 // retrieval.BROADCAST_QUERY_BYTES))
        q_type, c_type = queries.schema["query_id"].dataType, stored.schema["ids"].dataType.elementType
        schema = T.StructType(
            [T.StructField("query_id", q_type), T.StructField("chunk_id", c_type), T.StructField("score", T.DoubleType())]
        )
        n, known, words = stored.where(F.col("shard") == HEADERS).agg(F.sum("n_docs"), F.sum("min_dl"), F.sum("words")).first()
        hits = self.spark.createDataFrame([], schema)
        for i in range(n_slices if words else 0):
            part = asked if n_slices == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_slices)) == i)
            hits = hits.unionByName(self._hits(part.toArrow(), stored, k, (n, words / known, k1, b), schema))
        return retrieval._top_k(hits, ["query_id"], "chunk_id", k)

    def opened(self, table: pa.Table, stored: DataFrame, k: int, corpus: tuple) -> tuple[DataFrame, dict[str, float]]:
        """(block, q, floor) of the blocks that may hold one of the k best chunks of query number q, and the words' weights."""
        n, mean, k1, b = corpus
        terms = pc.list_flatten(table.column("terms").combine_chunks())
        q = pc.list_parent_indices(table.column("terms").combine_chunks())
        pairs = self.spark.createDataFrame(pa.table({"q": q.cast(pa.int32()), "term": terms}))
        shards = pairs.select(self._shard(F.col("term")).alias("s")).distinct().toArrow().column("s").to_pylist()
        maxima = stored.where(F.col("shard").isin(shards)).select("shard", "block", "term", "n_docs", "max_tf", "min_dl", "top_tf", "top_dl")
        held = maxima.join(F.broadcast(pairs.select("term").distinct()), "term", "left_semi")
        # one row per word of this slice, which is bounded
        counts = held.groupBy("term").agg(F.sum("n_docs").alias("df")).toArrow()
        df = counts.column("df").to_numpy()
        idf = dict(zip(counts.column("term").to_pylist(), np.log(1 + (n - df + 0.5) / (df + 0.5)).tolist()))
        weighed = pa.table({"q": q.cast(pa.int32()), "term": terms, "idf": pa.array([idf.get(t) for t in terms.to_pylist()], pa.float64())})
        weighed = self.spark.createDataFrame(weighed).where("idf is not null")

        def weight(tf: str, dl: str) -> Column:
            return F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.lit(mean)))

        bounds = maxima.join(F.broadcast(weighed), "term").groupBy("q", "block").agg(
            F.sum(weight("max_tf", "min_dl")).alias("most"), F.max(weight("top_tf", "top_dl")).alias("least")
        )
        w = Window.partitionBy("q").orderBy(F.col("least").desc())
        best = bounds.select("q", "least", F.row_number().over(w).alias("i")).where(F.col("i") <= k)
        floors = best.where(F.col("i") == k).select("q", F.col("least").alias("floor"))
        opened = bounds.join(F.broadcast(floors), "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
        return opened.where(F.col("most") >= F.col("floor")).select("block", "q", "floor"), idf

    def _hits(self, table: pa.Table, stored: DataFrame, k: int, corpus: tuple, schema: T.StructType) -> DataFrame:
        opened, idf = self.opened(table, stored, k, corpus)
        per_block = opened.groupBy("block").agg(F.collect_list(F.struct("q", "floor")).alias("qs"))
        names = F.broadcast(self.spark.createDataFrame(pa.table({"term": pa.array(list(idf), pa.string())})))
        shards = [HEADERS, *range(self.shards)]
        rows = stored.where(F.col("shard").isin(shards))
        postings = rows.where("term is not null").join(names, "term", "left_semi").unionByName(rows.where("term is null"))
        asked: dict[str, list[int]] = {}
        for q, terms in enumerate(table.column("terms").to_pylist()):
            for t in terms:
                asked.setdefault(t, []).append(q)
        shared = self.spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), {t: np.array(q) for t, q in asked.items()}, idf))
        _, mean, k1, b = corpus

        def score(block: pa.Table) -> pa.Table:
            ids, asked, idf = shared.value
            block = block.combine_chunks()
            terms, lists = block.column("term").to_pylist(), {c: block.column(c).chunk(0) for c in ("ids", "dl", "docs", "tf", "qs")}
            heads = np.flatnonzero(lists["ids"].is_valid().to_numpy(False) & block.column("term").chunk(0).is_null().to_numpy(False))
            names, dl = lists["ids"][heads[0]].values, lists["dl"][heads[0]].values.to_numpy()
            opened = lists["qs"].drop_null().flatten()
            if not len(opened):  # nothing to find here
                return pa.table({"query_id": ids[:0], "chunk_id": names[:0], "score": pa.array([], pa.float64())})
            q, floor = opened.field("q").to_numpy(), opened.field("floor").to_numpy()
            place = np.full(len(ids), -1)
            place[q] = np.arange(len(q))
            docs, tf, at = lists["docs"].values.to_numpy(), lists["tf"].values.to_numpy(), lists["docs"].offsets.to_numpy()
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[docs] / mean))
            total = np.zeros((len(q), len(names)))
            for term, i in sorted((t, i) for i, t in enumerate(terms) if t is not None):
                rows = place[asked[term]]
                rows, held = rows[rows >= 0], slice(at[i], at[i + 1])
                total[rows[:, None], docs[held]] += idf[term] * gain[held]
            r, c = np.nonzero((total > 0) & (total >= floor[:, None]))
            return pa.table({"query_id": ids.take(pa.array(q[r])), "chunk_id": names.take(pa.array(c)), "score": np.round(total[r, c], 6)})

        told = postings.select("block", "term", "ids", "dl", "docs", "tf").unionByName(per_block, allowMissingColumns=True)
        return told.groupBy("block").applyInArrow(score, schema)
