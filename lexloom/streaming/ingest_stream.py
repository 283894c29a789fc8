"""Incremental ingestion of text files into the chunk store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions.text import uuid5
from lexloom.plans.ingest import ingest_texts
from lexloom.session import checkpointed
from lexloom.sources.store import BATCH, ChunkStore, unique_ids


def latest_points(spark: SparkSession, store: str) -> DataFrame | None:
    """The store as of now: the newest version of every point."""
    return ChunkStore(spark, store).read()


def plain_path(uri: Column) -> Column:
    """The path of a file URI, without scheme and host, decoded (a plus sign stays one)."""
    decoded = F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def source_name(path: Column, root: str) -> Column:
    """The path below the root, without extension: files of one name in two folders are two documents."""
    root = root.rstrip("/") + "/"
    below = F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def text_files(spark: SparkSession, source_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (doc_id, text, modified) of the files in a folder and below it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(source_dir).toUri().getPath()
    files = (
        spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True).load(source_dir)
    )
    return files.select(
        source_name(plain_path(F.col("_metadata.file_path")), root).alias("doc_id"), F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


class Ingestion:
    """What one micro-batch does; a batch that comes again has the same effect.

    A ledger of sources (``ledger/ingest_batch=N``) says which batch brought a source. A source of an earlier
    batch is skipped, or with ``replace`` gets a new version: all its old points go. The ledger
    and the index of the store are read, never the stored texts.
    """

    def __init__(self, spark: SparkSession, manifest: DataFrame, store: str, encoder: Callable | None = None, replace: bool = False):
        self.spark, self.manifest, self.path, self.encoder, self.replace = spark, manifest, store.rstrip("/"), encoder, replace
        self.store = ChunkStore(spark, store)

    def ledger(self) -> DataFrame | None:
        """(source_id, ingest_batch) of all batches that are through."""
        path, fs = self.store._files()
        found = fs.globStatus(path(f"{self.path}/ledger/{BATCH}=*/_SUCCESS")) or []
        folders = [f.getPath().getParent().toString() for f in found]
        if not folders:
            return None
        rows = self.spark.read.schema(f"source_id string, {BATCH} long").option("basePath", f"{self.path}/ledger").parquet(*folders)
        return rows.select("source_id", BATCH)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # which version of a source counts is decided on ids and times; texts follow by a join
        times = batch.select("doc_id", "modified")
        last = times.groupBy("doc_id").agg(F.max("modified").alias("modified"))
        ledger = self.ledger()
        if ledger is not None and not self.replace:
            seen = ledger.where(F.col(BATCH) != batch_id).select(F.col("source_id").alias("doc_id"))
            last = last.join(seen, "doc_id", "left_anti")
        # and meet them by doc_id alone (no time is later than the last one), as they then meet the manifest: one exchange
        newest = last.select(F.col("doc_id").alias("__id"), F.col("modified").alias("__last"))
        docs = batch.join(newest, (F.col("doc_id") == F.col("__id")) & (F.col("modified") >= F.col("__last")), "left_semi")
        chunks = ingest_texts(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), self.manifest, encoder=self.encoder)
        # A source's name and a window's number make an id of their own, unless the manifest lists a source twice.
        listed = self.manifest.where("source_id IS NOT NULL").groupBy("source_id").agg(F.count("*").alias("n"))
        if listed.where("n > 1").isEmpty():
            chunks = chunks.withColumn("point_id", uuid5(F.col("chunk_id")))
        else:
            chunks = unique_ids(checkpointed(chunks))
        if self.replace and self.store.committed():
            chunks = checkpointed(chunks)
            mine = last.select(F.col("doc_id").alias("source_id"))
            old = self.store.index().where(F.col(BATCH) != 2 * batch_id).join(mine, "source_id", "left_semi")
            gone = old.select("point_id", "source_id").distinct().join(chunks.select("point_id"), "point_id", "left_anti").withColumn("removed", F.lit(True))
            chunks = chunks.withColumn("removed", F.lit(False)).unionByName(gone, allowMissingColumns=True)
        self.store.append(chunks, batch_id)
        last.select(F.col("doc_id").alias("source_id")).write.mode("overwrite").parquet(f"{self.path}/ledger/{BATCH}={batch_id}")

    def chunks(self) -> DataFrame | None:
        """The store as of now, without points of replaced versions."""
        rows = self.store.read()
        return rows.where("NOT coalesce(removed, false)").drop("removed") if rows is not None and "removed" in rows.columns else rows


def ingest_stream(
    spark: SparkSession, source_dir: str | DataFrame, manifest: DataFrame, store: str, checkpoint: str,
    encoder: Callable | None = None, files_per_batch: int = 1000, replace: bool = False,
) -> StreamingQuery:
    """New text files → chunks → store. ``source_dir`` may be a stream of (doc_id, text, modified)."""
    files = text_files(spark, source_dir, files_per_batch) if isinstance(source_dir, str) else source_dir
    load = Ingestion(spark, manifest, store, encoder, replace)
    return files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
