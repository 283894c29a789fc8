"""The chunk store: append-only batches of keyed rows in place of a vector collection.

``ChunkStore`` writes a batch as two folders: the rows, then a narrow index (point, source, collection) whose
completion makes the batch count. An ingest writes its own rows only; of several versions of a point the
one of the latest batch is read. A batch that is repeated after a failure overwrites itself, one that never
got its index is not read, and compaction removes nothing before what replaces it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import uuid5
from lexloom.session import checkpointed

BATCH = "ingest_batch"
FEW_REPEATS = 100_000  # repeated ids up to which their join leaves the chunks in place


def unique_ids(chunks: DataFrame, position: str = "position") -> DataFrame:
    """Make chunk ids unique (``_dup{position}`` for repeats) and add point_id.

    The first position per id is a map-side-combined minimum. Only ids that repeat are
    joined, none if there are none; beyond ``FEW_REPEATS`` of them by chunk_id, which
    adaptive execution splits when copies of one id dominate.
    Rows that share id and position are told apart by a further ``_{n}``, counted in
    the order of their contents; only such rows are ranked.
    """
    first = chunks.groupBy("chunk_id").agg(F.min(position).alias("__first"), F.count("*").alias("__n"))
    repeated = checkpointed(first.where("__n > 1").select("chunk_id", "__first"))
    if repeated.isEmpty():
        return chunks.withColumn("point_id", uuid5(F.col("chunk_id")))
    among = chunks.select("chunk_id", position).join(repeated, "chunk_id", "left_semi")
    pairs = among.groupBy("chunk_id", position).agg(F.count("*").alias("__m")).where("__m > 1").drop("__m")
    if not pairs.isEmpty():
        plain = [f.name for f in chunks.schema.fields if not isinstance(f.dataType, T.MapType)]
        w = Window.partitionBy("chunk_id", position).orderBy(F.xxhash64(*plain))
        same = chunks.join(pairs, ["chunk_id", position], "left_semi").withColumn("__k", F.row_number().over(w) - 1)
        tail = F.when(F.col("__k") > 0, F.concat(F.lit("_"), F.col("__k").cast("string"))).otherwise("")
        again = unique_ids(same.where("__k = 0").drop("__k").unionByName(chunks.join(pairs, ["chunk_id", position], "left_anti")), position)
        more = same.where("__k > 0").withColumn("chunk_id", F.concat("chunk_id", F.lit("_dup"), F.col(position).cast("string"), tail))
        return again.unionByName(more.drop("__k").withColumn("point_id", uuid5(F.col("chunk_id"))))
    few = repeated.limit(FEW_REPEATS + 1).count() <= FEW_REPEATS
    out = chunks.join(F.broadcast(repeated) if few else repeated, "chunk_id", "left")
    again = F.col("__first").isNotNull() & (F.col(position) != F.col("__first"))
    cid = F.when(again, F.concat("chunk_id", F.lit("_dup"), F.col(position).cast("string"))).otherwise(F.col("chunk_id"))
    out = out.withColumn("chunk_id", cid).drop("__first")
    return out.withColumn("point_id", uuid5(F.col("chunk_id")))


def upsert(new: DataFrame, existing: DataFrame | None) -> DataFrame:
    """New rows replace stored rows with the same point_id."""
    if existing is None:
        return new
    kept = existing.join(new.select("point_id"), "point_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def write_chunks(chunks: DataFrame, existing: DataFrame | None = None, position: str = "position") -> DataFrame:
    """Unique ids, then upsert by point_id."""
    return upsert(unique_ids(chunks, position), existing)


class ChunkStore:
    """Chunks under ``path``: ``rows/ingest_batch=N`` and ``index/ingest_batch=N``.

    Batch n of a writer is stored under 2n; all batches up to n compacted are stored under 2n + 1, after them
    and before the next one.
    """

    KEYS = ("point_id", "source_id", "collection_name")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, part: str, number: int) -> str:
        return f"{self.path}/{part}/{BATCH}={number}"

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of the complete batches; a listing, no job."""
        path, fs = self._files()
        found = fs.globStatus(path(f"{self.path}/index/{BATCH}=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _read(self, part: str, numbers: list[int]) -> DataFrame | None:
        if not numbers:
            return None
        # every batch by its own path, so a folder that is being written is never listed; the columns are those of all batches
        return self.spark.read.option("basePath", f"{self.path}/{part}").option("mergeSchema", True).parquet(*[self._folder(part, n) for n in numbers])

    def _write(self, chunks: DataFrame, number: int) -> None:
        self._drop("index", number)  # the batch does not count until its rows are whole
        rows = chunks.drop(BATCH)
        rows.write.mode("overwrite").parquet(self._folder("rows", number))
        again = self.spark.read.schema(rows.schema).parquet(self._folder("rows", number))
        again.select(*[c for c in self.KEYS if c in rows.columns]).write.mode("overwrite").parquet(self._folder("index", number))

    def _drop(self, part: str, number: int) -> None:
        path, fs = self._files()
        fs.delete(path(self._folder(part, number)), True)

    def append(self, chunks: DataFrame, batch: int) -> None:
        """Write one batch (point_id, ...): new points and new versions of points. Repeating it replaces it."""
        self._write(chunks, 2 * batch)

    def index(self) -> DataFrame | None:
        """Every stored version: the key columns and the batch."""
        return self._read("index", self.committed())

    def newest(self) -> DataFrame | None:
        """(point_id, ingest_batch) of the version that counts, from the index alone."""
        index = self.index()
        return None if index is None else index.groupBy("point_id").agg(F.max(BATCH).alias(BATCH))

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The chunks as they are now. Rows are filtered by the few versions that a later batch replaced; texts are not grouped."""
        numbers = [n for n in self.committed() if upto is None or n <= upto]
        rows = self._read("rows", numbers)
        if rows is None or len(numbers) == 1:
            return rows
        index = self._read("index", numbers).select("point_id", BATCH)
        versions = index.groupBy("point_id").agg(F.max(BATCH).alias("last"), F.count("*").alias("n")).where("n > 1")
        old = index.join(versions.select("point_id", "last"), "point_id").where(F.col(BATCH) < F.col("last")).select("point_id", BATCH)
        return rows.join(old, ["point_id", BATCH], "left_anti")

    def compact(self) -> None:
        """Make one batch of all. The old ones go when the new one is complete; a crash before that leaves them as they were."""
        numbers = self.committed()
        if len(numbers) < 2:
            return
        target = numbers[-1] | 1
        if target == numbers[-1]:
            return
        self._write(self.read(target), target)
        for part in ("index", "rows"):
            for n in numbers:
                self._drop(part, n)


def collection_dims(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection_name").agg(
        F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"),
        F.count("*").alias("n_points"),
    )


def check_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """Per collection: keep it, or recreate it because its vector size differs."""
    same = (F.col("min_dim") == dim) & (F.col("max_dim") == dim)
    return collection_dims(chunks).withColumn("action", F.when(same, "keep").otherwise("recreate"))


def pending_docs(manifest: DataFrame, chunks: DataFrame, dim: int, force: bool = False) -> DataFrame:
    """Documents still to be ingested.

    Only id columns of the store are read. A collection with another vector size
    does not count as ingested.
    """
    if force:
        return manifest
    good = check_dimension(chunks, dim).where("action = 'keep'").select("collection_name")
    present = chunks.select("collection_name", "source_id").distinct().join(good, "collection_name", "left_semi")
    return manifest.where(~F.col("is_ingested")).join(present, ["collection_name", "source_id"], "left_anti")
