"""Stored situating contexts: what a generator wrote once is not asked for again.

A look-up writes down the prompts of the distinct keys that are missing, dealt into parts by their hash; the contexts
of one part are generated and stored before the next part begins. Without a generator nothing is asked for, so there
are no prompts and one part. A part counts when it is complete, so a run that is
killed loses the part it was in, and the next one asks only for what is still missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import filled, strip
from lexloom.operators.chunking import context_key, context_prompt
from lexloom.session import checkpointed

CONTEXT = "key string, context string"


class ContextStore:
    """Contexts (key, context) under ``path/contexts``, one folder per completed part of a run.

    Two runs at the same time may store a key twice; the smallest context is then read, by all alike. Only what the
    generator wrote, or the structural sentence where it gave nothing, is stored. A chunk without parent or text has
    no key and always gets its structural sentence.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 16):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """One context per key of all complete parts."""
        path, fs = self._fs()
        done = fs.globStatus(path(f"{self.path}/contexts/*/_SUCCESS")) or []
        folders = sorted(f.getPath().getParent().toString() for f in done)
        if not folders:
            return self.spark.createDataFrame([], CONTEXT)
        return self.spark.read.schema(CONTEXT).parquet(*folders).groupBy("key").agg(F.min("context").alias("context"))

    def add(self, contexts: DataFrame) -> int:
        """Store contexts made elsewhere, for example an earlier cache table; the number of rows. No rows leave no folder."""
        folder = f"{self.path}/contexts/{uuid.uuid4().hex}"
        contexts.select("key", "context").write.parquet(folder)
        n = self.spark.read.schema(CONTEXT).parquet(folder).count()
        if n == 0:
            path, fs = self._fs()
            fs.delete(path(folder), True)
        return n

    def fill(self, chunks: DataFrame, generator: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Generate and store what is missing for chunks (parent_context, split_text, fallback_context); the number of new keys."""
        keyed = chunks.withColumn("key", context_key(F.col("parent_context"), F.col("split_text"))).where("key is not null")
        # What is missing is found on keys; without a generator its sentences are all that is needed.
        known = self.read().select("key")
        if generator is None:
            missing = keyed.select("key", "fallback_context").join(known, "key", "left_anti")
            return self.add(missing.groupBy("key").agg(F.min("fallback_context").alias("context")))
        keys = checkpointed(keyed.select("key").distinct().join(known, "key", "left_anti"))
        if keys.isEmpty():
            return 0
        # Only texts that need a context are made into prompts and exchanged.
        wanted = context_prompt(keyed.join(keys, "key", "left_semi")).groupBy("key").agg(
            F.min("prompt").alias("prompt"), F.min("fallback_context").alias("fallback_context")
        )
        part = F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")
        todo = f"{self.path}/todo/{uuid.uuid4().hex}"
        wanted.withColumn("part", part).write.partitionBy("part").parquet(todo)
        path, fs = self._fs()
        total = 0
        for folder in sorted(f.getPath().toString() for f in fs.globStatus(path(f"{todo}/part=*")) or []):
            rows = self.spark.read.schema("key string, prompt string, fallback_context string").parquet(folder)
            made = generator(rows.select("key", "prompt")).groupBy("key").agg(F.min("context").alias("made"))
            total += self.add(rows.join(made, "key", "left").select("key", filled(strip(F.col("made")), F.col("fallback_context")).alias("context")))
        fs.delete(path(todo), True)
        return total

    def lookup(self, chunks: DataFrame, generator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Chunks with ``generated_context``; what is not stored yet is generated and stored first."""
        self.fill(chunks, generator)
        known = self.read().select(F.col("key").alias("__key"), F.col("context").alias("generated_context"))
        keyed = chunks.drop("generated_context").withColumn("__key", context_key(F.col("parent_context"), F.col("split_text")))
        found = keyed.join(known, "__key", "left").drop("__key")
        return found.withColumn("generated_context", F.coalesce("generated_context", "fallback_context"))
