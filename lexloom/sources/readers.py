"""Reading tables with enough parallelism for the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread: bool = True) -> DataFrame:
    """Parquet table. A scan with fewer splits than cores is redistributed once.

    A text table of one row group would otherwise run every regex on one core.
    Large tables have more splits than cores and are read as they are, without a
    shuffle.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
