"""Sinks: versioned, partitioned and replaceable tables as Parquet or JSON in any store that Spark writes to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_versions(df: DataFrame, path: str, key: str, content: str) -> tuple[int, int]:
    """Appends unseen versions and returns (inserted, duplicates); other bytes under a stored key are an error."""
    spark = df.sparkSession
    df.limit(0).write.mode("append").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    known = stored.select(F.col(key).alias("_k"), F.sha2(F.col(content).cast("string"), 256).alias("_h"))
    own = F.sha2(F.col(content).cast("string"), 256)
    clash = df.join(known, (F.col(key) == F.col("_k")) & (own != F.col("_h")))
    if not clash.isEmpty():
        raise ValueError("a stored version has other content")
    fresh = df.dropDuplicates([key]).join(known, F.col(key) == F.col("_k"), "left_anti")
    total, before = df.count(), stored.count()
    fresh.write.mode("append").parquet(path)
    inserted = spark.read.schema(df.schema).parquet(path).count() - before
    return inserted, total - inserted


def write_archive(df: DataFrame, path: str, by: tuple[str, ...] = ("source", "date", "run")) -> DataFrame:
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def export_splits(df: DataFrame, path: str) -> DataFrame:
    """JSON lines by split; returns rows, first and last day and a digest per split."""
    df.write.partitionBy("split").json(path)
    schema = df.schema
    back = df.sparkSession.read.schema(schema).json(path)
    return back.groupBy("split").agg(
        F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), ids_digest(F.col("id")).alias("digest")
    )


def ids_digest(key: Column) -> Column:
    """An aggregate that tells sets of keys apart whatever their order: a count and the sums of two 60-bit parts of the
    keys' hashes, hashed. It keeps three numbers per group."""
    h = F.md5(key.cast("string"))
    sums = [F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16)]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256)


def replace_partition(df: DataFrame, path: str, by: str) -> DataFrame:
    """Replaces the partitions that ``df`` has rows for, and no others."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)
