"""Exactly-once collection with a commit log.

Every micro-batch writes its rows, its rejects and its manifest into folders of its own, named by run and batch number,
and a commit record last. Readers take committed batches only, so a batch that was cut off is invisible and is simply
overwritten when it is replayed. A run whose record says that it ended is not run again. Layout below ``path``::

    data, quarantine, manifests, commits    each with run=<run>/batch=<number>
    runs/run=<run>                          how the run ended: COMPLETE, PARTIAL (with rejects) or FAILED
    state/<run>                             the query's own checkpoint

Defined cases: rows with a reason are rejects and enter no table; rows of a batch with equal keys are one; a key that an
earlier commit holds is known and is not stored again; null keys are equal to each other; a batch without rows is committed too."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

PLACE = StructType().add("run", StringType()).add("batch", LongType())
COUNTS = StructType().add("n_in", LongType()).add("n_fresh", LongType()).add("n_rejected", LongType())
ENDING = StructType().add("status", StringType()).add("note", StringType())
NOBODY = "none"  # the run of the empty placeholder that gives each folder a schema


def wider(schema: StructType, more: StructType = PLACE) -> StructType:
    return StructType([*schema.fields, *more.fields])


def manifest_of(rows: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """Per ``by``: rows, first and last time, and sums of two parts of the keys' hashes. All of them add up over batches."""
    h = F.md5(F.col(key).cast("string"))
    parts = [F.sum(F.conv(F.substring(h, start, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for start in (1, 16)]
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), parts[0].alias("low"), parts[1].alias("high"))


def rolled_up(manifests: DataFrame, by: str) -> DataFrame:
    """Manifests of batches as one: the digest is that of ``sinks.ids_digest`` over all their rows."""
    text = F.concat_ws("|", *(F.sum(c).cast("string") for c in ("n", "low", "high")))
    return manifests.groupBy(by).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(text, 256).alias("digest"))


def prepare(spark: SparkSession, path: str, folder: str, schema: StructType) -> None:
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{folder}/run={NOBODY}/batch=-1")


def committed(spark: SparkSession, path: str, folder: str, schema: StructType) -> DataFrame:
    """The rows of ``folder`` whose batch has a commit record, with ``run`` and ``batch``; Spark prunes the other folders."""
    done = spark.read.schema(wider(COUNTS)).parquet(f"{path}/commits").where(F.col("run") != NOBODY).select("run", "batch")
    return spark.read.schema(wider(schema)).parquet(f"{path}/{folder}").join(done, ["run", "batch"], "left_semi")


def commit(spark: SparkSession, path: str, run: str, batch: int, counts: dict[str, int]) -> None:
    """One row in one file: the batch counts from the moment that this file is there."""
    row = spark.range(1, numPartitions=1).select(*(F.lit(counts[c]).cast("long").alias(c) for c in COUNTS.names))
    row.write.mode("overwrite").parquet(f"{path}/commits/run={run}/batch={batch}")


def ending(spark: SparkSession, path: str, run: str, status: str, note: str | None = None) -> None:
    row = spark.range(1, numPartitions=1).select(F.lit(status).alias("status"), F.lit(note).cast("string").alias("note"))
    row.write.mode("overwrite").parquet(f"{path}/runs/run={run}")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """``run, status, note`` and the sums of the run's committed batches."""
    told = spark.read.schema(wider(ENDING, StructType([PLACE["run"]]))).parquet(f"{path}/runs").where(F.col("run") != NOBODY)
    commits = spark.read.schema(wider(COUNTS)).parquet(f"{path}/commits")
    sums = commits.groupBy("run").agg(F.count("*").alias("batches"), *(F.sum(c).alias(c) for c in COUNTS.names))
    return told.join(sums, "run", "left").fillna(0, ["batches", *COUNTS.names])


def collect(stream: DataFrame, path: str, run: str, keys: list[str], reason: Column | None = None, by: str = "event_type", at: str = "ts") -> DataFrame:
    """Runs the stream to its present end under the id ``run`` and returns all committed rows of all runs.

    ``reason`` is null for good rows and says of others why they go to the quarantine. An error ends the run as FAILED
    and is raised; the same id then goes on where the last commit left off. An ended run is left as it is.

    Known keys are found by a semi-join of the stored keys with the batch's, so the small side is broadcast if it is
    small and the stored rows are scanned for their keys, not shuffled."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run) or run == NOBODY:
        raise ValueError(f"no run id: {run!r}")
    spark, schema = stream.sparkSession, stream.schema
    rejects = StructType([*schema.fields]).add("reason", StringType())
    manifest = manifest_of(spark.createDataFrame([], schema), by, at, keys[0]).schema
    for folder, kind in (("data", schema), ("quarantine", rejects), ("manifests", manifest), ("commits", COUNTS)):
        prepare(spark, path, folder, kind)
    spark.createDataFrame([], ENDING).write.mode("ignore").parquet(f"{path}/runs/run={NOBODY}")
    ended = runs(spark, path).where((F.col("run") == run) & F.col("status").isin("COMPLETE", "PARTIAL"))
    if not ended.isEmpty():
        return committed(spark, path, "data", schema)
    told = F.lit(None).cast("string") if reason is None else reason
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{k}"]) for k in keys))

    def store(batch: DataFrame, number: int) -> None:
        place = f"run={run}/batch={number}"
        marked = batch.withColumn("reason", told)
        marked.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{path}/quarantine/{place}")
        good = marked.where("reason IS NULL").drop("reason").dropDuplicates(keys)
        stored = committed(batch.sparkSession, path, "data", schema).where(~((F.col("run") == run) & (F.col("batch") == number))).select(*keys)
        wanted = good.select(*(F.col(k).alias(f"_{k}") for k in keys))
        known = stored.join(wanted, same(stored, wanted), "left_semi").select(*(F.col(k).alias(f"_{k}") for k in keys))
        good.join(known, same(good, known), "left_anti").write.mode("overwrite").parquet(f"{path}/data/{place}")
        kept = batch.sparkSession.read.schema(schema).parquet(f"{path}/data/{place}")
        manifest_of(kept, by, at, keys[0]).write.mode("overwrite").parquet(f"{path}/manifests/{place}")
        rejected = batch.sparkSession.read.schema(rejects).parquet(f"{path}/quarantine/{place}").count()
        commit(batch.sparkSession, path, run, number, {"n_in": batch.count(), "n_fresh": kept.count(), "n_rejected": rejected})

    try:
        query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/state/{run}").trigger(availableNow=True).start()
        query.awaitTermination()
    except Exception as error:
        ending(spark, path, run, "FAILED", str(error))
        raise
    bad = spark.read.schema(wider(COUNTS)).parquet(f"{path}/commits").where((F.col("run") == run) & (F.col("n_rejected") > 0))
    ending(spark, path, run, "COMPLETE" if bad.isEmpty() else "PARTIAL")
    return committed(spark, path, "data", schema)


def quarantined(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return committed(spark, path, "quarantine", StructType([*schema.fields]).add("reason", StringType()))


def manifests(spark: SparkSession, path: str, schema: StructType, by: str = "event_type", at: str = "ts", key: str = "event_id") -> DataFrame:
    """One manifest of all committed batches, per ``by``."""
    kind = manifest_of(spark.createDataFrame([], schema), by, at, key).schema
    return rolled_up(committed(spark, path, "manifests", kind), by)
