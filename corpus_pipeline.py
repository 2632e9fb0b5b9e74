"""The corpus pipeline: documents in, the mixture of good, unique and clean documents out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` writes each stage's rows as
Parquet in the shared folder and reads them back for the next one, so a lost executor costs one stage at most. A null
or empty text fails the quality rules; empty tables pass through all stages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.decontaminate import decontaminate
from panelspark.llm.jaccard import keep_one
from panelspark.llm.linededup import dedup_lines
from panelspark.llm.mixing import mix_sources
from panelspark.llm.quality import keep_good
from panelspark.llm.store import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in one of them; ``n_chars`` follows the text."""
    kept = dedup_lines(docs, min_chars=20, min_docs=3)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle Jaccard of 0.8 or more stays."""
    return keep_one(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words inside 13-word benchmark windows go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=13, per_mille=50)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of sources: sort by (slot, bucket, rank)."""
    mixed = mix_sources(docs, block=65_536)
    return mixed.select(*docs.columns, "block", "release", "deadline", "slot", "place.bucket", "place.rank")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]
ORACLE_SQL = None  # neither the covariance estimate nor the earliest-deadline order can be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{number}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
