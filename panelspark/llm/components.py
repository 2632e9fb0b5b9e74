"""Connected components of an edge table by alternating large-star and small-star steps, each step a written table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.store import materialise


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id with an edge to another one; the component is its smallest id.

    Hub ids are no bottleneck: minima are aggregated before the shuffle, and the joins are plain equi-joins that
    adaptive execution splits."""
    cur = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct()
    cur = materialise(cur, "edges")
    seen = _mark(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = materialise(large.where("v <> u").distinct(), "largestar")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        cur = materialise(small.unionByName(low.withColumnRenamed("m", "u")).distinct(), "smallstar")
        now = _mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(
        cur.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    )
