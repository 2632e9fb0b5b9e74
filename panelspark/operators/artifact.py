"""A frozen linear model as tables under their digest: terms, the distribution of the scores it is judged by, and a head.

The text of every number has ten significant digits and the stored numbers are that text's. With a fit from exact sums
(``fit_ridge(exact=True)``) a repeated fit gives the same digest, in whatever order its sums run. ``read_artifact`` works the digest out anew and checks what it reads.

Defined cases: scores that are null or not finite are no part of the reference; a row with a null feature has a null score, percentile and band."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.fitted import exact_sums
from panelspark.operators.stats import ecdf_band
from panelspark.operators.validate import finite

CHECKS = ("no features", "a position is missing or doubled", "a feature is named twice", "a number is not finite",
          "a scale is not positive", "no reference scores", "a reference score or count is unfit", "the digest differs")


def told(value: Column) -> Column:
    return F.format_string("%.9e", value.cast("double"))


def model_terms(train: DataFrame, columns: list[str], model: DataFrame) -> DataFrame:
    """One row per column of a ridge's one row ``intercept, coefficients``: the mean and deviation of the training rows, and
    the coefficient of the standardised column. The table has as many rows as the model has columns."""
    p = len(columns)
    squares = [(0, i) for i in range(p + 1)] + [(i, i) for i in range(1, p + 1)]
    sums = exact_sums(train, [F.lit(1.0), *(F.col(c) for c in columns)], squares, [])
    mean = lambda at: F.col("sums")[at] / F.col("sums")[0]
    scale = lambda i: F.sqrt(F.greatest(mean(p + i) - mean(i) * mean(i), F.lit(0.0)))
    pairs = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), mean(i + 1).alias("mean"), scale(i + 1).alias("scale"))
                      for i, c in enumerate(columns)))
    rows = sums.select(pairs.alias("t")).crossJoin(model.select("coefficients")).select(F.explode("t").alias("t"), "coefficients")
    raw = F.get("coefficients", F.col("t.position"))
    out = rows.select("t.*", (raw * F.col("t.scale")).alias("coefficient"))
    return out.select("position", "name", *(told(F.col(c)).cast("double").alias(c) for c in ("mean", "scale", "coefficient")))


def model_head(terms: DataFrame, model: DataFrame) -> DataFrame:
    """``alpha, intercept``: the forecast where every column is at its mean."""
    shift = terms.agg(F.coalesce(F.sum(F.col("coefficient") * F.col("mean") / F.col("scale")), F.lit(0.0)).alias("_s"))
    rows = model.select("alpha", "intercept").crossJoin(shift)
    return rows.select("alpha", told(F.col("intercept") + F.col("_s")).cast("double").alias("intercept"))


def reference_of(scores: DataFrame, score: str) -> DataFrame:
    """Distinct scores with their counts; scores are rounded to nine decimals, as they are when a row is scored."""
    return scores.where(finite(F.col(score))).groupBy(F.round(score, 9).alias("score")).agg(F.count("*").alias("rows"))


def digest_of(terms: DataFrame, head: DataFrame, reference: DataFrame) -> str:
    """Terms in their order, head, and sums of the hashes of the reference's rows (rounded scores, so six decimals)."""
    line = F.concat_ws("|", F.col("position").cast("string"), "name", *(told(F.col(c)) for c in ("mean", "scale", "coefficient")))
    lines = F.array_join(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))).getField("l"), "\n")
    cells = reference.groupBy(F.format_string("%.6f", F.col("score")).alias("v")).agg(F.sum("rows").alias("c"))
    h = F.md5(F.concat_ws("|", "v", F.col("c").cast("string")))
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 16)]
    rows = terms.agg(lines.alias("t")).crossJoin(head.select(F.concat_ws("|", told(F.col("alpha")), told(F.col("intercept"))).alias("h")))
    rows = rows.crossJoin(cells.agg(F.concat_ws("|", F.coalesce(F.sum("c"), F.lit(0)).cast("string"), *parts).alias("r")))
    return rows.select(F.sha2(F.concat_ws("\n", "h", "t", "r"), 256)).first()[0]


def parts(spark: SparkSession, place: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{place}/{part}") for part in ("terms", "head", "reference")]


def freeze(terms: DataFrame, head: DataFrame, reference: DataFrame, path: str) -> str:
    """Writes the artifact below its digest, the head last, and returns the digest. An artifact that is there stays as it is."""
    spark, digest = terms.sparkSession, digest_of(terms, head, reference)
    place = f"{path}/{digest}"
    try:
        spark.read.parquet(f"{place}/head")
    except AnalysisException:
        terms.coalesce(1).write.mode("overwrite").parquet(f"{place}/terms")
        reference.write.mode("overwrite").parquet(f"{place}/reference")
        head.coalesce(1).write.mode("overwrite").parquet(f"{place}/head")
    return digest


def faults(terms: DataFrame, head: DataFrame, reference: DataFrame, digest: str) -> list[str]:
    good = reduce(lambda a, b: a & b, (finite(F.col(c)) for c in ("mean", "scale", "coefficient")))
    t = terms.agg(F.count("*").alias("n"), F.count_distinct("position").alias("p"), F.min("position").alias("lo"), F.max("position").alias("hi"),
                  F.count_distinct("name").alias("names"), F.count_if(~good).alias("bad"), F.count_if(~(F.col("scale") > 0) | F.col("scale").isNull()).alias("flat")).first()
    h = head.agg(F.count("*").alias("n"), F.count_if(finite(F.col("intercept")) & finite(F.col("alpha"))).alias("good")).first()
    fit = finite(F.col("score")) & (F.col("rows") > 0)
    r = reference.agg(F.count("*").alias("n"), F.count_if(fit).alias("good"), F.count_distinct("score").alias("scores")).first()
    seen = (t["n"] == 0, t["n"] > 0 and (t["p"], t["lo"], t["hi"]) != (t["n"], 0, t["n"] - 1), t["names"] != t["n"], t["bad"] > 0 or (h["n"], h["good"]) != (1, 1),
            t["flat"] > 0, r["n"] == 0, (r["good"], r["scores"]) != (r["n"], r["n"]))
    found = [what for what, hit in zip(CHECKS, seen) if hit]
    return found or ([] if digest_of(terms, head, reference) == digest else [CHECKS[-1]])


def read_artifact(spark: SparkSession, path: str, digest: str) -> Row:
    """``digest, alpha, intercept, terms`` in the order of the features, and the reference as a table. An artifact that
    fails a check is an error."""
    terms, head, reference = parts(spark, f"{path}/{digest}")
    wrong = faults(terms, head, reference, digest)
    if wrong:
        raise ValueError(f"artifact {digest} is refused: {', '.join(wrong)}")
    h = head.first()
    return Row(digest=digest, alpha=h["alpha"], intercept=h["intercept"], terms=terms.orderBy("position").collect(), reference=reference)


def score_rows(df: DataFrame, artifact: Row) -> DataFrame:
    """Adds ``artifact_score``, its right-inclusive ``percentile`` among the reference scores, and its ``band``."""
    value = F.lit(artifact["intercept"])
    for t in artifact["terms"]:
        value = value + F.lit(t["coefficient"]) * ((F.col(t["name"]) - F.lit(t["mean"])) / F.lit(t["scale"]))
    score = F.when(value.isNotNull(), F.round(F.greatest(F.expm1(value), F.lit(0.0)), 9))
    rows = df.withColumn("artifact_score", score)
    placed = ecdf_band(rows.where("artifact_score IS NOT NULL"), "artifact_score", artifact["reference"].withColumnRenamed("score", "artifact_score"), "rows")
    blank = rows.where("artifact_score IS NULL").withColumns({"percentile": F.lit(None).cast("double"), "band": F.lit(None).cast("string")})
    return placed.unionByName(blank)
