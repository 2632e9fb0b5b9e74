"""Does text tell more about reactions than what is known without it? Ridge on three nested sets of columns.

``market_only`` has the market's numbers, ``metadata_only`` also the events' numbers and one-hot categories, ``text``
also an embedding. Each evaluation period is predicted from all periods before it, for the signed target and for its
size. All sets, targets and folds are solved from one Gram matrix per period, so the rows are multiplied once; a category
value that the training periods lack has a constant column there and adds nothing."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import grams, stats

SETS = ["market_only", "metadata_only", "text"]
SIGNED, SIZE = "signed", "size"
MOST_LEVELS = 4096


@dataclass(frozen=True)
class Columns:
    market: list[str]
    numbers: list[str]
    categories: list[str]
    embedding: str
    keys: list[str]


def coded(rows: DataFrame, category: str) -> tuple[DataFrame, int]:
    """``rows`` with ``_code_<category>``: the place of the value among all values, and how many there are."""
    values = rows.select(F.col(category).alias("v")).where("v IS NOT NULL").distinct()
    n = values.limit(MOST_LEVELS + 1).count()
    if n > MOST_LEVELS:
        raise ValueError(f"{category} has more than {MOST_LEVELS} values: too many for one-hot columns")
    levels = values.agg(F.array_sort(F.collect_set("v")).alias("_levels"))
    with_levels = rows.crossJoin(F.broadcast(levels))
    return with_levels.withColumn(f"_code_{category}", (F.array_position("_levels", F.col(category)) - 1).cast("int")).drop("_levels"), n


def reaction_predictions(rows: DataFrame, columns: Columns, periods: list[int], alpha: float = 100.0) -> DataFrame:
    """A row per evaluation row, set and target: keys, ``period, features, target, y, prediction``. ``rows`` have
    ``period`` (a whole number that rises with time) and ``y``."""
    spark = rows.sparkSession
    codes = []
    for c in columns.categories:
        rows, n = coded(rows, c)
        codes.append((F.col(f"_code_{c}"), n))
    width = rows.where(F.col(columns.embedding).isNotNull()).select(F.size(columns.embedding).alias("n")).first()
    width = width["n"] if width else 0
    m, k, onehot = len(columns.market), len(columns.numbers), sum(n for _, n in codes)
    dense = [F.col(c) for c in [*columns.market, *columns.numbers, columns.embedding]]
    first = m + k + width  # one-hot columns follow the dense ones
    metadata = [*range(m + k), *range(first, first + onehot)]
    sets = {"market_only": list(range(m)), "metadata_only": metadata, "text": sorted([*metadata, *range(m + k, first)])}
    blocks = grams.gram_blocks(rows, dense, [F.col("y"), F.abs("y")], F.col("period"), codes)
    models = grams.ridge_sets(grams.prefix_grams(blocks, periods), [alpha], sets, [SIGNED, SIZE])
    x = F.concat(*(F.array(F.col(c).cast("double")) for c in [*columns.market, *columns.numbers]), F.col(columns.embedding).cast("array<double>"))
    return told(rows, x, first, codes, models, columns.keys)


def told(rows: DataFrame, x: Column, width: int, codes: list[tuple[Column, int]], models: DataFrame, keys: list[str]) -> DataFrame:
    """A row per row of a period with models and per model: keys, ``period, features, target, y, prediction``. The models (folds
    times sets times targets) go to the tasks, which multiply their batches by them; a row's sum has the same order in
    every batch. A row with a null number, or with another ``width`` of ``x``, has null predictions."""
    held: dict[int, list] = {}
    for m in models.orderBy("bound", "features", "target").collect():
        held.setdefault(m["bound"], []).append(m)
    names = [(m["features"], m["target"]) for m in next(iter(held.values()), [])]
    intercepts = {b: np.array([m["intercept"] for m in ms]) for b, ms in held.items()}
    coefficients = {b: np.array([m["coefficients"] for m in ms]) for b, ms in held.items()}
    levels = [n for _, n in codes]
    none = F.array_repeat(F.lit(None).cast("double"), width)
    asked = rows.where(F.col("period").isin(sorted(held))).select(
        *keys, "period", "y", F.when(F.size(x) == width, x).otherwise(none).alias("_x"),
        F.array(*(F.coalesce(c.cast("int"), F.lit(-1)) for c, _ in codes)).cast("array<int>").alias("_c"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            numbers, places = batch.column("_x").flatten(), batch.column("_c").flatten().to_numpy().reshape(len(batch), len(levels))
            v = numbers.to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), width)
            blank = numbers.is_null().to_numpy(zero_copy_only=False).reshape(len(batch), width).any(axis=1)
            periods = batch.column("period").to_numpy()
            out = np.empty((len(batch), len(names)))
            for k in np.unique(periods).tolist():
                own, c = periods == k, coefficients[k]
                total, at = np.einsum("np,mp->nm", v[own], np.ascontiguousarray(c[:, :width])), width
                for j, n in enumerate(levels):
                    total += np.pad(c[:, at : at + n], ((0, 0), (0, 1))).T[places[own, j]]  # code -1, no value, adds 0
                    at += n
                out[own] = total + intercepts[k]
            values = pa.array(out.ravel(), mask=np.repeat(blank, len(names)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(names)), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "period", "y")), lists], names=[*keys, "period", "y", "_p"])

    kept = asked.select(*keys, "period", "y")
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "_p array<double>"])
    said = asked.mapInArrow(multiply, shape).select(*keys, "period", "y", F.posexplode("_p").alias("_m", "_p"))
    name = lambda i: F.get(F.array(*(F.lit(n[i]) for n in names)).cast("array<string>"), F.col("_m"))
    said = said.select(*keys, "period", name(0).alias("features"), name(1).alias("target"), "y", F.round("_p", 12).alias("prediction"))
    return said.withColumn("y", F.when(F.col("target") == SIZE, F.abs("y")).otherwise(F.col("y")))


def quality(said: DataFrame, by: list[str]) -> DataFrame:
    """``n, mae, rmse, r2, rho`` per group."""
    return stats.regression_metrics(said, "y", "prediction", by).join(stats.spearman(said, "prediction", "y", by).drop("constant"), by)


def top_lift(said: DataFrame, by: list[str], q: float = 0.9) -> DataFrame:
    """Mean target of the rows whose prediction reaches the group's quantile, over the mean of all."""
    cuts = stats.linear_quantile(said, "prediction", q, by)
    top = F.avg(F.when(F.col("prediction") >= F.col("quantile"), F.col("y")))
    return said.join(cuts, by).groupBy(*by).agg(F.try_divide(top, F.avg("y")).alias("top_lift"))


def aggregate(said: DataFrame) -> DataFrame:
    """Per set and target over all folds; the lift for sizes only."""
    by = ["features", "target"]
    return quality(said, by).join(top_lift(said.where(F.col("target") == SIZE), by), by, "left")


def robustness(said: DataFrame, key: str, least: int = 20) -> DataFrame:
    """The text model's signed predictions per value of ``key`` that has enough rows."""
    own = said.where((F.col("features") == "text") & (F.col("target") == SIGNED))
    return quality(own, [key]).where(F.col("n") >= least)


def increment_gate(said: DataFrame) -> DataFrame:
    """A row per check of what text adds to metadata: ``check, found, bound, passed``. The shares are over folds."""
    signed = said.where(F.col("target") == SIGNED)
    per = quality(signed, ["period", "features"])
    pick = lambda name: F.max(F.when(F.col("features") == name, F.col("rho")))
    folds = per.groupBy("period").agg(pick("text").alias("text"), pick("metadata_only").alias("metadata"))
    more = F.col("text") - F.col("metadata")
    seen = folds.agg(
        F.percentile("text", F.lit(0.5)).alias("median_text"), F.avg(more).alias("mean_increment"),
        F.avg((more > 0).cast("double")).alias("positive_share"), F.min("text").alias("worst_text"),
    )
    error = lambda name: F.avg(F.when(F.col("features") == name, F.abs(F.col("prediction") - F.col("y"))))
    errors = signed.agg(F.try_divide(error("text"), error("metadata_only")).alias("error_ratio"))
    rules = [("median_outer_correlation_positive", "median_text", 0.0, ">"), ("mean_increment", "mean_increment", 0.02, ">="),
             ("positive_increments", "positive_share", 2 / 3, ">="), ("error_ratio", "error_ratio", 1.01, "<="),
             ("worst_fold", "worst_text", -0.05, ">=")]
    holds = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    checks = F.array(*(F.struct(
        F.lit(name).alias("check"), F.col(c).alias("found"), F.lit(bound).alias("bound"), holds[sign](F.col(c), F.lit(bound)).alias("passed")
    ) for name, c, bound, sign in rules))
    return seen.crossJoin(errors).select(F.explode(checks).alias("c")).select("c.*")
