"""Nested expanding-window evaluation: settings are chosen inside the training years of each outer fold, and the outer
rows are predicted once.

An outer fold is evaluated on a period and trained on all rows whose target lies before it; so is each of the inner
periods, the last ``blocks`` ones of ``months`` months before the fold. What a model knows depends on the beginning of
its period only, so each (beginning, setting) is fitted once, however many folds ask for it; ridge models of all
beginnings come from prefix sums of Gram blocks in one pass over the rows. A setting is chosen by the mean rank
correlation over the inner periods, then the mean error, the worst correlation, and the simpler setting.

Rows need ``ticker, session, next_session``, the target ``y`` (0 or more) and the features. Models predict ln(1 + y);
predictions are brought back, are 0 at least and rounded to 12 places. A constant prediction has correlation 0."""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import grams, stats

Keep = Callable[[DataFrame, str], DataFrame]
KEYS = ["ticker", "session", "next_session"]


@dataclass(frozen=True)
class Fold:
    name: str
    start: date
    end: date


@dataclass(frozen=True)
class Setting:
    """One setting of a model; of equally good ones the least ``complexity``, then ``params``, is taken. ``fit`` is given rows
    with the vector ``_x`` of ``columns`` and ``_y``, ln(1 + y), and gives a function from rows with ``_x`` to rows with ``raw``;
    without it the model is the ridge of ``alpha`` or the column ``naive``."""

    model: str
    params: str
    complexity: float
    alpha: float | None = None
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None
    columns: tuple[str, ...] = ()


def ridge_settings(alphas: list[float]) -> list[Setting]:
    return [Setting("ridge", f"alpha={a}", -a, alpha=a) for a in alphas]


def boosted_setting(columns: list[str], rounds: int, depth: int, least_rows: int, rate: float, seed: int = 7) -> Setting:
    """Boosted trees of bounded depth on ln(1 + y)."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        from pyspark.ml.regression import GBTRegressor

        trees = GBTRegressor(maxIter=rounds, maxDepth=depth, minInstancesPerNode=least_rows, stepSize=rate, seed=seed,
                             featuresCol="_x", labelCol="_y", predictionCol="raw")
        return trees.fit(train).transform

    params = f"depth={depth},least={least_rows},rate={rate},rounds={rounds}"
    return Setting("boosted", params, depth * 1000 - least_rows, fit=fit, columns=tuple(columns))


def months_before(day: date, months: int) -> date:
    at = day.year * 12 + day.month - 1 - months
    return date(at // 12, at % 12 + 1, 1)


def inner_folds(fold: Fold, blocks: int, months: int) -> list[Fold]:
    """The last ``blocks`` periods of ``months`` months before an outer fold, the earliest first."""
    starts = [months_before(fold.start, months * k) for k in range(blocks, 0, -1)]
    ends = [*starts[1:], fold.start]
    return [Fold(f"{fold.name}/{s}", s, e - timedelta(days=1)) for s, e in zip(starts, ends, strict=True)]


def constants(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def nested_predictions(rows: DataFrame, periods: list[Fold], settings: list[Setting], columns: list[str], train_start: date) -> DataFrame:
    """A row per row of a period and setting: ``start, end, model, params``, the keys, ``y`` and ``prediction``."""
    spark = rows.sparkSession
    starts = sorted({p.start for p in periods})
    if any(s.day != 1 or s.month % 3 != 1 for s in starts):
        raise ValueError("periods must begin with a quarter")
    rows = rows.where((F.col("session") >= F.lit(train_start)) & F.col("y").isNotNull())
    places = constants(spark, sorted({(p.start, p.end) for p in periods}), "start date, end date")
    asked = rows.join(F.broadcast(places), F.col("session").between(F.col("start"), F.col("end")))
    kept = ["start", "end", "model", "params", *KEYS, "y", "raw"]
    parts = []
    if naive := [s for s in settings if s.alpha is None and s.fit is None]:
        told = constants(spark, [(s.model, s.params) for s in naive], "model string, params string")
        parts.append(asked.join(F.broadcast(told)).withColumn("raw", F.log1p("naive")).select(*kept))
    if ridge := [s for s in settings if s.alpha is not None]:
        features = [F.col(c) for c in columns]
        blocks = grams.gram_blocks(rows, features, F.log1p("y"), grams.quarter(F.col("next_session")))
        code = {s.year * 4 + (s.month - 1) // 3: s for s in starts}
        models = grams.ridge_from_grams(grams.prefix_grams(blocks, sorted(code)), sorted({s.alpha for s in ridge}))
        told = constants(spark, [(b, d, s.model, s.params, s.alpha) for b, d in code.items() for s in ridge],
                         "bound long, start date, model string, params string, alpha double")
        models = told.join(models, ["bound", "alpha"])
        joined = asked.join(F.broadcast(models), "start")  # beginnings times settings
        raw = sum((F.col(c).cast("double") * F.col("coefficients")[i] for i, c in enumerate(columns)), F.col("intercept"))
        parts.append(joined.withColumn("raw", raw).select(*kept))
    for own in sorted({s.columns for s in settings if s.fit is not None}):
        lasts = {s: max(p.end for p in periods if p.start == s) for s in starts}
        parts += fitted_predictions(rows, asked, lasts, [s for s in settings if s.fit is not None and s.columns == own], kept)
    prediction = F.round(F.greatest(F.expm1("raw"), F.lit(0.0)), 12)
    return reduce(DataFrame.unionByName, parts).withColumn("prediction", prediction).drop("raw")


def fitted_predictions(rows: DataFrame, asked: DataFrame, lasts: dict[date, date], settings: list[Setting], kept: list[str]) -> list[DataFrame]:
    """A frame per beginning, a key of ``lasts`` with its last day, with the rows of all ``settings``, which have the same columns. Vectors are made once for the
    fits of a beginning, whose many passes read them from the cache, and once for its predictions."""
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(settings[0].columns), outputCol="_x").transform
    out = []
    for start, last in lasts.items():
        train = vectors(rows.where(F.col("next_session") < F.lit(start))).select("_x", F.log1p("y").alias("_y")).persist()
        models = [s.fit(train) for s in settings]
        train.unpersist()
        own = vectors(asked.where((F.col("start") == F.lit(start)) & F.col("session").between(F.lit(start), F.lit(last))))
        for i, apply in enumerate(models):
            own = apply(own).withColumnRenamed("raw", f"_raw_{i}")
        told = [F.struct(F.lit(s.model).alias("model"), F.lit(s.params).alias("params"), F.col(f"_raw_{i}").alias("raw")) for i, s in enumerate(settings)]
        plain = own.select(*(c for c in kept if c not in ("model", "params", "raw")), F.explode(F.array(*told)).alias("_m"))
        out.append(plain.select("*", "_m.*").select(*kept))
    return out


@dataclass(frozen=True)
class Nested:
    """``evidence``: per fold, model and setting; ``oof``: the outer rows as predicted by the chosen setting; ``metrics``
    per fold and model."""

    evidence: DataFrame
    oof: DataFrame
    metrics: DataFrame


def nested_evaluation(
    rows: DataFrame, folds: list[Fold], settings: list[Setting], columns: list[str], train_start: date, keep: Keep,
    blocks: int = 3, months: int = 12,
) -> Nested:
    """``keep`` stores a frame under a name and reads it back, so that no model is fitted or applied twice."""
    spark = rows.sparkSession
    inner = [(f.name, i) for f in folds for i in inner_folds(f, blocks, months)]
    if any(i.start <= train_start for _, i in inner):
        raise ValueError("an outer fold has too little history for its inner periods")
    periods = [*folds, *(i for _, i in inner)]
    said = keep(nested_predictions(rows, periods, settings, columns, train_start), "nested_predictions")
    period = ["start", "end", "model", "params"]
    one = said.where((F.col("model") == settings[0].model) & (F.col("params") == settings[0].params))
    rho = stats.spearman(said, "prediction", "y", period, one, ["start", "end"])
    scored = stats.regression_metrics(said, "y", "prediction", period).join(rho, period)
    scored = keep(scored, "nested_scores")
    told = constants(spark, [(s.model, s.params, float(s.complexity)) for s in settings], "model string, params string, complexity double")
    asks = constants(spark, [(name, i.start, i.end) for name, i in inner], "fold string, start date, end date")
    evidence = scored.join(F.broadcast(asks), ["start", "end"]).groupBy("fold", "model", "params").agg(
        F.count("*").alias("periods"), F.sum("n").alias("n"), F.avg("rho").alias("mean_rho"), F.avg("mae").alias("mae"), F.min("rho").alias("worst_rho"),
    ).join(F.broadcast(told), ["model", "params"])
    chosen = stats.select_params(evidence, ["fold", "model"]).select("fold", "model", "params")
    outer = constants(spark, [(f.name, f.start, f.end) for f in folds], "fold string, start date, end date")
    best = chosen.join(F.broadcast(outer), "fold")
    oof = said.join(F.broadcast(best), period).drop("start", "end")
    metrics = scored.join(F.broadcast(best), period).select("fold", "model", "params", "n", "mae", "rmse", "r2", "rho", "constant")
    return Nested(evidence, oof, metrics)


def model_summary(metrics: DataFrame) -> DataFrame:
    """Means, medians and worst values over the folds."""
    middle = lambda c: F.percentile(c, F.lit(0.5))
    return metrics.groupBy("model").agg(
        F.count("*").alias("folds"), F.avg("mae").alias("mean_mae"), middle("mae").alias("median_mae"), F.avg("rmse").alias("mean_rmse"),
        F.avg("r2").alias("mean_r2"), F.avg("rho").alias("mean_rho"), middle("rho").alias("median_rho"), F.min("rho").alias("worst_rho"),
    )
