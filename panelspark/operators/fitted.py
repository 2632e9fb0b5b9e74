"""Fitted operators: sufficient statistics on Spark, small solves on the driver, predictions as column expressions."""

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT, MOST = 10**16, 1e12  # of an exact sum: parts of one, and what a product must stay below
AT_ONCE, MOST_ROWS = 1024, 1 << 22  # rows whose parts, and whose whole numbers, surely add up in 64 bits


def exact_sums(df: DataFrame, values: list[Column], pairs: list[tuple[int, int]], by: list[str]) -> DataFrame:
    """``by, sums``: per group the sums of the products of ``pairs`` of values. A product is taken to 16 decimals as two whole
    numbers, so its sum is the same bit by bit in any order; one that is null or not finite is left out, and one of 10^12
    or more is an error. Tasks multiply columns of their batches and hand on one partial sum a group."""
    rows = df.select(*by, *(v.cast("double").alias(f"_{i}") for i, v in enumerate(values)))
    left, right = (np.array(side) for side in zip(*pairs))
    kinds, width = [df.schema[c].dataType.simpleString() for c in by], len(values)

    def told(held: dict[tuple, list], schema: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([k[c] for k in held for _ in pairs], schema.field(name).type) for c, name in enumerate(by)]
        parts = [pa.array(np.concatenate([h[i] for h in held.values()])) for i in range(3)]
        at = pa.array(np.tile(np.arange(len(pairs), dtype=np.int32), len(held)))
        return pa.RecordBatch.from_arrays([*keys, at, *parts], names=[*by, "_at", "_whole", "_parts", "_n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        seen, schema = 0, None
        for batch in batches:
            schema = batch.schema
            x = np.column_stack([batch.column(f"_{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * len(x)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            for key, own in places.items():
                for first in range(0, len(own), AT_ONCE):
                    some = x[own[first : first + AT_ONCE]]
                    with np.errstate(invalid="ignore", over="ignore"):
                        product = some[:, left] * some[:, right]
                    sound = np.isfinite(product)
                    product[~sound] = 0.0
                    if (np.abs(product) >= MOST).any():
                        raise ValueError("a product of 10^12 or more has no exact sum")
                    whole = np.rint(product)
                    total = held.setdefault(key, [np.zeros(len(pairs), dtype=np.int64) for _ in range(3)])
                    parts = total[1] + np.rint((product - whole) * UNIT).astype(np.int64).sum(axis=0)
                    total[0] += whole.astype(np.int64).sum(axis=0) + parts // UNIT
                    total[1] = parts % UNIT
                    total[2] += sound.sum(axis=0)
            seen += len(x)
            if seen > MOST_ROWS:
                yield told(held, schema)
                held, seen = {}, 0
        if held:
            yield told(held, schema)

    shape = ", ".join([*(f"`{c}` {k}" for c, k in zip(by, kinds)), "_at int, _whole long, _parts long, _n long"])
    one = lambda c: F.sum(F.col(c).cast("decimal(19,0)"))
    total = (one("_whole").cast("decimal(21,0)") * F.lit(UNIT).cast("decimal(17,0)") + one("_parts").cast("decimal(37,0)")).cast("double") / F.lit(float(UNIT))
    cells = rows.mapInArrow(add, shape).groupBy(*by, "_at").agg(F.when(F.sum("_n") > 0, total).alias("_sum"))
    return cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_sum"))).getField("_sum").alias("sums"))


def moments(df: DataFrame, columns: list[str], target: Column, by: list[str], exact: bool = False) -> DataFrame:
    """Counts, sums and cross products of ``columns`` and the target per group: one pass for every later solve. ``exact``
    sums are of fixed point numbers, the same bit by bit in any order; a product of 10^12 or more is an error."""
    named = [F.lit(1.0), *(F.col(c).cast("double") for c in columns), target.cast("double")]
    n = len(named)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    if exact:
        return exact_sums(df, named, pairs, by).withColumnRenamed("sums", "gram")
    return df.groupBy(*by).agg(F.array(*(F.sum(named[i] * named[j]) for i, j in pairs)).alias("gram"))


def unfold(gram: list[float], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = gram
    return out + np.triu(out, 1).T


def solve_ridge(gram: np.ndarray, alpha: float) -> tuple[float, list[float]]:
    """Intercept and coefficients, on the raw scale, of ridge on standardised columns (population deviation)."""
    n, p = gram[0, 0], gram.shape[0] - 2
    mean = gram[0, 1 : p + 1] / n
    cov = gram[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 1e-300))
    y = gram[0, -1] / n
    xy = (gram[1 : p + 1, -1] - n * mean * y) / scale
    beta = np.linalg.solve(cov / np.outer(scale, scale) + alpha * np.eye(p), xy) / scale
    return float(y - beta @ mean), beta.tolist()


def models_table(spark, rows: list[dict], kind: str) -> DataFrame:
    told = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")).alias("m"))
    return told.select("m.*")


def fit_ridge(df: DataFrame, columns: list[str], target: Column, alphas: list[float], by: list[str], exact: bool = False) -> DataFrame:
    """``by, alpha, intercept, coefficients`` for each group and alpha; groups are folds, tens at most."""
    rows = []
    for r in moments(df, columns, target, by, exact).collect():
        gram = unfold(r["gram"], len(columns) + 2)
        for alpha in alphas:
            a, b = solve_ridge(gram, alpha)
            rows.append({**{c: r[c] for c in by}, "alpha": alpha, "intercept": a, "coefficients": b})
    keys = ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in by)
    return models_table(df.sparkSession, rows, f"{keys}, alpha: double, intercept: double, coefficients: array<double>")


def linear(columns: list[str]) -> Column:
    """The dot product with a joined ``coefficients`` array, plus ``intercept``."""
    return sum((F.col(c) * F.col("coefficients")[i] for i, c in enumerate(columns)), F.col("intercept"))


def predict_ridge(df: DataFrame, models: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    rows = df.join(F.broadcast(models), by)
    return rows.withColumn("prediction", F.greatest(F.expm1(linear(columns)), F.lit(0.0))).drop("intercept", "coefficients")


def platt(df: DataFrame, p: str, y: str, steps: int = 12) -> tuple[float, float]:
    """Slope and intercept of a logistic on the clipped logit: Newton steps on distributed sums."""
    clipped = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = df.select(F.ln(clipped / (1 - clipped)).alias("x"), F.col(y).cast("double").alias("y")).persist()
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w = q * (1 - q)
        s = rows.agg(F.sum((q - F.col("y")) * F.col("x")), F.sum(q - F.col("y")), F.sum(w * F.col("x") ** 2), F.sum(w * F.col("x")), F.sum(w)).first()
        hessian = np.array([[s[2] + 1e-9, s[3]], [s[3], s[4] + 1e-9]])
        move = np.linalg.solve(hessian, np.array([s[0], s[1]]))
        a, b = a - float(move[0]), b - float(move[1])
        if abs(move).max() < 1e-10:
            break
    rows.unpersist()
    return a, b


def prequential_platt(df: DataFrame, p: str, y: str, folds: list[int]) -> DataFrame:
    """Fold k is calibrated by what the folds before it say; the first fold has no calibrator and is left out."""
    rows = []
    for k in folds[1:]:
        a, b = platt(df.where(F.col("fold") < k), p, y)
        rows.append({"fold": k, "slope": a, "shift": b})
    models = models_table(df.sparkSession, rows, "fold: int, slope: double, shift: double")
    clipped = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    z = F.col("slope") * F.ln(clipped / (1 - clipped)) + F.col("shift")
    return df.join(F.broadcast(models), "fold").withColumn("calibrated", 1 / (1 + F.exp(-z)))


def adoption(calibrated: DataFrame, p: str, y: str) -> DataFrame:
    """``adopted``: every fold's slope is positive and the pooled squared error of the calibrated forecasts is smaller."""
    error = lambda c: F.avg((F.col(c) - F.col(y)) ** 2)
    return calibrated.agg(((F.min("slope") > 0) & (error("calibrated") < error(p))).alias("adopted"))


def ols_hc3(df: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """Least squares with HC3 errors: one pass for the Gram matrix, one for leverages and residuals."""
    gram = unfold(moments(df, columns, F.col(y), []).first()["gram"], len(columns) + 2)
    p = len(columns) + 1
    inverse = np.linalg.pinv(gram[:p, :p])
    beta = inverse @ gram[:p, -1]
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    fitted = sum((F.lit(float(b)) * v for b, v in zip(beta, x, strict=True)), F.lit(0.0))
    leverage = sum((F.lit(float(inverse[i, j])) * x[i] * x[j] for i in range(p) for j in range(p)), F.lit(0.0))
    weight = ((F.col(y) - fitted) / (1 - leverage)) ** 2
    meat = df.agg(F.array(*(F.sum(weight * x[i] * x[j]) for i in range(p) for j in range(i, p))).alias("m")).first()["m"]
    cov = inverse @ unfold(meat, p) @ inverse
    rows = []
    for i, name in enumerate(["intercept", *columns]):
        se = math.sqrt(max(cov[i, i], 0.0))
        z = beta[i] / se if se else 0.0
        rows.append({"term": name, "coefficient": float(beta[i]), "se": se, "z": z, "p": math.erfc(abs(z) / math.sqrt(2)),
                     "low": float(beta[i] - 1.959963984540054 * se), "high": float(beta[i] + 1.959963984540054 * se)})
    return models_table(df.sparkSession, rows, "term: string, coefficient: double, se: double, z: double, p: double, low: double, high: double")


def ml_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def balanced(df: DataFrame, y: str) -> DataFrame:
    """Adds ``weight``: n / (2 * rows of the class)."""
    counts = df.groupBy(y).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    return df.join(F.broadcast(counts), y).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_t") / (2 * F.col("_c"))).drop("_c", "_t")
