"""The frozen model: one digest for one fit, checks on reading, scores and percentiles against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import artifact, fitted

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3)) * [1, 20, 0.01] + [0, 5, 1]
    y = np.exp(0.3 + 0.4 * x[:, 0] - 0.01 * x[:, 1] + rng.normal(size=900) * 0.2)
    df = spark.createDataFrame([(*map(float, r), float(v), "f") for r, v in zip(x, y)], "a double, b double, c double, y double, fold string")
    return df, x, y


def made(df, path):
    model = fitted.fit_ridge(df, COLUMNS, F.log1p("y"), [10.0], ["fold"], exact=True)
    said = fitted.predict_ridge(df, model, COLUMNS, ["fold"])
    terms = artifact.model_terms(df, COLUMNS, model)
    return artifact.freeze(terms, artifact.model_head(terms, model), artifact.reference_of(said, "prediction"), path)


def test_repeated_fits_share_a_digest_and_scores_equal_numpy(spark, data, tmp_path):
    df, x, y = data
    path = f"file://{tmp_path}/models"
    digest = made(df, path)
    assert {made(df.repartition(n), path) for n in (1, 5, 13)} == {digest}
    assert made(df.where("a < 1"), path) != digest
    model = artifact.read_artifact(spark, path, digest)
    assert [t["name"] for t in model["terms"]] == COLUMNS and model["alpha"] == 10.0
    z = (x - x.mean(0)) / x.std(0)
    t = np.log1p(y)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (t - t.mean()))
    want = np.maximum(np.expm1(t.mean() + z @ w), 0)
    out = artifact.score_rows(df, model).toPandas()
    order = np.argsort(x[:, 0])
    found = out.sort_values("a")
    assert np.allclose(found["artifact_score"], want[order], atol=1e-7)
    share = np.searchsorted(np.sort(want), want[order], side="right") / 900
    assert np.allclose(found["percentile"], share, atol=2e-3)
    assert set(found.loc[found["percentile"] >= 0.95, "band"]) == {"P95"} and set(found.loc[found["percentile"] < 0.5, "band"]) == {"BELOW"}


def test_rows_without_a_feature_have_no_score(spark, data, tmp_path):
    df, _, _ = data
    path = f"file://{tmp_path}/models"
    model = artifact.read_artifact(spark, path, made(df, path))
    rows = spark.createDataFrame([(1, 0.0, None, 1.0), (2, -900.0, 5.0, 1.0), (3, 900.0, 5.0, 1.0)], "id int, a double, b double, c double")
    out = {r["id"]: (r["artifact_score"], r["percentile"], r["band"]) for r in artifact.score_rows(rows, model).collect()}
    assert out[1] == (None, None, None) and out[2][0] == 0.0 and out[2][1] < 0.01 and out[2][2] == "BELOW" and out[3][1:] == (1.0, "P95")


@pytest.mark.parametrize("part, change, what", [
    ("terms", lambda t: t.withColumn("coefficient", F.col("coefficient") + F.when(F.col("position") == 1, 1e-6).otherwise(0.0)), "digest"),
    ("terms", lambda t: t.where("position <> 1"), "position"),
    ("terms", lambda t: t.withColumn("name", F.lit("a")), "twice"),
    ("terms", lambda t: t.withColumn("mean", F.when(F.col("position") > 0, F.col("mean"))), "finite"),
    ("terms", lambda t: t.withColumn("scale", F.lit(0.0)), "scale"),
    ("terms", lambda t: t.limit(0), "no features"),
    ("head", lambda h: h.withColumn("intercept", F.lit(float("nan"))), "finite"),
    ("head", lambda h: h.withColumn("alpha", F.lit(11.0)), "digest"),
    ("reference", lambda r: r.limit(0), "no reference"),
    ("reference", lambda r: r.withColumn("rows", F.lit(0).cast("long")), "unfit"),
    ("reference", lambda r: r.unionByName(r), "unfit"),
    ("reference", lambda r: r.withColumn("score", F.col("score") + 0.01), "digest"),
])
def test_tampered_artifacts_are_refused(spark, data, tmp_path, part, change, what):
    df, _, _ = data
    path = f"file://{tmp_path}/models"
    digest = made(df, path)
    tables = dict(zip(("terms", "head", "reference"), artifact.parts(spark, f"{path}/{digest}")))
    for name, table in tables.items():
        (change(table) if name == part else table).write.parquet(f"{path}/forged/{digest}/{name}")
    with pytest.raises(ValueError, match=what):
        artifact.read_artifact(spark, f"{path}/forged", digest)


def test_exact_sums_are_whole_numbers_multiplied_in_tasks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 2)) * [1e5, 1e-6]
    rows = [(*map(float, r), "ab"[i % 2]) for i, r in enumerate(x)] + [(None, 1.0, "a"), (float("nan"), 2.0, "b"), (float("inf"), 4.0, "b"), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, k string")
    pairs = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
    sums = lambda d: {r["k"]: r["sums"] for r in fitted.exact_sums(d, [F.lit(1.0), F.col("x"), F.col("y")], pairs, ["k"]).collect()}
    found = sums(df)
    assert found == sums(df.repartition(9)) == sums(df.orderBy("y"))
    values = df.select("k", F.lit(1.0).alias("c"), "x", "y")
    cells = [F.sum(F.when(~F.isnan(a * b) & (F.abs(a * b) < 1e300), a * b).cast("decimal(28,16)")).cast("double").alias(f"s{i}")
             for i, (a, b) in enumerate((F.col("cxy"[m]), F.col("cxy"[n])) for m, n in pairs)]
    want = {r["k"]: list(r[1:]) for r in values.groupBy("k").agg(*cells).collect()}
    assert found[None] == want[None] == [1.0, None, None, None, 1.0]
    assert all(np.allclose(found[k], want[k], rtol=1e-13, atol=1e-11) for k in "ab")
    big = spark.createDataFrame([(1e6, 1e6, "a")], "x double, y double, k string")
    with pytest.raises(Exception, match="10\\^12"):
        sums(big)
    plan = fitted.exact_sums(df, [F.col("x")], [(0, 0)], [])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "decimal(28,16)" not in plan
