"""Nested evaluation, reaction study, bootstrap of ranks and near duplicates against NumPy and plain Python."""

import hashlib
import math
import random
import time
import unicodedata
from datetime import date, timedelta
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import blockpairs, bootstrap, grams, nested, products, reaction_study, stats
from panelspark.operators import newsroom as N


def ridge(x, y, alpha):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale == 0, 1.0, scale)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / scale
    return y.mean() - mean @ beta, beta


def ranks(v, w=None):
    w = np.ones(len(v)) if w is None else w
    return np.array([w[v < x].sum() + (w[v == x].sum() + 1) / 2 for x in v])


def keep_in(folder):
    def keep(df, name):
        path = f"file://{folder}/{name}-{random.random()}"
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    return keep


@pytest.fixture(scope="module")
def panel_rows():
    rng, out = np.random.default_rng(3), []
    sessions = [date(1998, 1, 1) + timedelta(days=11 * k) for k in range(140)]
    for t in range(12):
        for k, s in enumerate(sessions[:-1]):
            x = rng.normal(size=3)
            y = float(abs(0.5 + 0.3 * x[0] + rng.normal() * 0.4))
            out.append((f"t{t}", s, sessions[k + 1], y, float(abs(x[1])), float(x[0]), float(x[1]), 1.0))
    return pd.DataFrame(out, columns=["ticker", "session", "next_session", "y", "naive", "a", "b", "flat"])


def test_nested_ridge_equals_numpy(spark, panel_rows, tmp_path):
    """Predictions, evidence and choice of every fold; rows whose target lies in a period are not trained on."""
    folds = [nested.Fold("2001", date(2001, 1, 1), date(2001, 12, 31)), nested.Fold("2002h", date(2002, 1, 1), date(2002, 4, 30))]
    alphas, columns = [0.1, 100.0, 10_000.0], ["a", "b", "flat"]
    df = spark.createDataFrame(panel_rows)
    settings = [nested.Setting("naive", "", 0), *nested.ridge_settings(alphas)]
    got = nested.nested_evaluation(df, folds, settings, columns, date(1998, 1, 1), keep_in(tmp_path), blocks=3, months=6)
    p = panel_rows

    def predicted(start, end, alpha):
        train, held = p[p.next_session < start], p[(p.session >= start) & (p.session <= end)]
        a, b = ridge(train[columns].to_numpy(), np.log1p(train.y.to_numpy()), alpha)
        return held, np.maximum(np.expm1(a + held[columns].to_numpy() @ b), 0)

    oof = got.oof.toPandas()
    for fold in folds:
        evidence = {}
        for alpha in alphas:
            per = [(np.corrcoef(ranks(q.round(12)), ranks(h.y.to_numpy()))[0, 1], np.abs(q - h.y).mean())
                   for h, q in (predicted(i.start, i.end, alpha) for i in nested.inner_folds(fold, 3, 6))]
            evidence[alpha] = (-round(np.mean([x[0] for x in per]), 9), round(np.mean([x[1] for x in per]), 9), -round(min(x[0] for x in per), 9), -alpha)
        best = min(evidence, key=evidence.get)
        own = oof[(oof.fold == fold.name) & (oof.model == "ridge")].sort_values(["session", "ticker"])
        assert set(own.params) == {f"alpha={best}"}
        held, want = predicted(fold.start, fold.end, best)
        order = held.assign(q=want).sort_values(["session", "ticker"])
        assert len(own) == len(order) and np.allclose(own.prediction.to_numpy(), order.q.to_numpy(), atol=1e-8)
        naive = oof[(oof.fold == fold.name) & (oof.model == "naive")]
        assert len(naive) == len(held) and np.isclose(naive.prediction.sum(), held.naive.sum())
    found = {(r.fold, r.params): r for r in got.evidence.where("model = 'ridge'").collect()}
    assert len(found) == 6 and all(r.periods == 3 for r in found.values())
    summary = {r.model: r for r in nested.model_summary(got.metrics).collect()}
    assert summary["ridge"].folds == 2 and summary["ridge"].mean_rho > summary["naive"].mean_rho
    assert not got.metrics.where("constant").count()


def test_nested_refuses_short_history_and_odd_starts(spark, panel_rows):
    df = spark.createDataFrame(panel_rows.head(50))
    fold = nested.Fold("x", date(1999, 1, 1), date(1999, 12, 31))
    with pytest.raises(ValueError, match="history"):
        nested.nested_evaluation(df, [fold], nested.ridge_settings([1.0]), ["a"], date(1998, 1, 1), lambda d, n: d)
    with pytest.raises(ValueError, match="quarter"):
        nested.nested_predictions(df, [nested.Fold("x", date(1999, 2, 1), date(1999, 2, 9))], nested.ridge_settings([1.0]), ["a"], date(1998, 1, 1))


def test_nested_fits_pass_over_vectors_that_are_made_once(spark, panel_rows):
    """However many settings and passes a beginning has; the rows of its period are told by every setting."""
    from pyspark.ml.functions import vector_to_array

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    def fit(train):
        assert len({(train.count(), train.agg(F.count("_x")).first()[0]) for _ in range(3)}) == 1
        return lambda rows: rows.withColumn("raw", vector_to_array("_x")[0])

    settings = [nested.Setting("own", f"k={k}", k, fit=fit, columns=("a", "b")) for k in (1, 2)]
    period, p = nested.Fold("2001", date(2001, 1, 1), date(2001, 12, 31)), panel_rows
    df = spark.createDataFrame(p).withColumn("a", counted("a"))
    got = nested.nested_predictions(df, [period], settings, [], date(1998, 1, 1))
    assert made.value == (p.next_session < period.start).sum()
    held = p[(p.session >= period.start) & (p.session <= period.end)]
    want = np.sort(np.maximum(np.expm1(held.a.to_numpy()), 0).round(12))
    found = got.toPandas()
    assert set(found.params) == {"k=1", "k=2"}
    assert all(np.allclose(np.sort(own.prediction.to_numpy()), want) for _, own in found.groupby("params"))
    plain = stats.spearman(got, "prediction", "y", ["start", "params"])
    once = stats.spearman(got, "prediction", "y", ["start", "params"], got.where("params = 'k=1'"), ["start"])
    assert sorted(r.params for r in plain.collect()) == ["k=1", "k=2"]
    assert all(math.isclose(a.rho, b.rho, rel_tol=1e-12) for a, b in zip(*(x.orderBy("params").collect() for x in (plain, once)), strict=True))


def test_inner_periods_end_where_the_fold_begins():
    inner = nested.inner_folds(nested.Fold("f", date(2019, 1, 1), date(2020, 12, 31)), 3, 12)
    assert [(i.start, i.end) for i in inner] == [(date(y, 1, 1), date(y, 12, 31)) for y in (2016, 2017, 2018)]


def test_gram_blocks_of_arrays_codes_and_broken_rows(spark):
    rng = np.random.default_rng(1)
    n = 700
    x, e, c = rng.normal(size=n), rng.normal(size=(n, 5)), rng.integers(-1, 3, n)
    y, block = rng.normal(size=n), rng.integers(0, 4, n)
    rows = [(float(x[i]), e[i].tolist(), None if c[i] < 0 else int(c[i]), float(y[i]), int(block[i])) for i in range(n)]
    rows += [(None, e[0].tolist(), 0, 1.0, 1), (float("nan"), e[0].tolist(), 0, 1.0, 1), (1.0, None, 0, 1.0, 1), (1.0, e[0].tolist(), 0, None, 1), (1.0, e[0].tolist(), 0, 1.0, None)]
    df = spark.createDataFrame(rows, "x double, e array<double>, c int, y double, block int").repartition(5)
    made = grams.gram_blocks(df, [F.col("x"), F.col("e")], [F.col("y"), F.abs("y")], F.col("block"), [(F.col("c"), 3)])
    one = np.stack([(c == k).astype(float) for k in range(3)], axis=1)
    wide = np.column_stack([np.ones(n), x, e, one, y, np.abs(y)])
    for bound in (1, 4):
        rows = grams.prefix_grams(made, [0, bound]).where(F.col("bound") == bound).orderBy("i").collect()
        own = wide[block < bound]
        assert np.allclose(np.array([r.row for r in rows]), own.T @ own)
    assert grams.prefix_grams(made, [0]).count() == 0
    assert grams.gram_blocks(df.where("false"), [F.col("x")], F.col("y"), F.col("block")).count() == 0


@pytest.fixture(scope="module")
def reaction_frame():
    rng, n = np.random.default_rng(8), 900
    ticker = rng.choice(["A", "B", "C"], n)
    period = rng.integers(0, 5, n)
    kind = np.where((period == 4) & (rng.random(n) < 0.3), "new", rng.choice(["k1", "k2"], n))
    e = rng.normal(size=(n, 4))
    y = 0.4 * e[:, 1] + (ticker == "B") * 0.5 + rng.normal(size=n) * 0.3
    return pd.DataFrame({"id": range(n), "ticker": ticker, "kind": kind, "m": rng.normal(size=n), "k": rng.normal(size=n), "e": e.tolist(), "period": period, "y": y})


def test_linear_quantile_holds_no_map_of_values(spark):
    """Equal to ``percentile`` and NumPy, with ties, nulls, NaN, one row and groups of nulls, but no task holds a group's values."""
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", rng.choice([-2.0, 0.0, 0.5, 1e9])) for _ in range(60)] + [("b", None), ("c", 7.5), ("d", None)]
    rows += [(None, float(x)) for x in range(10)] + [("e", 1.0), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 0.999, 1.0):
        out = stats.linear_quantile(df, "v", q, ["g"])
        want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
        got = {r.g: r.quantile for r in out.collect()}
        assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))
        assert got["a"] == pytest.approx(np.quantile([v for g, v in rows if g == "a"], q), rel=1e-12)
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_reaction_study_equals_numpy(spark, reaction_frame):
    p = reaction_frame
    columns = reaction_study.Columns(["m"], ["k"], ["ticker", "kind"], "e", ["id", "ticker"])
    said = reaction_study.reaction_predictions(spark.createDataFrame(p), columns, [3, 4]).cache()
    got = said.toPandas()
    assert len(got) == 6 * (p.period >= 3).sum()
    onehot = lambda train, rows: np.column_stack([(rows[c] == v).to_numpy(float) for c in ("ticker", "kind") for v in sorted(train[c].unique())])
    for period in (3, 4):
        train, held = p[p.period < period], p[p.period == period]
        parts = {"market_only": lambda t, r: r[["m"]].to_numpy(), "metadata_only": lambda t, r: np.column_stack([r[["m", "k"]], onehot(t, r)]),
                 "text": lambda t, r: np.column_stack([r[["m", "k"]], onehot(t, r), np.array(r.e.tolist())])}
        for name, build in parts.items():
            for target in ("signed", "size"):
                y = train.y.to_numpy() if target == "signed" else np.abs(train.y.to_numpy())
                a, b = ridge(build(train, train), y, 100.0)
                own = got[(got.period == period) & (got.features == name) & (got.target == target)].sort_values("id")
                assert np.allclose(own.prediction, a + build(train, held) @ b, atol=1e-9), (period, name, target)
    size = got[(got.target == "size") & (got.features == "text")]
    lift = size.y[size.prediction >= np.quantile(size.prediction, 0.9)].mean() / size.y.mean()
    total = {(r.features, r.target): r for r in reaction_study.aggregate(said).collect()}
    assert math.isclose(total["text", "size"].top_lift, lift, rel_tol=1e-9) and total["text", "signed"].top_lift is None
    gate = {r.check: r for r in reaction_study.increment_gate(said).collect()}
    rho = {(n, t): np.corrcoef(ranks(o.prediction.to_numpy()), ranks(o.y.to_numpy()))[0, 1] for (n, t), o in got[got.target == "signed"].groupby(["features", "period"])}
    more = [rho["text", t] - rho["metadata_only", t] for t in (3, 4)]
    assert math.isclose(gate["mean_increment"].found, np.mean(more), rel_tol=1e-6) and gate["mean_increment"].passed == (np.mean(more) >= 0.02)
    assert gate["positive_increments"].found == np.mean(np.array(more) > 0) and len(gate) == 5
    assert {r.ticker for r in reaction_study.robustness(said, "ticker", 20).collect()} == {"A", "B", "C"}
    assert reaction_study.robustness(said, "ticker", 10_000).count() == 0


def test_reaction_predictions_are_made_in_batches(spark, reaction_frame):
    columns = reaction_study.Columns(["m"], ["k"], ["ticker", "kind"], "e", ["id", "ticker"])
    rows = spark.createDataFrame(reaction_frame)
    blank = rows.withColumns({"m": F.when(F.col("id") % 7 > 0, F.col("m")), "e": F.when(F.col("id") % 5 > 0, F.col("e")), "kind": F.when(F.col("id") % 3 > 0, F.col("kind"))})
    said = reaction_study.reaction_predictions(blank, columns, [3, 4])
    plan = said._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
    asked = blank.where("period IN (3, 4)")
    assert said.count() == 6 * asked.count() and said.where("prediction IS NULL").count() == 6 * asked.where("m IS NULL OR e IS NULL").count()
    assert reaction_study.reaction_predictions(blank, columns, [0]).count() == 0


def test_bootstrap_of_ranks_equals_copies_of_rows(spark):
    """Against rows that are really copied; with ties, one score for a third of all rows, and a constant fold."""
    rng = np.random.default_rng(2)
    rows = []
    for fold in ("a", "b", "flat"):
        for s in range(9):
            for t in range(13):
                score = 0.5 if fold == "flat" or rng.random() < 0.33 else float(np.round(rng.normal(), 1))
                rows.append((fold, date(2020, 1, 1) + timedelta(days=s), f"t{t:02d}", float(np.round(abs(rng.normal() + score), 1)), score))
    p = pd.DataFrame(rows, columns=["fold", "session", "ticker", "y", "score"]).assign(prediction=lambda d: d.score + 0.1)
    reps = 7
    metrics, deciles = bootstrap.replicates(spark.createDataFrame(p), "y", "prediction", "score", reps, 11, 0.1)
    got = {r.rep: r for r in metrics.collect()}
    tenths = {(r.rep, r.decile): r.mean_y for r in deciles.collect()}
    p = p.sort_values(["fold", "score", "session", "ticker"], ascending=[True, False, True, True])
    p["decile"] = 10 - p.groupby("fold").cumcount() * 10 // (9 * 13)
    for rep in range(reps):
        per, everything = [], []
        for fold, own in p.groupby("fold"):
            days = sorted(own.session.unique())
            at = [int(hashlib.md5(f"11|{rep}|{fold}|{j}".encode()).hexdigest()[:8], 16) % 9 for j in range(9)]
            drawn = pd.concat([own[own.session == days[k]] for k in at]).sort_values(["score", "session", "ticker"], ascending=[False, True, True])
            error = drawn.prediction - drawn.y
            rho = 0.0 if drawn.score.nunique() == 1 else np.corrcoef(ranks(drawn.score.to_numpy()), ranks(drawn.y.to_numpy()))[0, 1]
            per.append((error.abs().mean(), (error**2).mean() ** 0.5, rho, drawn.y.head(math.ceil(0.1 * len(drawn))).mean() / drawn.y.mean()))
            everything.append(drawn)
        want = np.mean(per, axis=0)
        assert np.allclose([got[rep].mae, got[rep].rmse, got[rep].rho, got[rep].lift], want, atol=1e-9)
        for d, own in pd.concat(everything).groupby("decile"):
            assert math.isclose(tenths[rep, d], own.y.mean(), rel_tol=1e-9)
    table = {r.name: r for r in bootstrap.intervals(metrics, deciles).collect()}
    assert len(table) == 14 and table["mae"].replicates == reps and table["mae"].low <= table["mae"].mean <= table["mae"].high


# ---- near duplicates

def plain_text(t):
    return " ".join(unicodedata.normalize("NFKC", t).casefold().split())[:4000]


def runs(t):
    c = "".join(x for x in t if x.isascii() and (x.isdigit() or x.islower()) or "㐀" <= x <= "鿿")[:2000]
    return {c[i : i + 5] for i in range(max(len(c) - 4, 1))} if c else set()


def varied(rng, t):
    words = t.split(" ")
    for _ in range(rng.randrange(1, max(2, len(words) // 8))):
        words[rng.randrange(len(words))] = rng.choice(["other", "ward", "thence", ""])
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    base = [" ".join(rng.choice(["the", "ander", "tion", "erhe", "ouat", "stre", "blen"]) + rng.choice(["", "s", "nd", "ty"]) for _ in range(rng.choice([8, 25, 60]))) for _ in range(30)]
    out = base + [varied(rng, rng.choice(base)) for _ in range(120)] + base[:10] * 3 + [b.upper() + " !" for b in base[:5]] + [None, "", "short", "中文" * 30, "中文" * 30 + "字"]
    return [(i, t, rng.choice(["train", "train", "validation", "test"])) for i, t in enumerate(out)]


def test_audit_pairs_equal_all_pairs(spark, texts, monkeypatch):
    monkeypatch.setattr(blockpairs, "BLOCK", 16)
    df = spark.createDataFrame(texts, "id long, text string, split string")
    classes = {}
    for i, t, s in texts:
        if t and len(p := plain_text(t)) >= 20:
            first, splits = classes.get(p, (i, set()))
            classes[p] = (min(first, i), splits | {s})
    points = [(i, p, s, runs(p)) for p, (i, s) in classes.items()]
    near, final = {}, {}
    for k, (i, p, s, x) in enumerate(points):
        for j, q, t, y in points[k + 1 :]:
            if len(s | t) > 1 and x and y and (jac := len(x & y) / len(x | y)) >= 0.7:
                near[min(i, j), max(i, j)] = round(jac, 9)
                a, b = (p, q) if i < j else (q, p)
                if (ratio := SequenceMatcher(None, a, b, autojunk=False).ratio()) >= 0.92:
                    final[min(i, j), max(i, j)] = round(ratio, 6)
    got = {(r.left, r.right): round(r.jaccard, 9) for r in N.cross_split_pairs(df).collect()}
    assert got == near and len(near) > 40
    assert {(r.left, r.right): r.similarity for r in N.audit_pairs(df).collect()} == final
    assert N.cross_split_pairs(df.where("false")).count() == 0


def test_audit_pairs_read_whole_texts(spark):
    """Texts that differ behind their first 4,000 characters are not equal, and those that differ too much there are no pair."""
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    told = lambda n: " ".join(rng.choice(words) for _ in range(n))
    head, tail, letters = told(900), told(900), told(2500)
    texts = [(1, head + " " + tail, "train"), (2, head + " " + told(40) + " " + tail, "test"), (3, head + " " + told(900), "test"), (4, letters, "train"),
             (5, letters[:-30] + told(5), "validation")]
    assert len(head) > 4000
    found = {(r.left, r.right): r.similarity for r in N.audit_pairs(spark.createDataFrame(texts, "id long, text string, split string")).collect()}
    plain = {i: plain_all(t) for i, t, _ in texts}
    assert found == {k: round(SequenceMatcher(None, plain[k[0]], plain[k[1]], autojunk=False).ratio(), 6) for k in ((1, 2), (4, 5))}
    assert all(x < 1 for x in found.values())


def plain_all(t):
    return " ".join(unicodedata.normalize("NFKC", t).casefold().split())


def test_stored_blocks_grow_with_points(spark, tmp_path, monkeypatch):
    """A group of many blocks is stored once, not once per block of the other side, and no pair is lost or doubled."""
    monkeypatch.setattr(blockpairs, "BLOCK", 4)
    monkeypatch.setattr(blockpairs, "PART_BYTES", 4096)
    sig = F.sha2(F.col("id").cast("string"), 512).cast("binary")
    points = spark.range(200).select("id", (F.col("id") % 2).alias("g"), F.lit(8).alias("size"), F.lit(0).alias("mask"), sig.alias("sig"))
    pairs = blockpairs.product_pairs(points.where("id < 50"), points, lambda sizes, sigs: lambda size, sig: np.arange(len(sizes)), str(tmp_path))
    found = [(r.left, r.right) for r in pairs.collect()]
    assert sorted(found) == sorted((a, b) for a in range(50) for b in range(200) if a != b and a % 2 == b % 2)
    stored = [spark.read.parquet(f"{tmp_path}/blocks_{x}") for x in "ab"]
    assert [x.agg(F.sum(F.length("ids"))).first()[0] for x in stored] == [50 * 8, 200 * 8] and stored[1].count() > 12
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_matching_ratio_is_difflibs():
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnop 中é"])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 40, 90, 300])))
        b = list(a)
        for _ in range(rng.randrange(len(a) // 8 + 1)):
            b[rng.randrange(len(b))] = rng.choice(["", rng.choice(letters), rng.choice(letters) * 2])
        b = "".join(b)
        ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
        for least in (0.0, 0.7, 0.92):
            assert N.matching_ratio(a, b, least) == (ratio if ratio >= least else None)


def test_long_titles_are_matched_soon():
    """All pairs of equal characters of such titles are a thousand million; difflib took minutes."""
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    a = [rng.choice(words) for _ in range(12000)]
    b = [rng.choice(words) if k % 40 == 7 else w for k, w in enumerate(a)]
    start = time.process_time()
    assert N.matching_ratio(" ".join(a), " ".join(b), 0.92) > 0.95
    assert N.matching_ratio(" ".join(a), " ".join(rng.sample(a, len(a))), 0.92) is None
    assert time.process_time() - start < 20


def test_pairs_of_blocks_are_rows_of_their_own(spark, monkeypatch):
    """The pairs of one group's blocks are not one task's work."""
    monkeypatch.setattr(blockpairs, "BLOCK", 16)
    points = spark.range(400).select("id", F.lit(1).alias("g"), F.lit(8).alias("size"), F.lit(0).alias("mask"), F.lit(bytes(512)).alias("sig"))
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        pairs = blockpairs.near_pairs(points, points, blockpairs.bitmap_near(0.7), False)
        tasks = pairs.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key in own:
            spark.conf.unset(key)
    assert sum(r["count"] for r in tasks) == 400 * 399 and len(tasks) > 1


def test_title_duplicates_equal_all_pairs(spark, texts, monkeypatch):
    """Recall 1 within the days around, and none beside; equal titles are one class a day."""
    monkeypatch.setattr(blockpairs, "BLOCK", 16)
    rows = [(i, t[:90] if t else t, f"2024-01-{1 + i % 9:02d} 10:00:00") for i, t, _ in texts] + [(900, "?!", "2024-01-01 10:00:00"), (901, "abc", None)]
    df = spark.createDataFrame(rows, "id long, title string, at string").withColumn("published_at", F.to_timestamp("at"))
    word = lambda c: unicodedata.category(c)[0] in "LNM" or c == "_"
    items = [(i, "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if word(c)), int(a[8:10])) for i, t, a in rows if t and a]
    items = [x for x in items if x[1]]
    want = {}
    for i, t, d in items:
        like = [j for j, u, e in items if j < i and abs(d - e) <= 2 and (t == u or SequenceMatcher(None, min((j, u), (i, t))[1], max((j, u), (i, t))[1], autojunk=False).ratio() >= 0.92)]
        if like:
            want[i] = min(like)
    got = {r.id: r.duplicate_of for r in N.fuzzy_dups(df).collect()}
    assert set(got) == set(want) and len(want) > 30
    assert all(got[i] <= want[i] for i in want)
    classes, links = N.title_links(df)
    assert classes.agg(F.sum("n")).first()[0] == len(items) and links.where("a >= b").count() == 0
    assert N.fuzzy_dups(df.where("false")).count() == 0


def test_ingested_items_are_worked_out_once(spark):
    rows = [(1, "Alpha wins the big game", "u1", 0), (2, "alpha wins the big game", "u1", 1), (3, "Alpha wins the big game!", "u3", 2),
            (4, "Beta falls", "u4", 3), (5, None, "u5", 4), (6, "Beta falls", "u6", 9)]
    news = spark.createDataFrame([(i, t, f"https://x.y/{u}", date(2024, 1, 1) + timedelta(days=n), "Alpha and more") for i, t, u, n in rows],
                                 "id long, title string, url string, day date, summary string").withColumn("published_at", F.col("day").cast("timestamp")).drop("day")
    aliases = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "ticker string, alias string")
    out = products.ingest_news(news, aliases)
    found = {r["id"]: (r["ticker"], r["score"], r["n_exact"], r["n_fuzzy"]) for r in out.collect()}
    assert found == {1: ("A", 0.9, 1, 1), 4: ("B", 0.9, 1, 1), 5: ("A", 0.65, 1, 1), 6: ("B", 0.9, 1, 1)}
    assert "block_ratio" not in out._jdf.queryExecution().toString()
