"""Behaviours of the panel operators on literal frames: leakage, gaps, edge values and recursion checks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import calendars, features, fitted, newsroom, stats, validate
from panelspark.functions import text as T

BAR = "ticker string, session date, open double, high double, low double, close double, volume long, adj double"


def days(n, start=dt.date(2026, 1, 5)):
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(1)
    return out


def bars_of(spark, closes, ticker="A", skip=()):
    rows = [(ticker, d, c - 1.0, c + 1.0, c - 2.0, float(c), 1000 + 20 * i, float(c)) for i, (d, c) in enumerate(zip(days(len(closes)), closes)) if i not in skip]
    return spark.createDataFrame(rows, BAR)


def calendar_of(spark, n):
    from panelspark.sources.adapters import calendar

    return calendar(spark.createDataFrame([(d, 100.0 + (i * 7 % 11)) for i, d in enumerate(days(n))], "session date, price double"))


def panel_of(spark, closes, **kw):
    cal = calendar_of(spark, len(closes))
    return bars_of(spark, closes, **kw).join(cal.select("session", "idx", "next_session"), "session"), cal


def closes(n, seed=1):
    rng = np.random.default_rng(seed)
    return [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))]


def test_rising_closes_have_full_rsi_and_future_changes_only_the_label(spark):
    rising = [100.0 + i for i in range(32)]
    before, _ = panel_of(spark, rising)
    rising[26] = 90.0
    after, _ = panel_of(spark, rising)
    rows = []
    for p in (before, after):
        got = features.forward_label(p.withColumn("change", F.col("adj") - F.lag("adj").over(features.order())).withColumn("rsi", features.rsi("change", 14)))
        rows.append(got.where("idx = 25").select("rsi", "label_up").first())
    assert rows[0]["rsi"] == rows[1]["rsi"] == 100.0 and (rows[0]["label_up"], rows[1]["label_up"]) == (1, 0)


def test_changing_tomorrow_changes_targets_and_no_feature(spark):
    series = closes(45)
    p1, cal = panel_of(spark, series)
    series[40] *= 1.3
    p2, _ = panel_of(spark, series)
    one, two = (features.study_rows(p, cal).where("idx = 39").first() for p in (p1, p2))
    assert all(one[c] == two[c] for c in features.FEATURE_NAMES) and one["primary"] != two["primary"]


def test_a_missing_bar_is_not_replaced_by_a_later_one(spark):
    p, cal = panel_of(spark, closes(60), skip={50})
    rows = {r["idx"] for r in features.study_rows(p, cal).select("idx").collect()}
    assert rows == set(range(34, 49))  # 49 has no next session, 50 no bar, later ones no full history


@pytest.mark.parametrize("partitions", [1, 16])
def test_filters_equal_the_recursions(spark, partitions):
    series = closes(40)
    p, cal = panel_of(spark, series)
    row = features.study_rows(p.repartition(partitions, "ticker"), cal).where("idx = 38").first()
    window = series[4:39]

    def ema(values, span):
        out = [values[0]]
        for v in values[1:]:
            out.append(2 / (span + 1) * v + (1 - 2 / (span + 1)) * out[-1])
        return out

    line = [a - b for a, b in zip(ema(window, 12), ema(window, 26))]
    assert math.isclose(row["macd_12_26_normalized"], line[-1] / window[-1], abs_tol=1e-12)
    assert math.isclose(row["macd_signal_9_normalized"], ema(line, 9)[-1] / window[-1], abs_tol=1e-12)
    full = features.macd_full(p).orderBy("session").collect()[38]
    whole = [a - b for a, b in zip(ema(series[:39], 12), ema(series[:39], 26))]
    assert math.isclose(full["macd"], whole[-1], abs_tol=1e-9) and math.isclose(full["macd_signal"], ema(whole, 9)[-1], abs_tol=1e-9)


def test_flat_windows_have_zero_scores(spark):
    p, _ = panel_of(spark, [5.0] * 25)
    row = p.select("idx", features.zscore("adj", 20).alias("z")).where("idx = 24").first()
    assert row["z"] == 0.0


def test_invalid_bars_are_named(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), 5.0, 4.0, 6.0, 5.0, -1, 5.0)], BAR)
    assert {r["issue"] for r in validate.bar_issues(df).collect()} == {"high_below_body", "low_above_body", "high_below_low", "negative_volume"}
    with pytest.raises(ValueError):
        validate.assert_unique(df.union(df), ["ticker", "session"])


def test_cutoff_decides_the_session(spark):
    sessions = spark.createDataFrame([(d,) for d in days(4, dt.date(2024, 1, 4))], "session date")  # 4, 5, 8, 9 January
    events = spark.createDataFrame([(1, "2024-01-05 05:29:00"), (2, "2024-01-05 05:30:00"), (3, "2024-01-05 05:31:00"), (4, "2024-01-06 01:00:00"),
                                    (5, "2024-01-09 09:00:00"), (6, None)], "id int, at string").withColumn("published_at", F.col("at").cast("timestamp"))
    got = {r["id"]: r["effective"] for r in calendars.assign_sessions(events, sessions, "Asia/Taipei", 13, 30).collect()}
    d = dt.date
    assert got == {1: d(2024, 1, 5), 2: d(2024, 1, 5), 3: d(2024, 1, 8), 4: d(2024, 1, 8), 5: None, 6: None}


def test_folds_purge_targets_and_cuts_ignore_the_evaluation_period(spark):
    rows = spark.createDataFrame([("A", dt.date(2020, 12, 30), dt.date(2020, 12, 31), 1.0), ("A", dt.date(2020, 12, 31), dt.date(2021, 1, 4), 2.0),
                                  ("A", dt.date(2021, 1, 4), dt.date(2021, 1, 5), 1e6)], "ticker string, session date, next_session date, v double")
    got = calendars.assign_folds(rows, calendars.yearly_folds(spark, range(2021, 2022), "2010-01-01"))
    assert sorted((r["session"].isoformat(), r["role"]) for r in got.collect()) == [("2020-12-30", "train"), ("2021-01-04", "evaluation")]
    assert stats.fold_tertiles(got, ["v"]).first()["v_high"] < 6


def test_ties_fill_deciles_and_lift_cuts_at_the_ceiling(spark):
    rows = [("f", "A", days(20)[i], 1.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "fold string, ticker string, session date, score double, y double")
    got = stats.assign_deciles(df, "score", ["fold"]).collect()
    assert sorted(r["decile"] for r in got) == sorted([*range(1, 11)] * 2)
    assert next(r["decile"] for r in got if r["session"] == days(1)[0]) == 10
    ten = spark.createDataFrame([("f", "A", days(10)[i], float(i + 1), 10.0 if i == 9 else 1.0) for i in range(10)], df.schema)
    assert math.isclose(stats.lift(ten, "y", "score", 0.1, ["fold"]).first()["lift"], 10 / 1.9)
    assert stats.lift(ten.withColumn("y", F.lit(0.0)), "y", "score", 0.1, ["fold"]).first()["lift"] is None
    flat = stats.spearman(ten.withColumn("score", F.lit(1.0)), "score", "y", ["fold"]).first()
    assert (flat["rho"], flat["constant"]) == (0.0, True)


def test_parameter_choice_breaks_ties_in_order(spark):
    rows = [("0.1", .2, 1., .1, 1), ("1", .3, 1.5, 0., 1), ("10", .3, 1., 0., 2), ("100", .3, 1., 0., 1)]
    df = spark.createDataFrame(rows, "params string, mean_rho double, mae double, worst_rho double, complexity int")
    assert stats.select_params(df, []).first()["params"] == "100"


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1] + [2, 0, 1]
    y = np.abs(x @ [0.3, 0.1, 2.0] + rng.normal(size=200))
    df = spark.createDataFrame([("f", *map(float, r), float(v)) for r, v in zip(x, y)], "fold string, a double, b double, c double, y double")
    got = fitted.fit_ridge(df, ["a", "b", "c"], F.log1p("y"), [10.0], ["fold"]).first()
    z = (x - x.mean(0)) / x.std(0)
    t = np.log1p(y)
    beta = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (t - t.mean())) / x.std(0)
    assert np.allclose(got["coefficients"], beta) and math.isclose(got["intercept"], t.mean() - beta @ x.mean(0), rel_tol=1e-9)


def test_platt_and_hc3_against_numpy(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0.05, 0.95, 400)
    hit = (rng.uniform(size=400) < p**2).astype(int)
    a, b = fitted.platt(spark.createDataFrame([(float(u), int(v)) for u, v in zip(p, hit)], "p double, y int"), "p", "y")
    x = np.log(p / (1 - p))
    q = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(((q - hit) * x).sum()) < 1e-4 and abs((q - hit).sum()) < 1e-4
    u = rng.normal(size=(100, 2))
    y = u @ [1.0, -2.0] + rng.normal(size=100) * (1 + np.abs(u[:, 0]))
    got = {r["term"]: r["se"] for r in fitted.ols_hc3(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(u, y)], "a double, b double, y double"), "y", ["a", "b"]).collect()}
    m = np.c_[np.ones(100), u]
    inv = np.linalg.inv(m.T @ m)
    h = np.einsum("ij,jk,ik->i", m, inv, m)
    e = (y - m @ inv @ m.T @ y) / (1 - h)
    se = np.sqrt(np.diag(inv @ (m.T * e**2) @ m @ inv))
    assert np.allclose([got["intercept"], got["a"], got["b"]], se)


def test_upsert_keeps_adjusted_close_through_rounding_jitter(spark):
    kind = "ticker string, session date, close double, volume long, adj double"
    day = dt.date(2024, 1, 2)
    old = spark.createDataFrame([("A", day, 101.0, 1, 101.001)], kind)
    for new, want in ((101.004, 101.001), (100.5, 100.5)):
        assert newsroom.upsert_bars(old, spark.createDataFrame([("A", day, 101.0, 2, new)], kind)).first()["adj"] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("HTTPS://Example.COM/news/?utm_source=test&id=7#section", "112/03/05", "ＡＢＣ：測試", "2330 rose", "需求強勁 但 未成長")],
                               "url string, day string, title string, body string, zh string")
    row = df.select(T.canonical_url(F.col("url")).alias("u"), T.parse_roc_date(F.col("day")).alias("d"), T.norm_title(F.col("title")).alias("t"),
                    T.mentions(F.col("body"), F.lit("2330")).alias("m"), T.mentions(F.col("body"), F.lit("233")).alias("n"), T.lexicon_sentiment(F.col("zh")).alias("s")).first()
    assert (row["u"], row["d"], row["t"], row["m"], row["n"]) == ("https://example.com/news?id=7", dt.date(2023, 3, 5), "abc測試", True, False)
    assert math.isclose(row["s"]["neu"], math.e / (2 + math.e))


def test_votes_abstain_and_conflict(spark):
    votes = spark.createDataFrame([("a", "f", "POSITIVE", 1.0), ("a", "g", "POSITIVE", .8), ("b", "f", "POSITIVE", 1.0), ("b", "g", "NEGATIVE", 1.0), ("c", "f", "POSITIVE", 1.0)],
                                  "input_id string, function_id string, impact string, confidence double")
    weights = spark.createDataFrame([("f", 1.0), ("g", 1.0)], "function_id string, weight double")
    got = {r["input_id"]: r for r in newsroom.aggregate_votes(votes, weights).collect()}
    assert got["a"]["label"] == "POSITIVE" and got["b"]["label"] == "AMBIGUOUS" and got["c"]["label"] is None
    assert (got["b"]["agreement"], got["b"]["entropy"], got["b"]["reason"]) == (0.5, 1.0, "VOTE_CONFLICT")


def test_near_dup_pairs_of_widely_held_shingles(spark):
    base = "the same headline stands in very many of these short texts"
    texts = [f"{base} {i:03d}" for i in range(120)] + [f"another text of its own {i}" * 2 for i in range(3)]
    sets = [(lambda c: {c[i : i + 5] for i in range(len(c) - 4)})(t.replace(" ", "")) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if 0.7 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 1}
    got = newsroom.near_dup_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert len(want) > 7000 and {(r["left"], r["right"]) for r in got} == want and len(got) == len(want)


def test_positions_and_average_ranks(spark):
    rng = np.random.default_rng(3)
    values = [None, float("nan"), -2.5, 0.0, *rng.normal(0, 3, 200).round(1).tolist(), 1e12, -1e-9, *[0.5] * 40]
    rows = [("g", v, float(i % 7), i, str(i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "fold string, score double, y double, session int, ticker string")
    got = {r["ticker"]: (r["_r"], r["_n"]) for r in stats.positions(df, ["fold"], "score").collect()}
    key = lambda r: (math.inf if r[1] is None else -math.inf if math.isnan(r[1]) else -r[1] if r[1] != 1e12 else -1e12, r[3])
    assert got == {r[4]: (n, len(rows)) for n, r in enumerate(sorted(rows, key=key), 1)}
    plain = df.where("score IS NOT NULL AND NOT isnan(score)").toPandas()
    want = np.corrcoef(plain["score"].rank(), plain["y"].rank())[0, 1]
    assert math.isclose(stats.spearman(df.where("score IS NOT NULL AND NOT isnan(score)"), "score", "y", ["fold"]).first()["rho"], want, rel_tol=1e-9)


def test_a_fold_with_one_score_is_ordered_session_by_session(spark):
    rows = [("g", 1.0, float(i % 3), i % 50, f"{i // 50:03d}") for i in range(2000)] + [("h", 0.5, 1.0, None, "a"), ("h", 0.5, 2.0, 1, "b"), ("h", None, 3.0, 1, "a")]
    df = spark.createDataFrame(rows, "fold string, score double, y double, session int, ticker string")
    out = stats.positions(df, ["fold"], "score").collect()
    places = {(r["fold"], r["session"], r["ticker"]): r["_r"] for r in out}
    want = sorted((r for r in rows if r[0] == "g"), key=lambda r: (r[3], r[4]))
    assert [places["g", r[3], r[4]] for r in want] == list(range(1, 2001)) and len(out) == len(rows)
    assert (places["h", None, "a"], places["h", 1, "b"], places["h", 1, "a"]) == (1, 2, 3)
    cells = stats.value_cells(df.where("fold = 'g'"), ["fold"], "score", ("session",), True)
    assert cells.count() == 50 and cells.agg({"_own": "max"}).first()[0] == 40  # no task orders more rows than these
    ranked = stats.average_rank(df, ["fold"], "score", df).where("fold = 'g'").select("_rank_score").distinct().collect()
    assert [r[0] for r in ranked] == [1000.5]
    assert [tuple(r) for r in stats.spearman(df.where("fold = 'g'"), "score", "y", ["fold"]).collect()] == [("g", 0.0, True)]


def test_lexicon_scorer_equals_the_column_function(spark):
    texts = ["", "營收成長", "並未成長，不會虧損", "下修 下修 上調", None, "沒有改善也未改善", "獲利獲利" * 300]
    df = spark.createDataFrame([(i, "zh-TW" if i % 2 else "zh", t) for i, t in enumerate(texts)], "id int, lang string, text string")
    out = {r["id"]: r for r in newsroom.score_texts(df, newsroom.LexiconScorer(prefixes=("zh",))).collect()}
    want = df.fillna("", ["text"]).select("id", T.lexicon_sentiment(F.col("text")).alias("s")).collect()
    assert len(out) == len(texts) and {r["model_version"] for r in out.values()} == {"lexicon-1"}
    for r in want:
        assert np.allclose([out[r["id"]][c] for c in ("pos", "neu", "neg")], list(r["s"]))
    for wrong in ([(0.5, 0.6, 0.1)], [(-0.5, 1.0, 0.5)], [(float("nan"), 0.5, 0.5)]):
        with pytest.raises(Exception, match="probabilities"):
            newsroom.score_texts(df.limit(1), lambda: lambda texts: wrong).collect()  # noqa: B023


def test_match_entities_by_keys(spark):
    news = spark.createDataFrame([(1, "2330 up", "x", None), (2, "a12330b", "see 2330.", []), (3, "\u53f0\u7a4d\u96fb rises", None, None), (4, None, "", ["2330", "none"])],
                                 "id int, title string, summary string, own array<string>")
    aliases = spark.createDataFrame([("2330", "\u53f0\u7a4d\u96fb"), ("2330", "tsm"), ("17", "")], "ticker string, alias string")
    got = {(r["id"], r["ticker"], r["score"]) for r in newsroom.match_entities(news, aliases, "own").collect()}
    assert got == {(1, "2330", 0.95), (2, "2330", 0.75), (3, "2330", 0.9), (4, "2330", 1.0)}
    assert newsroom.match_entities(news, aliases.limit(0), "own").count() == 0


def test_trades_are_shuffled_before_bars_sort_them(spark):
    from panelspark.sources import adapters

    plan = adapters.bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.rsplit("Exchange", 1)
    assert "Aggregate" in above and "Aggregate" not in below and plan.count("Exchange") == 1


def test_texts_are_scored_in_small_lots(spark):
    def scorer():
        def predict(texts):
            assert len(texts) <= 256
            return [(1.0, 0.0, 0.0) if "good" in t else (0.0, 1.0, 0.0) for t in texts]

        return predict

    df = spark.range(3000, numPartitions=1).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("good "), F.col("id").cast("string"))).alias("text"))
    found = newsroom.score_texts(df, scorer)
    assert found.columns == ["id", "text", "model_version", "pos", "neu", "neg"]
    assert {r["id"]: r["pos"] for r in found.collect()} == {i: float(i % 3 > 0) for i in range(3000)}
