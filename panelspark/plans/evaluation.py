"""Queries over scored study rows: folds, metrics, rankings, thresholds, comparisons, fits and bootstrap."""

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import aggregates as G
from panelspark.operators import bootstrap, calendars, features, fitted, nested, stats
from panelspark.plans.market import STUDY, cal_of, r
from panelspark.plans.registering import query, stored, written
from panelspark.sources import adapters as A
from panelspark.streaming.jobs import work_dir

YEARS = range(1999, 2002)
FOLDS_SQL = """folds(fold, train_start, train_end, evaluation_start, evaluation_end) AS (VALUES
  ('1999', DATE '1997-01-01', DATE '1998-12-31', DATE '1999-01-01', DATE '1999-12-31'),
  ('2000', DATE '1997-01-01', DATE '1999-12-31', DATE '2000-01-01', DATE '2000-12-31'),
  ('2001', DATE '1997-01-01', DATE '2000-12-31', DATE '2001-01-01', DATE '2001-12-31'))"""
ASSIGNED = f"""{STUDY}, {FOLDS_SQL},
assigned AS (SELECT s.*, fold, CASE WHEN session BETWEEN evaluation_start AND evaluation_end THEN 'evaluation' ELSE 'train' END AS role,
  abs(r1) / greatest(v20, 1e-8) AS pred, primary_target AS y FROM study s JOIN folds f
  ON session BETWEEN evaluation_start AND evaluation_end
  OR (session BETWEEN train_start AND train_end AND next_session < evaluation_start)),
cuts AS (SELECT fold, quantile_cont(v20, 1 / 3.0) AS sl, quantile_cont(v20, 2 / 3.0) AS sh, quantile_cont(bv20, 1 / 3.0) AS ml,
  quantile_cont(bv20, 2 / 3.0) AS mh FROM assigned WHERE role = 'train' GROUP BY fold),
scored AS (SELECT a.*, round(pred, 9) AS score, round(1 / (1 + exp(2.2 - 0.8 * pred)), 6) AS p, CASE WHEN y >= 1.5 THEN 1 ELSE 0 END AS hit,
  CASE WHEN 1 / (1 + exp(2.2 - 0.8 * pred)) >= 0.2 THEN 1 ELSE 0 END AS said,
  CASE WHEN v20 <= sl THEN 'LOW' WHEN v20 <= sh THEN 'MIDDLE' ELSE 'HIGH' END AS stock_regime,
  CASE WHEN bv20 <= ml THEN 'LOW' WHEN bv20 <= mh THEN 'MIDDLE' ELSE 'HIGH' END AS market_regime
  FROM assigned a JOIN cuts USING (fold) WHERE role = 'evaluation')"""


def study(spark, d):
    return stored(spark, d, "study", lambda s, d: features.persistence(features.study_rows(A.panel(s, d), cal_of(s, d))))


def assigned(spark, d):
    rows = study(spark, d)
    return calendars.assign_folds(rows, calendars.yearly_folds(spark, YEARS, "1997-01-01"))


def scored(spark, d):
    return stored(spark, d, "scored", scored_rows)


def scored_rows(spark, d):
    """Evaluation rows of all folds with forecast, probability, outcome and the regimes of their fold's training rows."""
    rows = assigned(spark, d).withColumnsRenamed({"volatility_log_return_20": "v20", "benchmark_volatility_log_return_20": "bv20"})
    cuts = stats.fold_tertiles(rows, ["v20", "bv20"])
    p = 1 / (1 + F.exp(2.2 - 0.8 * F.col("prediction")))
    return rows.where("role = 'evaluation'").join(F.broadcast(cuts), "fold").withColumns({
        "y": F.col("primary"), "score": F.round("prediction", 9), "p": F.round(p, 6), "hit": (F.col("primary") >= 1.5).cast("int"),
        "said": (p >= 0.2).cast("int"), "stock_regime": calendars.regime(F.col("v20"), F.col("v20_low"), F.col("v20_high")),
        "market_regime": calendars.regime(F.col("bv20"), F.col("bv20_low"), F.col("bv20_high")),
    })


def q(name, sql):
    return query(name, f"WITH {ASSIGNED} {sql}")


@q("c9_assign_folds", "SELECT fold, role, count(*) AS n, min(session) AS first_session, max(session) AS last_session FROM assigned GROUP BY 1, 2")
def c9(spark, d):
    return assigned(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))


@q("d15_lift", """, k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, session, ticker) AS rn, count(*) OVER (PARTITION BY fold) AS n0 FROM scored)
SELECT fold, count(*) AS n, round(avg(y), 6) AS mean, round(avg(CASE WHEN rn <= ceil(n0 * 0.1) THEN y END) / avg(y), 6) AS lift FROM k GROUP BY fold""")
def d15(spark, d):
    return stats.lift(scored(spark, d), "y", "score", 0.1, ["fold"]).select("fold", "n", r("mean"), r("lift"))


@q("d6_linear_quantile", "SELECT fold, round(quantile_cont(y, 0.9), 6) AS quantile FROM assigned WHERE role = 'train' GROUP BY fold")
def d6(spark, d):
    return stats.linear_quantile(assigned(spark, d).where("role = 'train'"), "primary", 0.9, ["fold"]).select("fold", r("quantile"))


@q("d7_fold_tertiles", "SELECT fold, round(sl, 8) AS v20_low, round(sh, 8) AS v20_high, round(ml, 8) AS bv20_low, round(mh, 8) AS bv20_high FROM cuts")
def d7(spark, d):
    rows = assigned(spark, d).withColumnsRenamed({"volatility_log_return_20": "v20", "benchmark_volatility_log_return_20": "bv20"})
    cuts = stats.fold_tertiles(rows, ["v20", "bv20"])
    return cuts.select("fold", *(r(c, 8) for c in cuts.columns[1:]))


CONFUSION = """sum(CASE WHEN hit = 1 AND said2 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN hit = 0 AND said2 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN hit = 1 AND NOT said2 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN hit = 0 AND NOT said2 THEN 1 ELSE 0 END) AS tn"""
RATIOS = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc"""


@q("d8_binary_metrics", f""", c AS (SELECT fold, count(*) AS n, avg((p - hit) ** 2) AS brier, {CONFUSION} FROM (SELECT *, p >= 0.2 AS said2 FROM scored) GROUP BY fold),
m AS (SELECT *, {RATIOS} FROM c),
st AS (SELECT fold, p, sum(hit) AS pos, sum(1 - hit) AS neg FROM scored GROUP BY 1, 2),
cu AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp FROM st WINDOW w AS (PARTITION BY fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT fold, sum(neg * (ctp - pos / 2)) / (sum(pos) * sum(neg)) AS auc, sum(pos * ctp / (ctp + cfp)) / sum(pos) AS ap FROM cu GROUP BY fold)
SELECT fold, n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / n, 6) AS accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1, round(mcc, 6) AS mcc,
  round((recall + specificity) / 2, 6) AS balanced_accuracy, round(brier, 6) AS brier, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision
FROM m JOIN k USING (fold)""")
def d8(spark, d):
    rows = stats.binary_metrics(scored(spark, d), "hit", "p", 0.2, ["fold"])
    keep = ["fold", "n", "tp", "fp", "fn", "tn"]
    return rows.select(*keep, *(r(c) for c in rows.columns if c not in keep))


@q("d9_calibration", """, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(hit) AS rt FROM scored GROUP BY 1)
SELECT g.i AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(rt, 6) AS rate FROM range(10) g(i) LEFT JOIN b ON b.bin = g.i""")
def d9(spark, d):
    return stats.calibration(scored(spark, d), "hit", "p", 10).select("bin", "n", r("mean_p"), r("rate"))


@q("d10_prob_buckets", """, e(low, high) AS (VALUES (0.0, 0.1), (0.1, 0.15), (0.15, 0.3), (0.3, 0.99), (0.99, 1.0))
SELECT e.low, e.high, count(p) AS n, round(avg(hit), 6) AS rate FROM e LEFT JOIN (SELECT p, hit FROM scored) ON p >= e.low
  AND (p < e.high OR (e.high = 1.0 AND p = 1.0)) GROUP BY 1, 2""")
def d10(spark, d):
    return stats.prob_buckets(scored(spark, d), "hit", "p", [0.0, 0.1, 0.15, 0.3, 0.99, 1.0]).select("low", "high", "n", r("rate"))


TABLE = f"""tt AS (SELECT regime, step, step / 100 AS threshold, {CONFUSION} FROM (SELECT stock_regime AS regime, hit, t.step,
  floor(round(p * 1000000) / 10000) >= t.step AS said2 FROM scored, range(1, 51) t(step)) GROUP BY 1, 2),
tm AS (SELECT *, {RATIOS} FROM tt)"""


def regime_table(spark, d):
    rows = scored(spark, d).withColumn("regime", F.col("stock_regime"))
    return stats.threshold_table(rows, "hit", "p", ["regime"])


@q("d11_threshold_table", f""", {TABLE} SELECT regime, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  CAST(tn AS BIGINT) AS tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mcc, 6) AS mcc FROM tm""")
def d11(spark, d):
    return regime_table(spark, d).select("regime", "threshold", "tp", "fp", "fn", "tn", r("precision"), r("recall"), r("mcc"))


@q("d12_class_report", """, s AS (SELECT stock_regime AS t, market_regime AS m FROM scored), l AS (SELECT DISTINCT t AS label FROM s UNION SELECT DISTINCT m FROM s),
k AS (SELECT label, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE t = label AND m = label) AS tp,
  count(*) FILTER (WHERE t <> label AND m = label) AS fp FROM l, s GROUP BY label)
SELECT label, support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(support + tp + fp, 0), 0), 6) AS f1 FROM k""")
def d12(spark, d):
    return stats.class_report(scored(spark, d), "stock_regime", "market_regime").select("label", "support", r("precision"), r("recall"), r("f1"))


@q("d13_regression_metrics", """SELECT fold, count(*) AS n, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) ** 2)), 6) AS rmse,
  round(1 - sum((pred - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM scored GROUP BY fold""")
def d13(spark, d):
    return stats.regression_metrics(scored(spark, d), "y", "prediction", ["fold"]).select("fold", "n", r("mae"), r("rmse"), r("r2"))


SPEARMAN = """rk AS (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS a,
  rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2 AS b FROM scored),
rho AS (SELECT fold, corr(a, b) AS rho FROM rk GROUP BY fold)"""


@q("d14_spearman", f", {SPEARMAN} SELECT fold, round(rho, 6) AS rho, FALSE AS constant FROM rho")
def d14(spark, d):
    return stats.spearman(scored(spark, d), "score", "y", ["fold"]).select("fold", r("rho"), "constant")


DECILES = """dz AS (SELECT *, CAST(10 - least(floor((row_number() OVER (PARTITION BY fold ORDER BY score DESC, session, ticker) - 1) * 10
  / count(*) OVER (PARTITION BY fold)), 9) AS INTEGER) AS decile FROM scored)"""


@q("e18_assign_deciles", f", {DECILES} SELECT fold, ticker, session, decile FROM dz")
def e18(spark, d):
    return stats.assign_deciles(scored(spark, d), "score", ["fold"]).select("fold", "ticker", "session", "decile")


@q("d16_decile_summary", f""", {DECILES}, g AS (SELECT fold, decile, count(*) AS n, avg(score) AS ms, avg(y) AS my, quantile_cont(y, 0.5) AS md, stddev_samp(y) AS sd
  FROM dz GROUP BY 1, 2) SELECT fold, decile, n, round(ms, 6) AS mean_score, round(my, 6) AS mean_y, round(md, 6) AS median_y, round(sd, 6) AS std_y,
  my >= lag(my) OVER (PARTITION BY fold ORDER BY decile) AS non_decreasing FROM g""")
def d16(spark, d):
    rows = stats.decile_summary(stats.assign_deciles(scored(spark, d), "score", ["fold"]), "y", "score", ["fold"])
    return rows.select("fold", "decile", "n", r("mean_score"), r("mean_y"), r("median_y"), r("std_y"), "non_decreasing")


@q("d17_grouped_metrics", """SELECT market_regime, fold, count(*) AS n, round(avg(abs(pred - y)), 6) AS mae,
  CASE WHEN count(*) >= 200 THEN 'OK' ELSE 'INSUFFICIENT' END AS status FROM scored GROUP BY 1, 2""")
def d17(spark, d):
    rows = stats.regression_metrics(scored(spark, d), "y", "prediction", ["market_regime", "fold"])
    return rows.select("market_regime", "fold", "n", r("mae"), F.when(F.col("n") >= 200, "OK").otherwise("INSUFFICIENT").alias("status"))


@q("d18_error_distribution", """SELECT market_regime, count(*) FILTER (WHERE hit = 1 AND said = 1) AS "TP", count(*) FILTER (WHERE hit = 0 AND said = 1) AS "FP",
  count(*) FILTER (WHERE hit = 1 AND said = 0) AS "FN", count(*) FILTER (WHERE hit = 0 AND said = 0) AS "TN" FROM scored GROUP BY 1""")
def d18(spark, d):
    kind = F.concat(F.when(F.col("hit") == F.col("said"), "T").otherwise("F"), F.when(F.col("said") == 1, "P").otherwise("N"))
    names = ["TP", "FP", "FN", "TN"]
    return scored(spark, d).withColumn("kind", kind).groupBy("market_regime").pivot("kind", names).count().fillna(0, names)


SEPARATION = """count(*) FILTER (WHERE said = 1) AS n_high, count(*) FILTER (WHERE said = 0) AS n_normal, avg(next_abs) FILTER (WHERE said = 1) AS mh,
  avg(next_abs) FILTER (WHERE said = 0) AS mo, quantile_cont(next_abs, 0.5) FILTER (WHERE said = 1) AS dh, quantile_cont(next_abs, 0.5) FILTER (WHERE said = 0) AS dn"""
SEP_OUT = """n_high, n_normal, round(mh, 6) AS mean_high, round(mo, 6) AS mean_normal, round(dh, 6) AS median_high, round(dn, 6) AS median_normal,
  CASE WHEN n_high >= 30 AND n_normal >= 30 THEN round(mh - mo, 6) END AS difference, CASE WHEN n_high >= 30 AND n_normal >= 30 THEN 'OK' ELSE 'INSUFFICIENT' END AS status"""


def sep(rows, by):
    out = stats.separation(rows, "next_abs", "said", by, 30)
    return out.select(*by, "n_high", "n_normal", *map(r, ["mean_high", "mean_normal", "median_high", "median_normal", "difference"]), "status")


@q("d19_separation", f", g AS (SELECT fold, {SEPARATION} FROM scored GROUP BY fold) SELECT fold, {SEP_OUT} FROM g")
def d19(spark, d):
    return sep(scored(spark, d), ["fold"])


@q("d20_stratified_diff", f", g AS (SELECT ticker, stock_regime, {SEPARATION} FROM scored GROUP BY 1, 2) SELECT ticker, stock_regime, {SEP_OUT} FROM g")
def d20(spark, d):
    return sep(scored(spark, d), ["ticker", "stock_regime"])


SHARES = """sh AS (SELECT stock_regime, sum(said) / (SELECT sum(said) FROM scored) AS a, sum(1 - said) / (SELECT sum(1 - said) FROM scored) AS b FROM scored GROUP BY 1)"""


@q("d21_composition", f", {SHARES} SELECT round(sum(abs(a - b)) / 2, 6) AS distance FROM sh")
def d21(spark, d):
    return stats.total_variation(stats.composition(scored(spark, d), "stock_regime", "said")).select(r("distance"))


@q("d22_standardise", """, c AS (SELECT stock_regime, count(*) AS n, avg(next_abs) FILTER (WHERE said = 1) - avg(next_abs) FILTER (WHERE said = 0) AS df FROM scored GROUP BY 1),
o AS (SELECT avg(next_abs) FILTER (WHERE said = 1) - avg(next_abs) FILTER (WHERE said = 0) AS ob FROM scored),
s AS (SELECT sum(n * df) / sum(n) AS st, min(df) AS lo, max(df) AS hi FROM c WHERE df IS NOT NULL)
SELECT round(ob, 6) AS observed, round(st, 6) AS standardised, round(ob - st, 6) AS composition, (lo > 0 AND ob < 0) OR (hi < 0 AND ob > 0) AS reversal FROM o, s""")
def d22(spark, d):
    rows = stats.standardise(scored(spark, d), "stock_regime", "next_abs", "said")
    return rows.select(r("observed"), r("standardised"), r("composition"), "reversal")


@q("d23_simpson", """, k AS (SELECT fold, stock_regime, avg(next_abs) FILTER (WHERE said = 1) - avg(next_abs) FILTER (WHERE said = 0) AS df FROM scored GROUP BY 1, 2)
SELECT fold, count(*) FILTER (WHERE df > 0) AS n_positive, count(*) FILTER (WHERE df < 0) AS n_negative, bool_and(df > 0) AS all_positive FROM k GROUP BY fold""")
def d23(spark, d):
    rows = stats.separation(scored(spark, d), "next_abs", "said", ["fold", "stock_regime"])
    return rows.groupBy("fold").agg(
        F.count_if(F.col("difference") > 0).alias("n_positive"), F.count_if(F.col("difference") < 0).alias("n_negative"),
        F.bool_and(F.col("difference") > 0).alias("all_positive"),
    )


@q("d32_fold_summary", f""", {SPEARMAN}, m AS (SELECT fold, avg(abs(pred - y)) AS mae FROM scored GROUP BY fold)
SELECT round(avg(mae), 6) AS mean_mae, round(quantile_cont(mae, 0.5), 6) AS median_mae, round(avg(rho), 6) AS mean_rho, round(min(rho), 6) AS worst_rho FROM m JOIN rho USING (fold)""")
def d32(spark, d):
    rows = scored(spark, d)
    both = stats.regression_metrics(rows, "y", "prediction", ["fold"]).join(stats.spearman(rows, "score", "y", ["fold"]), "fold")
    return both.agg(F.avg("mae").alias("mean_mae"), F.percentile("mae", F.lit(0.5)).alias("median_mae"), F.avg("rho").alias("mean_rho"), F.min("rho").alias("worst_rho")).select(
        r("mean_mae"), r("median_mae"), r("mean_rho"), r("worst_rho"))


@q("e19_ecdf_band", """, ref AS (SELECT score FROM scored WHERE fold = '1999'), u AS (SELECT DISTINCT score FROM scored WHERE fold = '2000'),
e AS (SELECT u.score, (SELECT count(*) FROM ref WHERE ref.score <= u.score) / (SELECT count(*) FROM ref) AS pc FROM u)
SELECT ticker, session, round(pc, 6) AS percentile, CASE WHEN pc >= 0.95 THEN 'P95' WHEN pc >= 0.80 THEN 'P80' WHEN pc >= 0.50 THEN 'P50' ELSE 'BELOW' END AS band
FROM scored JOIN e USING (score) WHERE fold = '2000'""")
def e19(spark, d):
    rows = scored(spark, d).select("fold", "ticker", "session", "score")
    return stats.ecdf_band(rows.where("fold = '2000'"), "score", rows.where("fold = '1999'")).select("ticker", "session", r("percentile"), "band")


@q("e24_persistence", "SELECT fold, ticker, session, round(pred, 6) AS prediction FROM assigned WHERE role = 'evaluation'")
def e24(spark, d):
    return assigned(spark, d).where("role = 'evaluation'").select("fold", "ticker", "session", r("prediction"))


@q("e20_round_robin", """, k AS (SELECT ticker, session, row_number() OVER (PARTITION BY ticker ORDER BY session) AS n FROM scored)
SELECT ticker, session FROM k ORDER BY n, ticker, session LIMIT 250""")
def e20(spark, d):
    rows = scored(spark, d)
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("ticker").orderBy("session"))
    return rows.select("ticker", "session", n.alias("n")).orderBy("n", "ticker", "session").limit(250).drop("n")


@q("f5_operating_modes", f""", ta AS (SELECT step, step / 100 AS threshold, {CONFUSION} FROM (SELECT hit, t.step, floor(round(p * 1000000) / 10000) >= t.step AS said2
  FROM scored, range(1, 51) t(step)) GROUP BY 1), tb AS (SELECT *, {RATIOS} FROM ta),
pick AS (SELECT 'screening' AS mode, threshold, row_number() OVER (ORDER BY round(precision, 9) DESC, threshold) AS k FROM tb WHERE recall >= 0.8
  UNION ALL SELECT 'balanced', threshold, row_number() OVER (ORDER BY round(mcc, 9) DESC, threshold) FROM tb WHERE recall >= 0.5 AND specificity >= 0.5
  UNION ALL SELECT 'precise', threshold, row_number() OVER (ORDER BY round(recall, 9) DESC, threshold) FROM tb WHERE precision >= 0.9)
SELECT m.mode, p.threshold, CASE WHEN p.threshold IS NULL THEN 'INCONCLUSIVE' ELSE 'SELECTED' END AS status
FROM (VALUES ('screening'), ('balanced'), ('precise')) m(mode) LEFT JOIN (SELECT * FROM pick WHERE k = 1) p USING (mode)""")
def f5(spark, d):
    table = stats.threshold_table(scored(spark, d).withColumn("one", F.lit(1)), "hit", "p", ["one"])
    best = lambda c: [F.desc(F.round(c, 9)), F.col("threshold")]
    modes = stats.operating_modes(table, {
        "screening": (F.col("recall") >= 0.8, best("precision")),
        "balanced": ((F.col("recall") >= 0.5) & (F.col("specificity") >= 0.5), best("mcc")), "precise": (F.col("precision") >= 0.9, best("recall")),
    })
    return modes.select("mode", "threshold", "status")


@q("f6_select_threshold", f""", {TABLE} SELECT regime, threshold, round(mcc, 6) AS mcc FROM (SELECT *, row_number() OVER (PARTITION BY regime
  ORDER BY round(mcc, 9) DESC, round(precision, 9) DESC, abs(threshold - 0.5), threshold) AS k FROM tm WHERE recall >= 0.3) WHERE k = 1""")
def f6(spark, d):
    table = regime_table(spark, d).where("recall >= 0.3")
    order = [F.desc(F.round("mcc", 9)), F.desc(F.round("precision", 9)), F.abs(F.col("threshold") - 0.5), F.col("threshold")]
    return stats.first_by(table, ["regime"], order).select("regime", "threshold", r("mcc"))


@q("f7_regime_policy", f""", {TABLE}, ok AS (SELECT * FROM tm WHERE recall >= 0.3 AND specificity >= 0.3),
tri AS (SELECT a.threshold AS threshold_low, b.threshold AS threshold_middle, c.threshold AS threshold_high,
  greatest(greatest(a.recall, b.recall, c.recall) - least(a.recall, b.recall, c.recall), greatest(a.specificity, b.specificity, c.specificity)
  - least(a.specificity, b.specificity, c.specificity)) AS unevenness, a.tp + b.tp + c.tp AS tp, a.fp + b.fp + c.fp AS fp, a.fn + b.fn + c.fn AS fn, a.tn + b.tn + c.tn AS tn
  FROM ok a, ok b, ok c WHERE a.regime = 'LOW' AND b.regime = 'MIDDLE' AND c.regime = 'HIGH'), x AS (SELECT *, {RATIOS} FROM tri)
SELECT threshold_low, threshold_middle, threshold_high, round(unevenness, 6) AS unevenness, round(mcc, 6) AS mcc, round(f1, 6) AS f1 FROM x
ORDER BY round(x.unevenness, 9), round(x.mcc, 9) DESC, round(x.f1, 9) DESC, threshold_low, threshold_middle, threshold_high LIMIT 1""")
def f7(spark, d):
    found = stats.regime_policy(regime_table(spark, d), 0.3, 0.3)
    return found.select("threshold_low", "threshold_middle", "threshold_high", r("unevenness"), r("mcc"), r("f1"))


@q("d24_kappa", """, t AS (SELECT count(*) AS n, avg(CASE WHEN stock_regime = market_regime THEN 1.0 ELSE 0 END) AS o FROM scored),
e AS (SELECT sum(a.c * b.c) / (SELECT n * n FROM t) AS e FROM (SELECT stock_regime AS l, count(*) AS c FROM scored GROUP BY 1) a
  JOIN (SELECT market_regime AS l, count(*) AS c FROM scored GROUP BY 1) b USING (l))
SELECT n, round(o, 6) AS agreement, round((o - e) / (1 - e), 6) AS kappa FROM t, e""")
def d24(spark, d):
    return stats.kappa(scored(spark, d), "stock_regime", "market_regime").select("n", r("agreement"), r("kappa"))


LEVELS = ["LOW", "MIDDLE", "HIGH"]


@q("k4_user_aggregates", """, c AS (SELECT fold, count(*) AS n, quantile_cont(y, 0.9) AS q, avg(CASE WHEN score <= 0.5 THEN 1.0 ELSE 0.0 END) AS e, avg((stock_regime = market_regime)::INT) AS o FROM scored GROUP BY fold),
s AS (SELECT fold, market_regime AS l, count(*) AS k FROM scored GROUP BY 1, 2), t AS (SELECT fold, stock_regime AS l, count(*) AS k FROM scored GROUP BY 1, 2),
h AS (SELECT fold, 0 - sum(k / n * ln(k / n)) / ln(3) AS h FROM t JOIN c USING (fold) GROUP BY fold),
x AS (SELECT s.fold, sum(s.k * t.k / (n * n)) AS x FROM s JOIN t ON s.fold = t.fold AND s.l = t.l JOIN c ON c.fold = s.fold GROUP BY s.fold)
SELECT fold, round(q, 6) AS quantile, round(e, 6) AS ecdf, round(h, 6) AS entropy, round((o - coalesce(x, 0)) / (1 - coalesce(x, 0)), 6) AS kappa FROM c JOIN h USING (fold) LEFT JOIN x USING (fold)""")
def k4(spark, d):
    out = scored(spark, d).groupBy("fold").agg(
        G.quantile("y", 0.9).alias("quantile"), G.ecdf("score", 0.5).alias("ecdf"), G.entropy("stock_regime", LEVELS).alias("entropy"),
        G.cohen_kappa("stock_regime", "market_regime", LEVELS).alias("kappa"))
    return out.select("fold", *map(r, ("quantile", "ecdf", "entropy", "kappa")))


@q("i1_fit_scaler", """SELECT fold, round(avg(v20), 8) AS mean_v20, round(stddev_pop(v20), 8) AS scale_v20, round(avg(r1), 8) AS mean_r1,
  round(stddev_pop(r1), 8) AS scale_r1 FROM assigned WHERE role = 'train' GROUP BY fold""")
def i1(spark, d):
    rows = assigned(spark, d).where("role = 'train'").withColumnRenamed("volatility_log_return_20", "v20")
    return rows.groupBy("fold").agg(*(F.round(f(c), 8).alias(f"{n}_{c}") for c in ("v20", "r1") for n, f in (("mean", F.avg), ("scale", F.stddev_pop))))


RIDGE = """z AS (SELECT fold, count(*) AS n, avg(v20) AS m1, stddev_pop(v20) AS s1, avg(rsi) AS m2, stddev_pop(rsi) AS s2, avg(ln(1 + y)) AS t0,
  corr(v20, rsi) AS rho, covar_pop(v20, ln(1 + y)) AS c1, covar_pop(rsi, ln(1 + y)) AS c2 FROM assigned WHERE role = 'train' GROUP BY fold),
b AS (SELECT *, ((n + 100) * n * c1 / s1 - n * rho * n * c2 / s2) / ((n + 100) ** 2 - (n * rho) ** 2) / s1 AS w1,
  ((n + 100) * n * c2 / s2 - n * rho * n * c1 / s1) / ((n + 100) ** 2 - (n * rho) ** 2) / s2 AS w2 FROM z)"""
RIDGE_COLUMNS = ["volatility_log_return_20", "rsi_14"]


@q("i2_ridge_two_features", f""", {RIDGE} SELECT fold, round(w1, 6) AS b1, round(w2, 8) AS b2, round(t0 - w1 * m1 - w2 * m2, 6) AS intercept,
  round(avg(abs(greatest(exp(t0 - w1 * m1 - w2 * m2 + w1 * v20 + w2 * rsi) - 1, 0) - y)), 6) AS mae FROM assigned JOIN b USING (fold)
  WHERE role = 'evaluation' GROUP BY fold, w1, w2, t0, m1, m2""")
def i2(spark, d):
    rows = assigned(spark, d)
    models = fitted.fit_ridge(rows.where("role = 'train'"), RIDGE_COLUMNS, F.log1p("primary"), [100.0], ["fold"])
    out = fitted.predict_ridge(rows.where("role = 'evaluation'").drop("prediction"), models, RIDGE_COLUMNS, ["fold"])
    error = out.groupBy("fold").agg(F.avg(F.abs(F.col("prediction") - F.col("primary"))).alias("mae"))
    b = F.col("coefficients")
    return models.join(error, "fold").select("fold", F.round(b[0], 6).alias("b1"), F.round(b[1], 8).alias("b2"), r("intercept"), r("mae"))


ALPHAS = [0.1, 1.0, 10.0, 100.0]


NESTED_FOLDS = [nested.Fold(str(y), date(y, 1, 1), date(y, 12, 31)) for y in (2000, 2001)]
NESTED_START = date(1997, 1, 1)


def nested_rows(spark, d):
    return study(spark, d).withColumns({"y": F.col("primary"), "naive": F.col("prediction")}).drop("prediction")


def nested_study(spark, d, settings, columns):
    """The last three half-years before each fold are its inner periods; the study has too few years for whole ones."""
    store = lambda df, name: written(df, work_dir(spark, name))
    rows = nested_rows(spark, d)
    return nested.nested_evaluation(rows, NESTED_FOLDS, settings, columns, NESTED_START, store, blocks=3, months=6)


def nested_metrics(spark, d, settings):
    columns = [c for c in features.FEATURE_NAMES if c != "zero_volume_flag"]
    found = nested_study(spark, d, settings, columns).metrics
    return found.select("fold", "model", "params", "n", r("mae"), r("rmse"), r("r2"), r("rho"), "constant")


NAIVE = nested.Setting("naive", "", 0)


@query("i7_nested_ridge")
def i7(spark, d):
    """The persistence forecast and ridge on all features: settings chosen inside, metrics of the outer rows."""
    return nested_metrics(spark, d, [NAIVE, *nested.ridge_settings(ALPHAS)])


@query("i7_nested_models")
def i7_models(spark, d):
    """With boosted trees of two depths beside them."""
    trees = [nested.boosted_setting(ML_COLUMNS, 10, depth, 20, 0.1) for depth in (2, 3)]
    return nested_metrics(spark, d, [NAIVE, *nested.ridge_settings(ALPHAS), *trees])


NESTED_SQL = f"""WITH {STUDY}, outers(fold, s, e) AS (VALUES ('2000', DATE '2000-01-01', DATE '2000-12-31'), ('2001', DATE '2001-01-01', DATE '2001-12-31')),
inners AS (SELECT fold, CAST(o.s - to_months(6 * k) AS DATE) AS s, CAST(o.s - to_months(6 * (k - 1)) - INTERVAL 1 DAY AS DATE) AS e FROM outers o, range(1, 4) t(k)),
periods AS (SELECT s, e FROM outers UNION SELECT s, e FROM inners),
rows0 AS (SELECT *, primary_target AS y, abs(r1) / greatest(v20, 1e-8) AS naive, ln(1 + primary_target) AS t FROM study WHERE session >= DATE '1997-01-01' AND primary_target IS NOT NULL),
z AS (SELECT s, count(*) AS n, avg(v20) AS m1, stddev_pop(v20) AS s1, avg(rsi) AS m2, stddev_pop(rsi) AS s2, avg(t) AS t0,
  corr(v20, rsi) AS rho, covar_pop(v20, t) AS c1, covar_pop(rsi, t) AS c2 FROM (SELECT DISTINCT s FROM periods), rows0 WHERE next_session < s GROUP BY s),
b AS (SELECT *, ((n + al) * n * c1 / s1 - n * rho * n * c2 / s2) / ((n + al) ** 2 - (n * rho) ** 2) / s1 AS w1,
  ((n + al) * n * c2 / s2 - n * rho * n * c1 / s1) / ((n + al) ** 2 - (n * rho) ** 2) / s2 AS w2 FROM z, (VALUES (0.1), (1.0), (10.0), (100.0)) a(al)),
said AS (SELECT p.s, p.e, 'naive' AS model, '' AS params, 0.0 AS complexity, ticker, session, next_session, y, round(greatest(naive, 0), 12) AS prediction
    FROM rows0 JOIN periods p ON session BETWEEN p.s AND p.e
  UNION ALL SELECT p.s, p.e, 'ridge', 'alpha=' || CAST(CAST(al AS DOUBLE) AS VARCHAR), -al, ticker, session, next_session, y,
    round(greatest(exp(t0 - w1 * m1 - w2 * m2 + w1 * v20 + w2 * rsi) - 1, 0), 12) FROM rows0 JOIN periods p ON session BETWEEN p.s AND p.e JOIN b ON b.s = p.s),
rk AS (SELECT *, rank() OVER (PARTITION BY s, e, model, params ORDER BY prediction) + (count(*) OVER (PARTITION BY s, e, model, params, prediction) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY s, e, model, params ORDER BY y) + (count(*) OVER (PARTITION BY s, e, model, params, y) - 1) / 2 AS rb FROM said),
sc AS (SELECT s, e, model, params, any_value(complexity) AS complexity, corr(ra, rb) AS rho, avg(abs(prediction - y)) AS mae FROM rk GROUP BY 1, 2, 3, 4),
ev AS (SELECT fold, model, params, any_value(complexity) AS complexity, avg(rho) AS mean_rho, avg(mae) AS mae, min(rho) AS worst_rho FROM sc JOIN inners USING (s, e) GROUP BY 1, 2, 3),
ch AS (SELECT *, row_number() OVER (PARTITION BY fold, model ORDER BY round(mean_rho, 9) DESC, round(mae, 9), round(worst_rho, 9) DESC, complexity, params) AS k FROM ev)"""


@query("i7_nested_oof", f"""{NESTED_SQL} SELECT fold, model, params, ticker, session, next_session, round(y, 6) AS y, round(prediction, 6) AS prediction
  FROM ch JOIN outers USING (fold) JOIN said USING (s, e, model, params) WHERE k = 1""")
def i7_oof(spark, d):
    """The outer rows of the protocol with two features, for which the ridge has a closed form."""
    found = nested_study(spark, d, [NAIVE, *nested.ridge_settings(ALPHAS)], RIDGE_COLUMNS).oof
    return found.select("fold", "model", "params", "ticker", "session", "next_session", r("y"), r("prediction"))


@query("i7_nested_evidence", f"""{NESTED_SQL} SELECT fold, model, params, round(mean_rho, 6) AS mean_rho, round(mae, 6) AS mae, round(worst_rho, 6) AS worst_rho, k = 1 AS chosen FROM ch""")
def i7_evidence(spark, d):
    found = nested_study(spark, d, [NAIVE, *nested.ridge_settings(ALPHAS)], RIDGE_COLUMNS)
    chosen = found.metrics.select("fold", "model", "params", F.lit(True).alias("chosen"))
    rows = found.evidence.join(F.broadcast(chosen), ["fold", "model", "params"], "left")
    return rows.select("fold", "model", "params", r("mean_rho"), r("mae"), r("worst_rho"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("i9_prequential_platt")
def i9(spark, d):
    rows = scored(spark, d).select(F.col("fold").cast("int").alias("fold"), "ticker", "session", "p", "hit")
    out = fitted.prequential_platt(rows, "p", "hit", list(YEARS))
    per = out.groupBy("fold").agg(
        F.round(F.first("slope"), 6).alias("slope"), F.round(F.avg((F.col("p") - F.col("hit")) ** 2), 6).alias("brier"),
        F.round(F.avg((F.col("calibrated") - F.col("hit")) ** 2), 6).alias("brier_calibrated"),
    )
    return per.crossJoin(F.broadcast(fitted.adoption(out, "p", "hit")))


@q("i10_cluster_bootstrap", """, s AS (SELECT fold, session, sum(abs(pred - y)) AS e, count(*) AS c FROM scored GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY session) - 1 AS pos, count(*) OVER (PARTITION BY fold) AS s FROM s),
dr AS (SELECT fold, rep, CAST('0x' || substr(md5('7|' || rep || '|' || fold || '|' || pos), 1, 8) AS BIGINT) % s AS hit FROM n, range(200) t(rep)),
w AS (SELECT fold, rep, sum(e) / sum(c) AS mae FROM dr JOIN n USING (fold) WHERE n.pos = dr.hit GROUP BY 1, 2)
SELECT fold, (SELECT round(sum(e) / sum(c), 6) FROM s WHERE s.fold = w.fold) AS mae, round(quantile_cont(mae, 0.025), 6) AS low,
  round(quantile_cont(mae, 0.975), 6) AS high FROM w GROUP BY fold""")
def i10(spark, d):
    return stats.cluster_bootstrap(scored(spark, d), "y", "prediction", 200, 7).select("fold", r("mae"), r("low"), r("high"))


REPLICATES = 200


@q("i10_rank_bootstrap", f""", sz AS (SELECT fold, session, row_number() OVER (PARTITION BY fold ORDER BY session) - 1 AS pos, count(*) OVER (PARTITION BY fold) AS s
  FROM (SELECT DISTINCT fold, session FROM scored)),
dr AS (SELECT fold, rep, CAST('0x' || substr(md5('7|' || rep || '|' || fold || '|' || pos), 1, 8) AS BIGINT) % s AS pos FROM sz, range({REPLICATES}) t(rep)),
w AS (SELECT fold, rep, session, count(*) AS w FROM dr JOIN sz USING (fold, pos) GROUP BY 1, 2, 3),
dc AS (SELECT *, 10 - (rn - 1) * 10 // n0 AS decile FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, session, ticker) AS rn, count(*) OVER (PARTITION BY fold) AS n0 FROM scored)),
x AS (SELECT fold, rep, w, pred, y, decile, sum(w) OVER (PARTITION BY fold, rep ORDER BY score) - sum(w) OVER (PARTITION BY fold, rep, score) / 2 + 0.5 AS a,
  sum(w) OVER (PARTITION BY fold, rep ORDER BY y) - sum(w) OVER (PARTITION BY fold, rep, y) / 2 + 0.5 AS b,
  sum(w) OVER (PARTITION BY fold, rep ORDER BY rn ROWS UNBOUNDED PRECEDING) - w AS before, ceil(0.1 * sum(w) OVER (PARTITION BY fold, rep)) AS k FROM dc JOIN w USING (fold, session)),
f AS (SELECT fold, rep, sum(w * abs(pred - y)) / sum(w) AS mae, sqrt(sum(w * (pred - y) ** 2) / sum(w)) AS rmse,
  (sum(w * a * b) - sum(w * a) * sum(w * b) / sum(w)) / sqrt((sum(w * a * a) - sum(w * a) ** 2 / sum(w)) * (sum(w * b * b) - sum(w * b) ** 2 / sum(w))) AS rho,
  sum(y * greatest(least(w, k - before), 0)) / any_value(k) / (sum(w * y) / sum(w)) AS lift FROM x GROUP BY 1, 2),
m AS (SELECT rep, avg(mae) AS mae, avg(rmse) AS rmse, avg(rho) AS rho, avg(lift) AS lift FROM f GROUP BY rep),
lg AS (SELECT 'mae' AS name, mae AS v FROM m UNION ALL SELECT 'rmse', rmse FROM m UNION ALL SELECT 'rho', rho FROM m UNION ALL SELECT 'lift', lift FROM m
  UNION ALL SELECT 'D' || decile, sum(w * y) / sum(w) FROM x GROUP BY rep, decile)
SELECT name, count(*) AS replicates, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM lg GROUP BY name""")
def i10_ranks(spark, d):
    rows = scored(spark, d).select("fold", "session", "ticker", "y", "prediction", "score")
    out = bootstrap.intervals(*bootstrap.replicates(rows, "y", "prediction", "score", REPLICATES, 7))
    return out.select("name", "replicates", r("mean"), r("low"), r("high"))


@q("i11_ols_hc3", """, g AS (SELECT said, count(*) AS n, avg(next_abs) AS m FROM scored GROUP BY said),
v AS (SELECT said, sum(((next_abs - m) / (1 - 1.0 / n)) ** 2) / (any_value(n) ** 2) AS v FROM scored JOIN g USING (said) GROUP BY said)
SELECT 'said' AS term, round((SELECT m FROM g WHERE said = 1) - (SELECT m FROM g WHERE said = 0), 6) AS coefficient, round(sqrt(sum(v)), 6) AS se FROM v""")
def i11(spark, d):
    rows = fitted.ols_hc3(scored(spark, d), "next_abs", ["said"])
    return rows.where("term = 'said'").select("term", r("coefficient"), r("se"))


@query("i11_ols_fixed_effects")
def i11_fe(spark, d):
    """With regime dummies and the market's deviation as further columns."""
    rows = scored(spark, d).withColumns({"is_high": (F.col("stock_regime") == "HIGH").cast("int"), "is_middle": (F.col("stock_regime") == "MIDDLE").cast("int")})
    out = fitted.ols_hc3(rows, "next_abs", ["said", "is_middle", "is_high", "bv20"])
    return out.select("term", *(r(c) for c in out.columns[1:]))


def by_fold(rows, fit):
    """The evaluation rows of every fold as told by a model that ``fit`` makes from the fold's training rows."""
    out = []
    for fold in map(str, YEARS):
        part = rows.where(F.col("fold") == fold)
        out.append(fit(part.where("role = 'train'")).transform(part.where("role = 'evaluation'")))
    return reduce(DataFrame.unionByName, out)


def evaluated(spark, d, model, columns):
    from pyspark.ml.functions import vector_to_array

    rows = assigned(spark, d).withColumn("label", (F.col("primary") >= 1.5).cast("double")).drop("prediction")
    out = by_fold(fitted.ml_rows(rows, columns), lambda train: model.fit(fitted.balanced(train, "label")))
    return out.withColumn("p", F.round(vector_to_array("probability")[1], 6)).withColumn("hit", F.col("label").cast("int"))


ML_COLUMNS = [c for c in features.FEATURE_NAMES if c != "zero_volume_flag"]


def classified(name, build):
    def run(spark, d):
        out = stats.binary_metrics(evaluated(spark, d, build(), ML_COLUMNS), "hit", "p", 0.5, ["fold"])
        return out.select("fold", "n", r("roc_auc", 4), r("average_precision", 4), r("brier", 4))

    query(name)(run)


def logistic():
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(weightCol="weight", standardization=True, regParam=1e-3)


def forest():
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(weightCol="weight", numTrees=40, maxDepth=6, seed=7)


def boosted():
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(weightCol="weight", maxIter=10, maxDepth=3, seed=7)


classified("i4_logistic", logistic)
classified("i5_forest", forest)
classified("i5_boosted", boosted)


@query("i3_boosted_regression")
def i3(spark, d):
    from pyspark.ml.regression import GBTRegressor

    rows = fitted.ml_rows(assigned(spark, d).drop("prediction").withColumn("label", F.log1p("primary")), ML_COLUMNS)
    out = by_fold(rows, GBTRegressor(maxIter=10, maxDepth=3, seed=7).fit).withColumn("guess", F.greatest(F.expm1("prediction"), F.lit(0.0)))
    return stats.regression_metrics(out, "primary", "guess", ["fold"]).select("fold", "n", r("mae", 4), r("rmse", 4))


@q("i16_regime_counts", "SELECT fold, stock_regime, market_regime, count(*) AS n FROM scored GROUP BY ALL")
def i16(spark, d):
    return scored(spark, d).groupBy("fold", "stock_regime", "market_regime").agg(F.count("*").alias("n"))


@q("l9_ranking_report", f""", {SPEARMAN}, k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, session, ticker) AS rn, count(*) OVER (PARTITION BY fold) AS n0 FROM scored),
m AS (SELECT fold, count(*) AS n, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) ** 2)) AS rmse, avg(CASE WHEN rn <= ceil(n0 * 0.1) THEN y END) / avg(y) AS lift,
  avg(CASE WHEN (rn - 1) * 10 // n0 = 0 THEN y END) AS d10, avg(CASE WHEN (rn - 1) * 10 // n0 = 9 THEN y END) AS d1 FROM k GROUP BY fold),
g AS (SELECT fold, count(*) AS groups, count(*) FILTER (WHERE c >= 30) AS sufficient FROM (SELECT fold, market_regime, count(*) AS c FROM scored GROUP BY 1, 2) GROUP BY fold)
SELECT fold, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(rho, 6) AS rho, round(lift, 6) AS lift, round(d10, 6) AS top_decile, round(d1, 6) AS bottom_decile,
  groups, sufficient FROM m JOIN rho USING (fold) JOIN g USING (fold)""")
def l9(spark, d):
    rows = scored(spark, d)
    out = stats.regression_metrics(rows, "y", "prediction", ["fold"]).join(stats.spearman(rows, "score", "y", ["fold"]), "fold")
    deciles = stats.assign_deciles(rows, "score", ["fold"])
    ends = deciles.groupBy("fold").agg(*(F.avg(F.when(F.col("decile") == k, F.col("y"))).alias(n) for k, n in ((10, "top_decile"), (1, "bottom_decile"))))
    cells = rows.groupBy("fold", "market_regime").agg(F.count("*").alias("c")).groupBy("fold").agg(F.count("*").alias("groups"), F.count_if(F.col("c") >= 30).alias("sufficient"))
    out = out.join(stats.lift(rows, "y", "score", 0.1, ["fold"]).select("fold", "lift"), "fold").join(ends, "fold").join(cells, "fold")
    return out.select("fold", "n", *map(r, ("mae", "rmse", "rho", "lift", "top_decile", "bottom_decile")), "groups", "sufficient")
