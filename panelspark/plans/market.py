"""Queries over bars and the calendar: scans, validation, grids, features and labels."""

from pyspark.sql import functions as F

from panelspark.operators import calendars, features, validate
from panelspark.plans.registering import BARS, query
from panelspark.sources import adapters as A

SPLITS = [("warmup", "1990-01-01", "1997-10-31"), ("train", "1997-11-01", "1999-12-31"),
          ("validation", "2000-01-01", "2000-12-31"), ("test", "2001-01-01", "2001-12-31")]
SPLIT_SQL = """CASE WHEN session BETWEEN '1990-01-01' AND '1997-10-31' THEN 'warmup'
  WHEN session BETWEEN '1997-11-01' AND '1999-12-31' THEN 'train' WHEN session BETWEEN '2000-01-01' AND '2000-12-31'
  THEN 'validation' WHEN session BETWEEN '2001-01-01' AND '2001-12-31' THEN 'test' END"""


def cal_of(spark, d):
    return A.calendar(A.benchmark(spark, d))


def r(c, n=6):
    return F.round(c, n).alias(c)


@query("a1_scan_bars", f"""WITH {BARS} SELECT ticker, session, open, high, low, close, volume, adj FROM bars
WHERE ticker IN ('1', '3', '5') AND session BETWEEN '1998-01-01' AND '1999-12-31'""")
def a1(spark, d):
    return validate.scan_bars(A.bars(spark, d), ["1", "3", "5"], "1998-01-01", "1999-12-31", "lineitem").drop("source")


@query("a10_load_benchmark", f"""WITH {BARS} SELECT session, round(price, 6) AS price FROM bench
WHERE price > 0 AND session BETWEEN '1996-01-01' AND '2000-12-31'""")
def a10(spark, d):
    return validate.load_benchmark(A.benchmark(spark, d), "1996-01-01", "2000-12-31").select("session", r("price"))


SHIFTED = """shifted AS (SELECT ticker, session, open, high, CASE WHEN volume % 5 = 0 THEN high + 1 ELSE low END AS low,
  close, CASE WHEN volume % 7 = 0 THEN -volume ELSE volume END AS volume FROM bars)"""


def shifted(spark, d):
    bars = A.bars(spark, d)
    return bars.withColumns({
        "low": F.when(F.col("volume") % 5 == 0, F.col("high") + 1).otherwise(F.col("low")),
        "volume": F.when(F.col("volume") % 7 == 0, -F.col("volume")).otherwise(F.col("volume")),
    })


@query("b2_bar_issues", f"""WITH {BARS}, {SHIFTED}, i AS (SELECT ticker, session, unnest([
  CASE WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price' END,
  CASE WHEN high < greatest(open, close) THEN 'high_below_body' END, CASE WHEN low > least(open, close) THEN 'low_above_body' END,
  CASE WHEN high < low THEN 'high_below_low' END, CASE WHEN volume < 0 THEN 'negative_volume' END]) AS issue FROM shifted)
SELECT * FROM i WHERE issue IS NOT NULL""")
def b2(spark, d):
    return validate.bar_issues(shifted(spark, d))


@query("b3_quality_report", f"""WITH {BARS}, {SHIFTED}, p AS (SELECT ticker, count(*) AS n_rows, count(DISTINCT session) AS ns,
  min(session) AS first_session, max(session) AS last_session, CAST(sum(CASE WHEN high < low THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid
  FROM shifted GROUP BY ticker)
SELECT ticker, n_rows, first_session, last_session, n_rows - ns AS n_duplicates,
  (SELECT count(*) FROM cal WHERE session BETWEEN first_session AND last_session) - ns AS n_gaps, n_invalid,
  n_rows = ns AND n_invalid = 0 AS passed FROM p""")
def b3(spark, d):
    return validate.quality_report(shifted(spark, d), cal_of(spark, d))


@query("b4_split_counts", f"""WITH {BARS} SELECT {SPLIT_SQL} AS split, count(*) AS n FROM bars GROUP BY 1""")
def b4(spark, d):
    return A.bars(spark, d).groupBy(validate.split_for(F.col("session"), SPLITS).alias("split")).agg(F.count("*").alias("n"))


@query("b5_information_cutoff", f"""WITH {BARS} SELECT session,
  strftime(session + INTERVAL 13 HOUR + INTERVAL 30 MINUTE - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS cutoff FROM cal""")
def b5(spark, d):
    cutoff = validate.information_cutoff(F.col("session"), "Asia/Taipei", 13, 30)
    return cal_of(spark, d).select("session", F.date_format(cutoff, "yyyy-MM-dd HH:mm:ss").alias("cutoff"))


@query("b8_duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def b8(spark, d):
    return validate.duplicate_keys(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c4_candidate_grid", f"""WITH {BARS}, t AS (SELECT DISTINCT ticker FROM bars)
SELECT t.ticker, c.session, c.idx, b.close, b.volume FROM t CROSS JOIN cal c LEFT JOIN bars b ON b.ticker = t.ticker AND b.session = c.session""")
def c4(spark, d):
    return calendars.candidate_grid(A.bars(spark, d), cal_of(spark, d)).select("ticker", "session", "idx", "close", "volume")


@query("c5_next_session", f"WITH {BARS} SELECT session, next_session, idx FROM cal")
def c5(spark, d):
    return cal_of(spark, d).select("session", "next_session", "idx")


@query("c10_session_gaps", f"""WITH {BARS}, t AS (SELECT DISTINCT ticker FROM bars), g AS (SELECT t.ticker, b.close FROM t CROSS JOIN cal c
  LEFT JOIN bars b ON b.ticker = t.ticker AND b.session = c.session)
SELECT ticker, count(*) AS expected, count(*) - count(close) AS missing, round((count(*) - count(close)) / count(*), 8) AS missing_ratio
FROM g GROUP BY ticker""")
def c10(spark, d):
    return calendars.session_gaps(A.bars(spark, d), cal_of(spark, d))


@query("c11_systematic_gaps", f"""WITH {BARS}, t AS (SELECT DISTINCT ticker FROM bars), g AS (SELECT t.ticker, c.session, b.close FROM t
  CROSS JOIN cal c LEFT JOIN bars b ON b.ticker = t.ticker AND b.session = c.session)
SELECT session, count(*) AS n, string_agg(ticker, ',' ORDER BY ticker) AS tickers FROM g WHERE close IS NULL GROUP BY session HAVING count(*) >= 2""")
def c11(spark, d):
    return calendars.systematic_gaps(A.bars(spark, d), cal_of(spark, d))


@query("c17_recent_coverage", f"""WITH {BARS} SELECT ticker, CAST(count(*) FILTER (WHERE idx > (SELECT max(idx) FROM cal) - 12) AS BIGINT) AS recent,
  max(session) AS last_session, (SELECT max(idx) FROM cal) - max(idx) AS behind FROM panel GROUP BY ticker""")
def c17(spark, d):
    return calendars.recent_coverage(A.bars(spark, d), cal_of(spark, d), 12)


def wind(n):
    return f"(PARTITION BY ticker ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ORD = "(PARTITION BY ticker ORDER BY idx)"
MACD, SIGNAL = features.macd_weights(features.HISTORY)


def fir(weights):
    return " + ".join(f"({w!r}) * l[{i + 1}]" for i, w in enumerate(weights))


STUDY = f"""{BARS},
cb AS (SELECT *, ln(price / lag(price) OVER (ORDER BY idx)) AS b1, ln(price / lag(price, 20) OVER (ORDER BY idx)) AS b20,
  price / max(price) OVER (ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS bdd FROM cal),
cb2 AS (SELECT session, b1, b20, bdd, CASE WHEN count(b1) OVER w = 20 THEN stddev_pop(b1) OVER w END AS bv20 FROM cb
  WINDOW w AS (ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f1 AS (SELECT p.*, c.b1, c.b20, c.bdd, c.bv20, ln(adj / lag(adj) OVER {ORD}) AS r1, ln(adj / lag(adj, 5) OVER {ORD}) AS r5,
  ln(adj / lag(adj, 10) OVER {ORD}) AS r10, ln(adj / lag(adj, 20) OVER {ORD}) AS r20, ln(open / lag(close) OVER {ORD}) AS gap,
  adj - lag(adj) OVER {ORD} AS ch, ln(high / low) AS rg,
  greatest(high - low, abs(high - lag(close) OVER {ORD}), abs(low - lag(close) OVER {ORD})) AS tr,
  ln(1 + volume) - ln(1 + lag(volume) OVER {ORD}) AS dv, list(adj) OVER {wind(35)} AS l,
  count(*) OVER (PARTITION BY ticker ORDER BY p.idx RANGE BETWEEN 34 PRECEDING AND CURRENT ROW) AS history,
  CASE WHEN lead(p.idx) OVER {ORD} = p.idx + 1 THEN lead(adj) OVER {ORD} END AS nadj,
  CASE WHEN lead(p.idx) OVER {ORD} = p.idx + 1 THEN lead(high) OVER {ORD} END AS nhigh,
  CASE WHEN lead(p.idx) OVER {ORD} = p.idx + 1 THEN lead(low) OVER {ORD} END AS nlow
  FROM panel p JOIN cb2 c USING (session)),
f2 AS (SELECT *, adj / avg(adj) OVER {wind(5)} - 1 AS ma5, adj / avg(adj) OVER {wind(20)} - 1 AS ma20,
  CASE WHEN max(volume) OVER {wind(20)} = min(volume) OVER {wind(20)} THEN 0 ELSE
    (volume - avg(volume) OVER {wind(20)}) / stddev_pop(volume) OVER {wind(20)} END AS vz,
  stddev_pop(r1) OVER {wind(5)} AS v5, stddev_pop(r1) OVER {wind(20)} AS v20, avg(tr) OVER {wind(14)} / close AS atr,
  avg(abs(rg) / sqrt(4 * ln(2))) OVER {wind(5)} AS pk, avg(greatest(ch, 0)) OVER {wind(14)} AS ga, avg(greatest(-ch, 0)) OVER {wind(14)} AS lo,
  abs(ln(nadj / adj)) AS next_abs, abs(ln(nhigh / nlow)) AS next_range FROM f1),
study AS (SELECT *, CASE WHEN ga = 0 AND lo = 0 THEN 50 WHEN lo = 0 THEN 100 ELSE 100 - 100 / (1 + ga / lo) END AS rsi,
  ({fir(MACD)}) / adj AS macd, ({fir(SIGNAL)}) / adj AS sig, next_abs / v20 AS primary_target FROM f2
  WHERE history = 35 AND v20 > 1e-8 AND next_abs IS NOT NULL)"""


@query("e17_risk_features", f"""WITH {STUDY} SELECT ticker, session, round(r1, 6) AS return_log_1, round(r5, 6) AS return_log_5,
  round(r10, 6) AS return_log_10, round(r20, 6) AS return_log_20, round(gap, 6) AS overnight_gap_log_1, round(ma5, 6) AS close_ma_deviation_5,
  round(ma20, 6) AS close_ma_deviation_20, round(dv, 6) AS volume_log_change_1p_1, round(vz, 6) AS volume_zscore_20,
  CASE WHEN volume = 0 THEN 1 ELSE 0 END AS zero_volume_flag, round(v5, 6) AS volatility_log_return_5,
  round(v20, 6) AS volatility_log_return_20, round(rg, 6) AS high_low_log_range_1, round(atr, 6) AS atr_14_normalized,
  round(pk, 6) AS parkinson_mean_5, round(rsi, 6) AS rsi_14, round(macd, 6) AS macd_12_26_normalized, round(sig, 6) AS macd_signal_9_normalized,
  round(b1, 6) AS benchmark_return_log_1, round(b20, 6) AS benchmark_return_log_20, round(bv20, 6) AS benchmark_volatility_log_return_20,
  round(r1 - b1, 6) AS stock_minus_benchmark_return_log_1, round(bdd, 6) AS benchmark_drawdown_20 FROM study""")
def e17(spark, d):
    rows = features.study_rows(A.panel(spark, d), cal_of(spark, d))
    return rows.select("ticker", "session", *(F.col(c) if c == "zero_volume_flag" else r(c) for c in features.FEATURE_NAMES))


@query("e14_volatility_surprise", f"""WITH {STUDY} SELECT ticker, session, round(primary_target, 6) AS primary, round(next_abs, 6) AS next_abs,
  round(next_range, 6) AS next_range, round(next_range / sqrt(4 * ln(2)), 6) AS next_parkinson, round(next_abs - v20, 6) AS additive FROM study""")
def e14(spark, d):
    rows = features.study_rows(A.panel(spark, d), cal_of(spark, d))
    return rows.select("ticker", "session", *map(r, ["primary", "next_abs", "next_range", "next_parkinson", "additive"]))


def simple(name, sql, make, gate=None):
    """A window over the panel, by ticker and session."""
    def run(spark, d):
        rows = A.panel(spark, d)
        return make(rows)

    query(name, f"WITH {BARS} {sql}")(run)


simple("e1_pct_change", f"SELECT ticker, session, round(adj / lag(adj, 3) OVER {ORD} - 1, 6) AS pct_3 FROM panel",
       lambda p: p.select("ticker", "session", F.round(features.pct_change("adj", 3), 6).alias("pct_3")))
simple("e2_log_return", f"SELECT ticker, session, round(ln(adj / lag(adj, 5) OVER {ORD}), 6) AS log_5 FROM panel",
       lambda p: p.select("ticker", "session", F.round(features.log_return("adj", 5), 6).alias("log_5")))
simple("e3_ma_deviation", f"SELECT ticker, session, CASE WHEN count(*) OVER {wind(20)} = 20 THEN round(adj / avg(adj) OVER {wind(20)} - 1, 6) END AS ma_20 FROM panel",
       lambda p: p.select("ticker", "session", F.round(features.ma_deviation("adj", 20), 6).alias("ma_20")))
simple("e4_zscore", f"""SELECT ticker, session, CASE WHEN count(*) OVER {wind(20)} = 20 THEN CASE WHEN max(volume) OVER {wind(20)} = min(volume) OVER {wind(20)}
  THEN 0 ELSE round((volume - avg(volume) OVER {wind(20)}) / stddev_pop(volume) OVER {wind(20)}, 6) END END AS z_20 FROM panel""",
       lambda p: p.select("ticker", "session", F.round(features.zscore("volume", 20), 6).alias("z_20")))
simple("e5_volatility", f""", q AS (SELECT *, ln(adj / lag(adj) OVER {ORD}) AS r1 FROM panel) SELECT ticker, session,
  CASE WHEN count(r1) OVER {wind(20)} = 20 THEN round(stddev_pop(r1) OVER {wind(20)}, 6) END AS vol_20 FROM q""",
       lambda p: p.withColumn("r1", features.log_return("adj", 1)).select("ticker", "session", F.round(features.volatility("r1", 20), 6).alias("vol_20")))
simple("e6_rsi", f""", q AS (SELECT *, adj - lag(adj) OVER {ORD} AS c FROM panel), g AS (SELECT *, avg(greatest(c, 0)) OVER {wind(14)} AS a,
  avg(greatest(-c, 0)) OVER {wind(14)} AS b, count(c) OVER {wind(14)} AS n FROM q) SELECT ticker, session, CASE WHEN n = 14 THEN
  round(CASE WHEN a = 0 AND b = 0 THEN 50 WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END, 6) END AS rsi FROM g""",
       lambda p: p.withColumn("c", F.col("adj") - F.lag("adj").over(features.order())).select("ticker", "session", F.round(features.rsi("c", 14), 6).alias("rsi")))
simple("e13_history", """SELECT ticker, session, count(*) OVER (PARTITION BY ticker ORDER BY idx RANGE BETWEEN 34 PRECEDING AND CURRENT ROW) AS history FROM panel""",
       lambda p: p.select("ticker", "session", features.history().alias("history")))
simple("e16_forward_label", f""", q AS (SELECT *, lead(adj) OVER {ORD} / adj - 1 AS f, row_number() OVER {ORD} AS bar FROM panel)
  SELECT ticker, session, round(f, 6) AS forward_return, CASE WHEN f > 0 THEN 1 ELSE 0 END AS label_up FROM q WHERE bar > 25 AND f IS NOT NULL""",
       lambda p: features.forward_label(p).select("ticker", "session", r("forward_return"), "label_up"))


def ema_sql(span, source, name):
    a = 2 / (span + 1)
    return f"""{name} AS (SELECT x.ticker, x.n, sum(y.v * CASE WHEN y.n = 1 THEN pow(1 - {a!r}, x.n - 1) ELSE {a!r} * pow(1 - {a!r}, x.n - y.n) END) AS v
      FROM {source} x JOIN {source} y ON x.ticker = y.ticker AND y.n <= x.n GROUP BY 1, 2)"""


@query("e7_macd_full", f"""WITH {BARS}, s AS (SELECT ticker, session, row_number() OVER {ORD} AS n, adj AS v FROM panel),
{ema_sql(12, 's', 'e12')}, {ema_sql(26, 's', 'e26')}, m AS (SELECT ticker, n, e12.v - e26.v AS v FROM e12 JOIN e26 USING (ticker, n)),
{ema_sql(9, 'm', 'g')} SELECT s.ticker, s.session, round(m.v, 6) AS macd, round(g.v, 6) AS macd_signal
FROM s JOIN m USING (ticker, n) JOIN g USING (ticker, n)""")
def e7(spark, d):
    return features.macd_full(A.panel(spark, d)).select("ticker", "session", r("macd"), r("macd_signal"))


@query("e12_benchmark_features", f"""WITH {STUDY} SELECT session, round(b1, 6) AS benchmark_return_log_1, round(b20, 6) AS benchmark_return_log_20,
  round(bv20, 6) AS benchmark_volatility_log_return_20, round(bdd, 6) AS benchmark_drawdown_20 FROM cb2""")
def e12(spark, d):
    rows = features.benchmark_features(cal_of(spark, d))
    return rows.select("session", *(r(c) for c in rows.columns if c != "session"))


@query("e23_anchor_features", f"""WITH {STUDY}, q AS (SELECT *, count(volume) OVER w AS n, avg(volume) OVER w AS a, stddev_pop(volume) OVER w AS s,
  max(volume) OVER w = min(volume) OVER w AS flat, count(r1) OVER {wind(20)} AS m FROM f2
  WINDOW w AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT ticker, session, round(r1, 6) AS r1, CASE WHEN m = 20 THEN round(v20, 6) END AS std20, round(b1, 6) AS bench_r1,
  round(bv20, 6) AS bench_std20, round(r1 - b1, 6) AS relative, CASE WHEN n = 20 THEN CASE WHEN flat THEN 0 ELSE round((volume - a) / s, 6) END END AS volume_z FROM q""")
def e23(spark, d):
    rows = features.anchor_features(A.panel(spark, d), cal_of(spark, d))
    return rows.select("ticker", "session", *(r(c) for c in rows.columns[2:]))


RULES_SQL = """CASE WHEN next_session IS NULL THEN 'no_next_session' WHEN idx < 34 THEN 'warmup' WHEN close IS NULL THEN 'missing_bar'
  WHEN coalesce(history, 0) < 35 THEN 'missing_history' WHEN next_abs IS NULL THEN 'missing_target' WHEN v20 <= 1e-8 THEN 'near_zero_scale' END"""


@query("b7_exclusion_report", f"""WITH {STUDY}, t AS (SELECT DISTINCT ticker FROM bars), g AS (SELECT t.ticker, c.session, c.idx, c.next_session,
  f.close, f.history, f.next_abs, f.v20 FROM t CROSS JOIN cal c LEFT JOIN f2 f ON f.ticker = t.ticker AND f.session = c.session),
e AS (SELECT *, {RULES_SQL} AS x FROM g)
SELECT coalesce(x, 'eligible') AS reason, count(*) AS n, count(DISTINCT ticker) AS n_tickers, min(session) AS first_session, max(session) AS last_session
FROM e GROUP BY 1""")
def b7(spark, d):
    return validate.exclusion_report(study_grid(spark, d))


def study_grid(spark, d):
    cal = cal_of(spark, d)
    rows = features.volatility_surprise(features.risk_features(A.panel(spark, d), cal))
    grid = calendars.candidate_grid(rows, cal)
    return validate.with_exclusion(grid, [
        ("no_next_session", F.col("next_session").isNull()), ("warmup", F.col("idx") < 34), ("missing_bar", F.col("close").isNull()),
        ("missing_history", F.coalesce("history", F.lit(0)) < features.HISTORY), ("missing_target", F.col("next_abs").isNull()),
        ("near_zero_scale", F.col("volatility_log_return_20") <= 1e-8),
    ])


@query("l3_study_dataset", f"""WITH {STUDY}, t AS (SELECT DISTINCT ticker FROM bars), g AS (SELECT t.ticker, c.session, c.idx, c.next_session,
  f.close, f.history, f.next_abs, f.v20 FROM t CROSS JOIN cal c LEFT JOIN f2 f ON f.ticker = t.ticker AND f.session = c.session)
SELECT ticker, count(*) AS candidates, CAST(count(*) FILTER (WHERE {RULES_SQL} IS NULL) AS BIGINT) AS eligible,
  CAST(count(*) FILTER (WHERE {RULES_SQL} IS NOT NULL) AS BIGINT) AS excluded, round(avg(CASE WHEN {RULES_SQL} IS NULL THEN next_abs / v20 END), 6) AS mean_primary
FROM g GROUP BY ticker""")
def l3(spark, d):
    grid = study_grid(spark, d)
    stays = F.col("exclusion").isNull()
    return grid.groupBy("ticker").agg(
        F.count("*").alias("candidates"), F.sum(stays.cast("long")).alias("eligible"), F.sum((~stays).cast("long")).alias("excluded"),
        F.round(F.avg(F.when(stays, F.col("primary"))), 6).alias("mean_primary"),
    )


@query("e15_risk_labels", f"""WITH {STUDY}, s AS (SELECT *, {SPLIT_SQL} AS split, {SPLIT_SQL.replace('session', 'next_session')} AS target_split FROM study),
k AS (SELECT quantile_cont(primary_target, 0.9) AS threshold FROM s WHERE split = 'train' AND target_split = 'train')
SELECT ticker, session, split, round(primary_target, 6) AS primary, round(threshold, 6) AS threshold,
  CASE WHEN primary_target >= threshold THEN 1 ELSE 0 END AS high_risk FROM s, k WHERE split = target_split AND split IN ('train', 'validation', 'test')""")
def e15(spark, d):
    rows = features.study_rows(A.panel(spark, d), cal_of(spark, d))
    rows = rows.withColumns({"split": validate.split_for(F.col("session"), SPLITS), "target_split": validate.split_for(F.col("next_session"), SPLITS)})
    rows = rows.where("split = target_split AND split <> 'warmup'")
    cut = rows.where("split = 'train'").agg(F.percentile("primary", F.lit(0.9)).alias("threshold"))
    risky = (F.col("primary") >= F.col("threshold")).cast("int").alias("high_risk")
    return rows.crossJoin(F.broadcast(cut)).select("ticker", "session", "split", risky, r("primary"), r("threshold"))


@query("d4_coverage_by_axis", f"""WITH {STUDY}, t AS (SELECT DISTINCT ticker FROM bars), g AS (SELECT t.ticker, year(c.session) AS y, c.idx, c.next_session,
  f.close, f.history, f.next_abs, f.v20 FROM t CROSS JOIN cal c LEFT JOIN f2 f ON f.ticker = t.ticker AND f.session = c.session),
e AS (SELECT ticker, y, {RULES_SQL} IS NOT NULL AS x FROM g)
SELECT CASE WHEN grouping(ticker) = 0 THEN 'ticker' WHEN grouping(y) = 0 THEN 'year' ELSE 'all' END AS axis,
  coalesce(ticker, CAST(y AS VARCHAR), '') AS value, count(*) AS n, round(avg(CASE WHEN x THEN 1.0 ELSE 0.0 END), 6) AS excluded_rate
FROM e GROUP BY GROUPING SETS ((ticker), (y), ())""")
def d4(spark, d):
    grid = study_grid(spark, d).select("ticker", F.year("session").alias("y"), F.col("exclusion").isNotNull().cast("double").alias("x"))
    sets = grid.groupingSets([["ticker"], ["y"], []], "ticker", "y")
    out = sets.agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("excluded_rate"), F.grouping("ticker").alias("gt"), F.grouping("y").alias("gy"))
    axis = F.when(F.col("gt") == 0, "ticker").when(F.col("gy") == 0, "year").otherwise("all")
    return out.select(axis.alias("axis"), F.coalesce("ticker", F.col("y").cast("string"), F.lit("")).alias("value"), "n", "excluded_rate")
