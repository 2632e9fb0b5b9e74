"""Queries over composed products, and over the operators that only they use."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions import text as T
from panelspark.operators import artifact, calendars, features, fitted, newsroom, products, reaction_study, reactions, stats, validate
from panelspark.plans.evaluation import RIDGE, RIDGE_COLUMNS, assigned, scored
from panelspark.plans.evaluation import q as scored_query
from panelspark.plans.events import QUOTES, ZONE
from panelspark.plans.market import BARS, MACD, ORD, SHIFTED, SIGNAL, SPLIT_SQL, SPLITS, STUDY, cal_of, d4, fir, r, shifted, simple, wind
from panelspark.plans.registering import ORACLES, query, stored, written
from panelspark.plans.texts import FAMILIES, NEWS, VOTES, batches, news, votes
from panelspark.plans.texts import q as news_query
from panelspark.sources import adapters as A
from panelspark.sources import parsers
from panelspark.streaming.jobs import work_dir


@query("b6_complete_case", f"WITH {STUDY} SELECT count(*) AS n, min(session) AS first_session FROM f2 WHERE r20 IS NOT NULL AND v20 IS NOT NULL AND b20 IS NOT NULL")
def b6(spark, d):
    rows = features.risk_features(A.panel(spark, d), cal_of(spark, d))
    rows = validate.complete_case(rows, ["return_log_20", "volatility_log_return_20", "benchmark_return_log_20"])
    return rows.agg(F.count("*").alias("n"), F.min("session").alias("first_session"))


@query("b10_audit_rows", f"WITH {STUDY} SELECT count(*) AS n, 0 AS wrong_target_session, 0 AS not_finite, 0 AS wrong_target FROM study")
def b10(spark, d):
    cal = cal_of(spark, d)
    return products.audit_rows(features.study_rows(A.panel(spark, d), cal), cal, list(features.FEATURE_NAMES))


@news_query("b11_valid_vote", f"""{VOTES}, w AS (SELECT input_id, function_id, impact, CASE WHEN impact IS NULL AND function_id <> 'rules' THEN 0.0 ELSE confidence END AS confidence FROM vt WHERE function_id <> 'rules')
SELECT function_id, count(*) FILTER (WHERE impact IS NOT NULL) AS signals, count(*) AS n FROM w GROUP BY 1""")
def b11(spark, d):
    rows = votes(spark, d).where("function_id <> 'rules'").withColumns({
        "event_type": F.lit(None).cast("string"), "reason": F.when(F.col("impact").isNull(), "NO_MATCH")})
    valid = newsroom.valid_vote(rows).where("valid")
    return valid.groupBy("function_id").agg(F.count("impact").alias("signals"), F.count("*").alias("n"))


@scored_query("c12_enrich_oof", """SELECT CASE WHEN session >= '2001-06-01' THEN 'unknown_row' WHEN volume % 10 = 0 THEN 'target_differs' ELSE 'ok' END AS status, count(*) AS n FROM scored GROUP BY 1""")
def c12(spark, d):
    rows = scored(spark, d).select("fold", "ticker", "session", "y", "volume")
    data = rows.where("session < '2001-06-01'").withColumn("y", F.col("y") + F.when(F.col("volume") % 10 == 0, 0.25).otherwise(0.0)).drop("volume")
    return products.enrich(rows.drop("volume"), data, ["fold", "ticker", "session"]).groupBy("status").agg(F.count("*").alias("n"))


@query("c16_feature_parity", f"""WITH {STUDY} SELECT 'return_log_1' AS field, count(*) AS n_both, 'PASS' AS status FROM study WHERE ticker <> '5' UNION ALL
SELECT 'volume_log_change_1p_1', count(*), 'FAIL' FROM study WHERE ticker <> '5'""")
def c16(spark, d):
    rows = features.study_rows(A.panel(spark, d), cal_of(spark, d)).select("ticker", "session", "return_log_1", "volume_log_change_1p_1")
    other = rows.where("ticker <> '5'").withColumn("volume_log_change_1p_1", F.col("volume_log_change_1p_1") + 1e-3)
    return products.feature_parity(rows, other, ["ticker", "session"], ["return_log_1", "volume_log_change_1p_1"]).select("field", "n_both", "status")


PERSISTED = """, pr AS (SELECT *, CASE WHEN lag(next_session) OVER (PARTITION BY ticker ORDER BY session) = session THEN CAST(lag(hit) OVER (PARTITION BY ticker ORDER BY session) AS DOUBLE)
  ELSE (SELECT avg(hit) FROM scored) END AS persisted FROM scored)"""


@scored_query("c21_persistence_prob", f"{PERSISTED} SELECT ticker, session, round(persisted, 6) AS persisted FROM pr")
def c21(spark, d):
    return products.persistence_prob(scored(spark, d), "hit").select("ticker", "session", r("persisted"))


@scored_query("i15_baseline_report", f"""{PERSISTED}, prev AS (SELECT fold, avg(CASE WHEN y >= 1.5 THEN 1 ELSE 0 END) AS prevalence FROM assigned WHERE role = 'train' GROUP BY fold)
SELECT fold, round(any_value(prevalence), 6) AS prevalence, round(avg((persisted - hit) ** 2), 6) AS brier_persistence, round(avg((prevalence - hit) ** 2), 6) AS brier_prevalence
FROM pr JOIN prev USING (fold) GROUP BY fold""")
def i15(spark, d):
    """The prevalence is that of each fold's training rows, so nothing of the judged rows enters it."""
    rows = products.persistence_prob(scored(spark, d), "hit")
    hit = F.when(F.col("primary") >= 1.5, 1).otherwise(0)
    known = assigned(spark, d).where("role = 'train'").groupBy("fold").agg(F.avg(hit).alias("prevalence"))
    error = lambda c: F.round(F.avg((F.col(c) - F.col("hit")) ** 2), 6)
    return rows.join(F.broadcast(known), "fold").groupBy("fold").agg(
        F.round(F.first("prevalence"), 6).alias("prevalence"),
        error("persisted").alias("brier_persistence"), error("prevalence").alias("brier_prevalence"))


@query("d3_coverage_report", f"""WITH {BARS} SELECT {SPLIT_SQL} AS split, ticker, count(*) AS n, min(session) AS first_session, max(session) AS last_session FROM bars GROUP BY ROLLUP (1, 2)""")
def d3(spark, d):
    rows = A.bars(spark, d).withColumn("split", validate.split_for(F.col("session"), SPLITS))
    return rows.rollup("split", "ticker").agg(F.count("*").alias("n"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))


@query("d5_concentration", f"""SELECT a.axis, a.value, a.n, a.excluded_rate, a.n >= 50 AND a.excluded_rate - b.excluded_rate > 0.05 AND a.excluded_rate / b.excluded_rate > 1.5 AS flagged
FROM ({ORACLES['d4_coverage_by_axis']}) a, ({ORACLES['d4_coverage_by_axis']}) b WHERE b.axis = 'all' AND a.axis <> 'all'""")
def d5(spark, d):
    return products.concentration(d4(spark, d), 50, 0.05, 1.5).select("axis", "value", "n", "excluded_rate", "flagged")


@query("d29_feed_profile", """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS without_key,
  count(DISTINCT array_to_string(json_keys(props), ',')) AS variants FROM events GROUP BY 1""")
def d29(spark, d):
    rows = A.table(spark, d, "events")
    keys = F.array_join(F.json_object_keys("props"), ",")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"),
                                          F.count_if(F.get_json_object("props", "$.k").isNull()).alias("without_key"), F.count_distinct(keys).alias("variants"))


simple("e8_macd_window", f""", w AS (SELECT ticker, session, adj, list(adj) OVER {wind(35)} AS l FROM panel) SELECT ticker, session, round(({fir(MACD)}) / adj, 6) AS macd,
  round(({fir(SIGNAL)}) / adj, 6) AS macd_signal FROM w WHERE len(l) = 35""",
       lambda p: p.withColumn("l", F.collect_list("adj").over(features.last(35))).where(F.size("l") == 35).select(
           "ticker", "session", F.round(features.filtered(F.col("l"), MACD) / F.col("adj"), 6).alias("macd"),
           F.round(features.filtered(F.col("l"), SIGNAL) / F.col("adj"), 6).alias("macd_signal")))
simple("e9_atr", f""", t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {ORD}), abs(low - lag(close) OVER {ORD})) AS tr FROM panel)
  SELECT ticker, session, round(avg(tr) OVER {wind(14)} / close, 6) AS atr FROM t""",
       lambda p: p.withColumn("b", F.lag("close").over(features.order())).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("b")), F.abs(F.col("low") - F.col("b")))).select(
           "ticker", "session", F.round(F.avg("tr").over(features.last(14)) / F.col("close"), 6).alias("atr")))
simple("e10_parkinson", f"SELECT ticker, session, round(avg(abs(ln(high / low)) / sqrt(4 * ln(2))) OVER {wind(5)}, 6) AS parkinson FROM panel",
       lambda p: p.select("ticker", "session", F.round(F.avg(F.abs(F.ln(F.col("high") / F.col("low"))) / features.PARKINSON).over(features.last(5)), 6).alias("parkinson")))
simple("e11_bar_shape", f"SELECT ticker, session, round(ln(open / lag(close) OVER {ORD}), 6) AS gap, round(ln(high / low), 6) AS range, CASE WHEN volume = 0 THEN 1 ELSE 0 END AS zero FROM panel",
       lambda p: p.select("ticker", "session", F.round(features.log_ratio(F.col("open"), F.lag("close").over(features.order())), 6).alias("gap"),
                          F.round(F.ln(F.col("high") / F.col("low")), 6).alias("range"), (F.col("volume") == 0).cast("int").alias("zero")))


def forecasts():
    """Name, guess and complexity; made when a query runs, as a registry is read without a session."""
    return ("half", F.col("prediction") / 2, 2), ("naive", F.col("prediction"), 2), ("volatility", F.col("v20"), 1)


def evidence(spark, d, by, cell):
    """Per ``by`` and forecast: error, rank correlation and the worst of it, over the values of ``cell``."""
    made = F.array(*(F.struct(F.lit(n).alias("model"), F.round(g, 9).alias("guess"), F.lit(c).alias("complexity")) for n, g, c in forecasts()))
    rows = scored(spark, d).select(*by, cell, "y", F.explode(made).alias("g")).select(*by, cell, "y", "g.*")
    keys = [*by, "model", "complexity", cell]
    each = stats.regression_metrics(rows, "y", "guess", keys).join(stats.spearman(rows, "guess", "y", keys), keys)
    return each.groupBy(*by, "model", "complexity").agg(F.avg("mae").alias("mae"), F.avg("rho").alias("mean_rho"), F.min("rho").alias("worst_rho"))


def evidence_sql(by, cell):
    whole = f"{by}{cell}, model"
    return f""", gs AS (SELECT {by}{cell}, y, model, c AS complexity, round(CASE model WHEN 'half' THEN pred / 2 WHEN 'naive' THEN pred ELSE v20 END, 9) AS g
  FROM scored, (VALUES ('half', 2), ('naive', 2), ('volatility', 1)) f(model, c)),
rg AS (SELECT *, rank() OVER (PARTITION BY {whole} ORDER BY g) + (count(*) OVER (PARTITION BY {whole}, g) - 1) / 2 AS a,
  rank() OVER (PARTITION BY {whole} ORDER BY y) + (count(*) OVER (PARTITION BY {whole}, y) - 1) / 2 AS b FROM gs),
pe AS (SELECT {whole}, complexity, avg(abs(g - y)) AS mae, corr(a, b) AS rho FROM rg GROUP BY {whole}, complexity),
ev AS (SELECT {by}model, complexity, avg(mae) AS mae, avg(rho) AS mean_rho, min(rho) AS worst_rho FROM pe GROUP BY {by}model, complexity)"""


TOLD = "model, complexity, round(mae, 6) AS mae, round(mean_rho, 6) AS mean_rho, round(worst_rho, 6) AS worst_rho"


@scored_query("f3_select_params", f"""{evidence_sql("fold, ", "stock_regime")} SELECT fold, {TOLD} FROM (SELECT *, row_number() OVER (PARTITION BY fold
  ORDER BY round(mean_rho, 9) DESC, round(mae, 9), round(worst_rho, 9) DESC, complexity, model) AS k FROM ev) WHERE k = 1""")
def f3(spark, d):
    """Each fold's forecast by its evidence over regimes; two forecasts of one order tie in correlation, so their error decides."""
    out = stats.select_params(evidence(spark, d, ["fold"], "stock_regime").withColumn("params", F.col("model")), ["fold"])
    return out.select("fold", "model", "complexity", r("mae"), r("mean_rho"), r("worst_rho"))


@scored_query("f4_select_model", f"""{evidence_sql("", "fold")} SELECT {TOLD} FROM ev WHERE mean_rho >= (SELECT max(mean_rho) FROM ev) - 0.01
  ORDER BY round(ev.mae, 9), round(ev.worst_rho, 9) DESC, complexity, model LIMIT 1""")
def f4(spark, d):
    """The forecast of all folds, by error among those within the margin of the best correlation."""
    out = stats.select_model(evidence(spark, d, [], "fold"))
    return out.select("model", "complexity", r("mae"), r("mean_rho"), r("worst_rho"))


@scored_query("i12_score_artifact", f""", {RIDGE},
sc AS (SELECT role, ticker, session, round(greatest(exp(t0 - w1 * m1 - w2 * m2 + w1 * v20 + w2 * rsi) - 1, 0), 9) AS s FROM assigned JOIN b USING (fold) WHERE fold = '2001'),
pc AS (SELECT *, count(*) FILTER (WHERE role = 'train') OVER (ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) FILTER (WHERE role = 'train') OVER () AS p FROM sc)
SELECT ticker, session, round(s, 6) AS artifact_score, round(p, 6) AS percentile,
  CASE WHEN p >= 0.95 THEN 'P95' WHEN p >= 0.80 THEN 'P80' WHEN p >= 0.50 THEN 'P50' ELSE 'BELOW' END AS band FROM pc WHERE role = 'evaluation'""")
def i12(spark, d):
    """The two-column ridge of the last fold, frozen with its training scores, read back and applied to the evaluation rows."""
    rows = assigned(spark, d).drop("prediction").where("fold = '2001'")
    train = rows.where("role = 'train'")
    model = fitted.fit_ridge(train, RIDGE_COLUMNS, F.log1p("primary"), [100.0], ["fold"])
    said = fitted.predict_ridge(train, model, RIDGE_COLUMNS, ["fold"])
    path = work_dir(spark, "i12")
    terms = written(artifact.model_terms(train, RIDGE_COLUMNS, model), f"{path}/terms")
    digest = artifact.freeze(terms, artifact.model_head(terms, model), artifact.reference_of(said, "prediction"), f"{path}/models")
    out = artifact.score_rows(rows.where("role = 'evaluation'"), artifact.read_artifact(spark, f"{path}/models", digest))
    return out.select("ticker", "session", r("artifact_score"), r("percentile"), "band")


@news_query("h11_mentions", """SELECT id, regexp_matches(summary, '(^|[^A-Za-z0-9])tion($|[^A-Za-z0-9])') AS m FROM news""")
def h11(spark, d):
    return news(spark, d).select("id", T.mentions(F.col("summary"), F.lit("tion")).alias("m"))


@scored_query("h16_regime", "SELECT ticker, session, stock_regime AS regime FROM scored")
def h16(spark, d):
    return scored(spark, d).select("ticker", "session", F.col("stock_regime").alias("regime"))


@query("h17_quarter_label", "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def h17(spark, d):
    return A.table(spark, d, "orders").groupBy(T.quarter_label(F.col("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))


@scored_query("h18_logit", "SELECT ticker, session, round(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))), 5) AS logit FROM scored")
def h18(spark, d):
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    return scored(spark, d).select("ticker", "session", F.round(F.ln(p / (1 - p)), 5).alias("logit"))


@query("h19_norm_entropy", """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY o_custkey) AS s, count(*) OVER (PARTITION BY o_custkey) AS m FROM c)
SELECT o_custkey, round(CASE WHEN any_value(m) > 1 THEN -sum(s * ln(s)) / ln(any_value(m)) ELSE 0 END, 6) AS entropy FROM t GROUP BY 1""")
def h19(spark, d):
    counts = A.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    return counts.groupBy("o_custkey").agg(F.round(T.norm_entropy(F.collect_list("n")), 6).alias("entropy"))


@query("h20_month_windows", """WITH e AS (SELECT event_type, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events GROUP BY 1)
SELECT event_type, CAST(m AS DATE) AS month_start, last_day(m) AS month_end FROM (SELECT event_type, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS m FROM e)""")
def h20(spark, d):
    ends = A.table(spark, d, "events").groupBy("event_type").agg(F.min(F.col("ts").cast("date")).alias("a"), F.max(F.col("ts").cast("date")).alias("b"))
    months = ends.select("event_type", F.explode(F.sequence(F.trunc("a", "month"), F.col("b"), F.make_ym_interval(F.lit(0), F.lit(1)))).alias("month_start"))
    return months.withColumn("month_end", F.last_day("month_start"))


@news_query("h22_marker_flags", r"""SELECT id, regexp_matches(text, '[0-9]') AS digits, regexp_matches(text, '(?i)https?://') AS url, regexp_matches(text, '[#*$%&|]{3}') AS symbols FROM news""")
def h22(spark, d):
    return news(spark, d).select("id", T.marker_flags(F.col("text")).alias("f")).select("id", "f.digits", "f.url", "f.symbols")


@news_query("k3_labeling_functions", f"{VOTES} SELECT function_id, impact, count(*) AS n FROM vt GROUP BY 1, 2")
def k3(spark, d):
    return votes(spark, d).groupBy("function_id", "impact").agg(F.count("*").alias("n"))


@news_query("a6_announcements_csv", "SELECT id % 100 || '' AS ticker, 'n' || id AS title, strftime(published_at - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS at FROM news")
def a6(spark, d):
    path = work_dir(spark, "a6")
    rows = news(spark, d).select((F.col("id") % 100).cast("string").alias("ticker"), F.date_format("published_at", "yyyy-MM-dd").alias("date"), F.date_format("published_at", "HH:mm:ss").alias("time"),
                                 F.concat(F.lit("n"), F.col("id").cast("string")).alias("title"), F.col("title").alias("body"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return parsers.parse_announcements_csv(spark, path).select("ticker", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("a8_read_law_xml", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS published_on, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid_publication_date' END AS exclusion FROM orders")
def a8(spark, d):
    path = work_dir(spark, "a8")
    day = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    law = F.concat(F.lit("<Law><id>"), F.col("o_orderkey").cast("string"), F.lit("</id><title>t</title><date>"), day, F.lit("</date><content>text</content></Law>"))
    rows = batches(A.table(spark, d, "orders"), "o_orderkey").groupBy("o_orderpriority", "batch").agg(F.concat(F.lit("<Laws>"), F.array_join(F.collect_list(law), "\n"), F.lit("</Laws>")).alias("value"))
    rows.withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1)).write.partitionBy("o_orderpriority", "batch").text(path)
    return parsers.read_law_xml(spark, path).select("id", "published_on", "exclusion")


@query("l2_market_dataset", f"""WITH {BARS}, {SHIFTED} SELECT {SPLIT_SQL} AS split, count(*) AS n, count(*) FILTER (WHERE high < low OR volume < 0) AS n_invalid, count(DISTINCT ticker) AS tickers FROM shifted GROUP BY 1""")
def l2(spark, d):
    rows = shifted(spark, d).withColumn("split", validate.split_for(F.col("session"), SPLITS))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if((F.col("high") < F.col("low")) | (F.col("volume") < 0)).alias("n_invalid"), F.count_distinct("ticker").alias("tickers"))


@query("l1_modeling_dataset", f"""WITH {BARS}, b AS (SELECT session, price / lag(price) OVER (ORDER BY idx) - 1 AS br FROM cal), q AS (SELECT *, row_number() OVER {ORD} AS bar,
  adj / lag(adj) OVER {ORD} - 1 AS r1, adj / lag(adj, 5) OVER {ORD} - 1 AS r5, adj / avg(adj) OVER {wind(5)} - 1 AS m5, lead(adj) OVER {ORD} / adj - 1 AS f FROM panel)
SELECT ticker, session, round(r1, 6) AS return_1, round(r5, 6) AS return_5, round(m5, 6) AS ma_5, round(br, 6) AS benchmark_return, round(f, 6) AS forward_return,
  CASE WHEN f > 0 THEN 1 ELSE 0 END AS label_up FROM q JOIN b USING (session) WHERE bar > 25 AND f IS NOT NULL""")
def l1(spark, d):
    from pyspark.sql.window import Window

    cal = cal_of(spark, d)
    bench = cal.select("session", (F.col("price") / F.lag("price").over(Window.orderBy("idx")) - 1).alias("benchmark_return"))
    rows = A.panel(spark, d).withColumns({"return_1": features.pct_change("adj", 1), "return_5": features.pct_change("adj", 5), "ma_5": features.ma_deviation("adj", 5)})
    rows = features.forward_label(rows).join(F.broadcast(bench), "session")
    return rows.select("ticker", "session", *map(r, ["return_1", "return_5", "ma_5", "benchmark_return", "forward_return"]), "label_up")


@news_query("l4_build_corpus", r""", c1 AS (SELECT id, source || '/' || (id % 40) AS family, CAST(published_at AS DATE) AS day,
    regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t　]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM news),
c2 AS (SELECT id, family, day, trim(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'), ' ') AS norm FROM c1),
f AS (SELECT arg_min(id, (day, id)) AS id, norm FROM c2 WHERE norm <> '' GROUP BY norm), a AS (SELECT c2.*, max(day) OVER (PARTITION BY family) AS anchor FROM f JOIN c2 USING (id))
SELECT id, family, sha256(norm) AS h, CASE WHEN anchor <= DATE '2024-01-03' THEN 'train' WHEN anchor <= DATE '2024-01-04' THEN 'validation' ELSE 'test' END AS split FROM a""")
def l4(spark, d):
    """Every kept record of all texts, by the digest of its normalised content, with its split."""
    rows = news(spark, d).select("id", F.concat_ws("/", "source", (F.col("id") % 40).cast("string")).alias("family"), F.to_date("published_at").alias("day"), F.col("text").alias("content"))
    return products.build_corpus(rows, "2024-01-03", "2024-01-04").select("id", "family", "h", "split")


@query("l5_ingest_news")
def l5(spark, d):
    made = F.array(*(F.struct(F.lit(t).alias("ticker"), F.lit(a).alias("alias")) for t, a in (("the", "erth"), ("and", "onnt"))))
    aliases = spark.range(1).select(F.explode(made).alias("a")).select("a.*")
    pages = A.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return products.ingest_news(news(spark, d).withColumn("summary", F.col("text")).join(pages, "id"), aliases)


@news_query("l6_assemble_items", """, m AS (SELECT *, regexp_matches(title, 'erth|eaon') AS a, regexp_matches(title, 'thth') AS b, regexp_matches(title, 'onon|ndnd') AS c,
  regexp_matches(title, 'tion') AS p, regexp_matches(title, 'ing') AS n, lower(lang) IN ('en', 'fr') OR lower(lang) LIKE 'en-%' OR lower(lang) LIKE 'fr-%' AS known FROM news),
v AS (SELECT *, CASE WHEN a::INT + b::INT + c::INT = 1 THEN CASE WHEN a THEN 'A' WHEN b THEN 'B' ELSE 'C' END END AS event_type,
  CASE WHEN p AND n THEN 'AMBIGUOUS' WHEN p THEN 'POSITIVE' WHEN n THEN 'NEGATIVE' END AS impact FROM m)
SELECT id, CASE WHEN known AND (event_type IS NOT NULL OR impact IS NOT NULL) THEN 'SCORED' WHEN known THEN 'ELIGIBLE_NOT_SCORED' ELSE 'ABSTAIN' END AS status,
  CASE WHEN known THEN event_type END AS event_type, CASE WHEN known THEN impact END AS impact, array_to_string(list_filter(['and', 'tion'], lambda t: contains(title, t)), ',') AS cues,
  sha256(substr(summary, 1, 120)) AS excerpt, source, sha256(source || chr(31) || title) AS input_hash FROM v""")
def l6(spark, d):
    """Every assembled record with its event, cues, excerpt and lineage."""
    vote = T.rule_vote(F.col("title"), FAMILIES, ("tion",), ("ing",))
    items = products.assemble_items(news(spark, d), ("en", "fr"), vote, T.cue_terms(F.col("title"), ("tion", "and")))
    return items.select("id", "status", "event.event_type", "event.impact", F.array_join("cues", ",").alias("cues"), F.sha2("excerpt", 256).alias("excerpt"), "lineage.source", "lineage.input_hash")


@news_query("l8_to_documents", """SELECT id, sha256(source || chr(31) || id) AS document_id, sha256(sha256(source || chr(31) || id) || chr(31) || sha256(text)) AS version_id,
  CASE source WHEN 'src1' THEN 'FULL' WHEN 'src2' THEN 'METADATA' ELSE 'EXCERPT' END AS tier, length(CASE source WHEN 'src1' THEN text WHEN 'src2' THEN NULL ELSE substr(text, 1, 200) END) AS n FROM news""")
def l8(spark, d):
    rows = products.to_documents(news(spark, d), {"src1": "FULL", "src2": "METADATA"})
    return rows.select("id", "document_id", "version_id", "tier", F.length("permitted_text").cast("long").alias("n"))


@query("l7_assemble_reaction", f"""WITH {QUOTES} SELECT event_id, effective, round(confidence, 6) AS score,
  CASE WHEN effective IS NULL THEN 'ABSTAIN_NO_SESSION' WHEN confidence >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS status FROM eff""")
def l7(spark, d):
    """Every event's record: its session, its score and the band or why there is none."""
    rows = calendars.assign_sessions(A.publications(spark, d), A.quotes(spark, d).select("session").distinct(), ZONE, 13, 30)
    rows = reactions.gate_signal(rows.select("event_id", "published_at", F.col("published_at").alias("available_at"), F.col("confidence").alias("score"), "effective"), F.lit("2100-01-01").cast("timestamp"), 0.5, 0.5)
    status = F.when(F.col("effective").isNull(), "ABSTAIN_NO_SESSION").otherwise(F.col("band"))
    return rows.select("event_id", "effective", r("score"), status.alias("status"))


@scored_query("l10_conditional_report", """, c AS (SELECT stock_regime, count(*) AS n, avg(next_abs) FILTER (WHERE said = 1) AS h, avg(next_abs) FILTER (WHERE said = 0) AS o FROM scored GROUP BY 1)
SELECT stock_regime, n, round(h, 6) AS mean_high, round(o, 6) AS mean_normal, round(h - o, 6) AS difference FROM c""")
def l10(spark, d):
    rows = stats.separation(scored(spark, d), "next_abs", "said", ["stock_regime"])
    return rows.select("stock_regime", (F.col("n_high") + F.col("n_normal")).alias("n"), r("mean_high"), r("mean_normal"), r("difference"))


@query("l11_holdout_eval")
def l11(spark, d):
    """The calibrator of the first year and the threshold with the best correlation coefficient on the second, both frozen
    and applied to the last year; with the outcome's separation by what was said."""
    rows = scored(spark, d).select(F.col("fold").cast("int").alias("fold"), "ticker", "session", "p", "hit", "next_abs")
    models = fitted.prequential_platt(rows, "p", "hit", [1999, 2000]).select("slope", "shift").limit(1)
    logit = F.ln(F.col("p") / (1 - F.col("p")))
    told = rows.where("fold > 1999").crossJoin(F.broadcast(models)).withColumn("score", F.round(1 / (1 + F.exp(-(F.col("slope") * logit + F.col("shift")))), 6))
    table = stats.threshold_table(told.where("fold = 2000"), "hit", "score", ["fold"])
    threshold = stats.first_by(table, [], [F.desc(F.round("mcc", 9)), F.col("threshold")]).first()["threshold"]
    out = told.where("fold = 2001").withColumn("said", (F.col("score") >= threshold).cast("int"))
    found = stats.binary_metrics(out, "hit", "score", threshold, ["fold"]).join(stats.separation(out, "next_abs", "said", ["fold"], 30), "fold")
    return found.select("fold", F.lit(threshold).alias("threshold"), "n", *map(r, ("recall", "precision", "mcc", "roc_auc", "brier", "mean_high", "mean_normal", "difference")), "status")


@query("i6_permutation_importance")
def i6(spark, d):
    """How much average precision a ridge score loses when one column is dealt anew by hash, per fold and column."""
    columns = ["volatility_log_return_20", "rsi_14", "atr_14_normalized", "parkinson_mean_5", "return_log_1", "benchmark_volatility_log_return_20"]
    rows = assigned(spark, d).drop("prediction").withColumns({"y": F.col("primary"), "hit": (F.col("primary") >= 1.5).cast("int")})
    models = fitted.fit_ridge(rows.where("role = 'train'"), columns, F.log1p("y"), [10.0], ["fold"])
    held = rows.where("role = 'evaluation'").select("fold", "ticker", "session", "hit", *columns)
    number = lambda rows: stats.positions(rows, ["fold"], "order").withColumn("at", F.col("_r")).drop("_r", "_n", "order")
    placed = number(held.withColumn("order", F.xxhash64(F.lit(3), "session", "ticker")))
    dealt = number(held.withColumn("order", F.xxhash64(F.lit(7), "session", "ticker")))
    tried = [placed.withColumn("column", F.lit("none"))]
    for c in columns:
        other = dealt.select("fold", "at", F.col(c).alias("_v"))
        tried.append(placed.join(other, ["fold", "at"]).withColumn(c, F.col("_v")).drop("_v").withColumn("column", F.lit(c)))
    every = tried[0]
    for t in tried[1:]:
        every = every.unionByName(t)
    out = fitted.predict_ridge(every, models, columns, ["fold"]).withColumn("score", F.round("prediction", 9))
    return stats.ranking_metrics(out, "hit", "score", ["fold", "column"]).select("fold", "column", r("average_precision"), r("roc_auc"))


@query("f8_rank_importance")
def f8(spark, d):
    """Columns by how much average precision falls without them, in the mean over folds; ties by name."""
    rows = i6(spark, d).groupBy("column").agg(F.avg("average_precision").alias("average_precision"))
    base = rows.where("column = 'none'").select(F.col("average_precision").alias("base"))
    drops = rows.where("column <> 'none'").crossJoin(F.broadcast(base))
    return drops.select("column", F.round(F.col("base") - F.col("average_precision"), 6).alias("importance")).orderBy(F.desc("importance"), "column")


@query("h4_sim_ratio")
def h4(spark, d):
    """Title similarity of documents of one source and language that follow each other."""
    from pyspark.sql.window import Window

    before = F.lag("title").over(Window.partitionBy("source", "lang").orderBy("id"))
    rows = news(spark, d).select("id", T.norm_title(F.col("title")).alias("a"), T.norm_title(before).alias("b"))
    return rows.select("id", F.round(T.sim_ratio("a", "b"), 6).alias("ratio"))


@query("i8_walk_forward")
def i8(spark, d):
    """A class-balanced logistic per fold on purged training rows, and the metrics of its evaluation year."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    columns = ["volatility_log_return_20", "return_log_1", "rsi_14", "atr_14_normalized"]
    rows = fitted.ml_rows(assigned(spark, d).withColumn("label", (F.col("primary") >= 1.5).cast("double")).drop("prediction"), columns)
    model, out = LogisticRegression(weightCol="weight", regParam=1e-3), []
    for fold in ("1999", "2000", "2001"):
        part = rows.where(F.col("fold") == fold)
        fit = model.fit(fitted.balanced(part.where("role = 'train'"), "label"))
        out.append(fit.transform(part.where("role = 'evaluation'")))
    scored_rows = out[0].unionByName(out[1]).unionByName(out[2])
    scored_rows = scored_rows.withColumns({"p": F.round(vector_to_array("probability")[1], 6), "hit": F.col("label").cast("int")})
    return stats.binary_metrics(scored_rows, "hit", "p", 0.5, ["fold"]).select("fold", "n", r("average_precision", 4), r("mcc", 4), r("brier", 4))


STUDY_COLUMNS = reaction_study.Columns(["own_before", "market_before"], ["events", "confidence"], ["ticker", "event_class"], "embedding", ["event_id", "ticker"])
STUDY_WEEKS = [2, 3, 4]


def reaction_rows(spark, d):
    """Events with a next-session reaction, what both prices did one session before the anchor, how many events share
    the ticker and session, and the embedding that the event's number falls to. Weeks stand for years."""
    prices = A.quotes(spark, d)
    labels = reactions.reaction_labels(A.publications(spark, d), prices, {"next_session": 1}, 0.05, 0.25, ZONE, 13, 30).where("reason IS NULL")
    bench = prices.groupBy("session").agg(F.avg("price").alias("bench"))
    change = lambda c, w: F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0.0)) - 1
    market = bench.select(F.col("session").alias("start_session"), change("bench", Window.orderBy("session")).alias("market_before"))
    own = prices.select("ticker", F.col("session").alias("start_session"), change("price", Window.partitionBy("ticker").orderBy("session")).alias("own_before"))
    counts = labels.groupBy("ticker", "effective").agg(F.count("*").cast("double").alias("events"))
    vectors = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    size = vectors.agg((F.max("v") + 1).alias("_size"))
    rows = labels.join(F.broadcast(market), "start_session").join(own, ["ticker", "start_session"]).join(counts, ["ticker", "effective"])
    rows = rows.crossJoin(F.broadcast(size)).withColumn("v", F.pmod("event_id", "_size")).join(vectors, "v")
    week = F.floor(F.datediff("effective", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return rows.where("own_before IS NOT NULL AND market_before IS NOT NULL").select(
        "event_id", "ticker", "event_class", "events", "confidence", "own_before", "market_before", "embedding", week.alias("period"), F.col("abnormal").alias("y"))


def reaction_said(spark, d):
    return stored(spark, d, "reaction_said", lambda s, d: reaction_study.reaction_predictions(
        written(reaction_rows(s, d), work_dir(s, "reaction_rows")), STUDY_COLUMNS, STUDY_WEEKS))


@query("i13_reaction_study")
def i13(spark, d):
    """Three sets of columns, signed reactions and their size, over all folds."""
    out = reaction_study.aggregate(reaction_said(spark, d))
    return out.select("features", "target", "n", *(r(c) for c in ("mae", "rmse", "r2", "rho", "top_lift")))


@query("i13_increment_gate")
def i13_gate(spark, d):
    return reaction_study.increment_gate(reaction_said(spark, d)).select("check", r("found"), r("bound"), "passed")


@query("i13_robustness")
def i13_robustness(spark, d):
    out = reaction_study.robustness(reaction_said(spark, d), "ticker")
    return out.select("ticker", "n", *(r(c) for c in ("mae", "rmse", "r2", "rho")))


@query("i13_market_only", f"""WITH {QUOTES},
lq AS (SELECT ticker, session, price, price / nullif(lag(price) OVER (PARTITION BY ticker ORDER BY session), 0) - 1 AS own_before FROM quotes),
ls AS (SELECT *, bench / nullif(lag(bench) OVER (ORDER BY session), 0) - 1 AS market_before FROM ses),
rw AS (SELECT e.event_id, date_diff('day', DATE '2024-01-01', e.effective) // 7 AS period, p.own_before AS x1, a.market_before AS x2,
    q.price / nullif(p.price, 0) - 1 AS raw, z.bench / nullif(a.bench, 0) - 1 AS market FROM eff e JOIN ses z ON z.session = e.effective
    JOIN ls a ON a.idx = z.idx - 1 JOIN lq p ON p.ticker = e.ticker AND p.session = a.session JOIN quotes q ON q.ticker = e.ticker AND q.session = z.session),
ok AS (SELECT *, raw - market AS y FROM rw WHERE abs(raw) <= 0.25 AND x1 IS NOT NULL AND x2 IS NOT NULL AND raw - market IS NOT NULL),
tt AS (SELECT event_id, period, x1, x2, 'signed' AS target, y FROM ok UNION ALL SELECT event_id, period, x1, x2, 'size', abs(y) FROM ok),
z AS (SELECT f.period, target, count(*) AS n, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(y) AS t0, corr(x1, x2) AS rho,
    covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM (VALUES (2), (3), (4)) f(period) JOIN tt ON tt.period < f.period GROUP BY 1, 2),
b AS (SELECT *, ((n + 100) * n * c1 / s1 - n * rho * n * c2 / s2) / ((n + 100) ** 2 - (n * rho) ** 2) / s1 AS w1,
  ((n + 100) * n * c2 / s2 - n * rho * n * c1 / s1) / ((n + 100) ** 2 - (n * rho) ** 2) / s2 AS w2 FROM z),
sd AS (SELECT t.period, t.target, y, round(t0 - w1 * m1 - w2 * m2 + w1 * x1 + w2 * x2, 12) AS p FROM tt t JOIN b USING (period, target)),
cu AS (SELECT target, quantile_cont(p, 0.9) AS c FROM sd GROUP BY target)
SELECT period, target, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse FROM sd GROUP BY 1, 2""")
def i13_market(spark, d):
    """The folds of the set whose ridge has a closed form."""
    said = reaction_said(spark, d).where("features = 'market_only'")
    return reaction_study.quality(said, ["period", "target"]).select("period", "target", "n", r("mae"), r("rmse"))


def frozen(spark, d, path, partitions=None):
    """The alpha with the least mean error over the folds, refitted on all training rows of the last one; its reference are
    the rows of all folds as forecast by models that had not seen them. Returns the artifact's digest."""
    columns = [c for c in features.FEATURE_NAMES if c != "zero_volume_flag"]
    rows = assigned(spark, d).drop("prediction").withColumn("y", F.col("primary"))
    rows = rows.repartition(partitions) if partitions else rows
    models = fitted.fit_ridge(rows.where("role = 'train'"), columns, F.log1p("y"), [1.0, 10.0, 100.0], ["fold"], exact=True)
    tried = written(fitted.predict_ridge(rows.where("role = 'evaluation'"), models, columns, ["fold"]).select("fold", "alpha", "y", "prediction"), f"{path}/tried-{partitions}")
    errors = stats.regression_metrics(tried, "y", "prediction", ["fold", "alpha"]).groupBy("alpha").agg(F.avg("mae").alias("mae"))
    chosen = F.broadcast(stats.first_by(errors, [], [F.round("mae", 9), F.col("alpha")]).select("alpha"))
    final = models.where("fold = '2001'").join(chosen, "alpha")
    terms = written(artifact.model_terms(rows.where("fold = '2001' AND role = 'train'"), columns, final), f"{path}/terms-{partitions}")
    return artifact.freeze(terms, artifact.model_head(terms, final), artifact.reference_of(tried.join(chosen, "alpha"), "prediction"), f"{path}/models")


@query("i14_freeze_model")
def i14(spark, d):
    """The frozen model's terms, read back, and whether a second fit of the rows in another layout has the same digest."""
    path = work_dir(spark, "i14")
    digest = frozen(spark, d, path)
    again = frozen(spark, d, path, 7)
    model = artifact.read_artifact(spark, f"{path}/models", digest)
    terms, _, _ = artifact.parts(spark, f"{path}/models/{digest}")
    return terms.select(F.lit(model["alpha"]).alias("alpha"), F.round(F.lit(model["intercept"]), 6).alias("intercept"), "position", "name",
                        F.round("mean", 8).alias("mean"), F.round("scale", 8).alias("scale"), F.round("coefficient", 8).alias("coefficient"),
                        F.lit(again == digest).alias("repeat_equal"))
