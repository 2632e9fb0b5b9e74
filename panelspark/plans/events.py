"""Queries over the event stream: sessions, reactions, sentiment, gates and streaming jobs."""

from pyspark.sql import functions as F

from panelspark.operators import calendars, reactions
from panelspark.plans.market import r
from panelspark.plans.registering import query
from panelspark.sources import adapters as A
from panelspark.streaming import commits, jobs, sessions

ZONE = "Asia/Taipei"
QUOTES = """quotes AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS session, avg(value) AS price FROM events
  WHERE isodow(ts) < 6 GROUP BY 1, 2),
ses AS (SELECT session, avg(price) AS bench, row_number() OVER (ORDER BY session) - 1 AS idx FROM quotes GROUP BY session),
pub AS (SELECT event_id, event_type AS ticker, ts AS published_at, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence,
  'c' || (user_id % 7) AS event_class, user_id, value, ts + INTERVAL 8 HOUR AS local FROM events),
eff AS (SELECT p.*, (SELECT min(session) FROM ses WHERE session > CAST(local AS DATE)
    OR (session = CAST(local AS DATE) AND CAST(local AS TIME) <= TIME '13:30:00')) AS effective FROM pub p)"""


def events_of(spark, d):
    return A.publications(spark, d)


def effective(spark, d):
    return calendars.assign_sessions(events_of(spark, d), A.quotes(spark, d).select("session").distinct(), ZONE, 13, 30)


@query("c6_assign_sessions", f"WITH {QUOTES} SELECT event_id, effective FROM eff")
def c6(spark, d):
    return effective(spark, d).select("event_id", "effective")


@query("c7_reaction_labels", f"""WITH {QUOTES}, h(horizon, h) AS (VALUES ('next_session', 1), ('3d', 3)),
x AS (SELECT e.*, h.horizon, s.idx AS at0, a.session AS s0, a.bench AS b0, z.session AS s1, z.bench AS b1 FROM eff e CROSS JOIN h
  LEFT JOIN ses s ON s.session = e.effective LEFT JOIN ses a ON a.idx = s.idx - 1 LEFT JOIN ses z ON z.idx = s.idx + h.h - 1),
y AS (SELECT x.*, p.price AS p0, q.price AS p1, q.price / nullif(p.price, 0) - 1 AS raw, b1 / nullif(b0, 0) - 1 AS market FROM x
  LEFT JOIN quotes p ON p.ticker = x.ticker AND p.session = s0 LEFT JOIN quotes q ON q.ticker = x.ticker AND q.session = s1),
w AS (SELECT *, CASE WHEN at0 IS NULL THEN 'ABSTAIN_NO_SESSION' WHEN s0 IS NULL THEN 'ABSTAIN_NO_ANCHOR' WHEN s1 IS NULL THEN 'ABSTAIN_INCOMPLETE_HORIZON'
  WHEN p0 IS NULL OR p1 IS NULL THEN 'ABSTAIN_MISSING_STOCK_PRICE' WHEN abs(raw) > 0.25 THEN 'ABSTAIN_PRICE_ANOMALY' END AS reason FROM y)
SELECT event_id, horizon, reason, CASE WHEN reason IS NULL THEN round(raw, 8) END AS raw, CASE WHEN reason IS NULL THEN round(market, 8) END AS market,
  CASE WHEN reason IS NULL THEN round(raw - market, 8) END AS abnormal, CASE WHEN reason IS NULL THEN CASE WHEN raw - market > 0.05 THEN 'POSITIVE_REACTION'
  WHEN raw - market < -0.05 THEN 'NEGATIVE_REACTION' ELSE 'NEUTRAL_REACTION' END END AS label FROM w""")
def c7(spark, d):
    rows = reactions.reaction_labels(events_of(spark, d), A.quotes(spark, d), {"next_session": 1, "3d": 3}, 0.05, 0.25, ZONE, 13, 30)
    return rows.select("event_id", "horizon", "reason", r("raw", 8), r("market", 8), r("abnormal", 8), "label")


WINDOWS = f"""{QUOTES}, m AS (SELECT p.*, hour(local) * 60 + minute(local) AS mi, (SELECT min(session) FROM ses WHERE session >= CAST(local AS DATE)) AS s FROM pub p),
sq AS (SELECT session, lag(session) OVER (ORDER BY session) AS pv, lead(session) OVER (ORDER BY session) AS nx FROM ses),
win AS (SELECT m.*, coalesce(s = CAST(local AS DATE) AND mi >= 540 AND mi < 810, FALSE) AS abstained,
  CASE WHEN s = CAST(local AS DATE) AND mi >= 540 AND mi < 810 THEN NULL WHEN s = CAST(local AS DATE) AND mi >= 810 THEN s ELSE pv END AS before,
  CASE WHEN s = CAST(local AS DATE) AND mi >= 540 AND mi < 810 THEN NULL WHEN s = CAST(local AS DATE) AND mi >= 810 THEN nx ELSE s END AS after
  FROM m LEFT JOIN sq ON sq.session = m.s)"""


def windows(spark, d):
    return calendars.reaction_window(events_of(spark, d), A.quotes(spark, d).select("session").distinct(), ZONE, 540, 810)


@query("c8_reaction_window", f"WITH {WINDOWS} SELECT event_id, abstained, before, after FROM win")
def c8(spark, d):
    return windows(spark, d).select("event_id", "abstained", "before", "after")


@query("d31_window_rows", f"""WITH {WINDOWS}, c AS (SELECT ticker, before, after, event_class, count(*) AS n, arg_min(confidence, row(published_at, event_id)) AS conf,
  arg_min(event_id, row(published_at, event_id)) AS ev FROM win WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY ALL)
SELECT ticker, before, after, CAST(sum(n) AS BIGINT) AS n_events, round(avg(conf), 6) AS mean_confidence, arg_min(event_class, row(-n, event_class)) AS dominant,
  min(ev) AS first_event FROM c GROUP BY ALL""")
def d31(spark, d):
    rows = reactions.window_rows(windows(spark, d).where("before IS NOT NULL AND after IS NOT NULL"))
    return rows.select("ticker", "before", "after", "n_events", r("mean_confidence"), "dominant", "first_event")


@query("d30_sufficiency", f"""WITH {WINDOWS}, f AS (SELECT count(DISTINCT (ticker, before, after)) AS windows, count(DISTINCT ticker) AS tickers,
  count(DISTINCT event_class) AS classes, avg(confidence) AS mc FROM win WHERE before IS NOT NULL AND after IS NOT NULL)
SELECT 'windows' AS "check", CAST(windows AS DOUBLE) AS found, 50.0 AS least, windows >= 50 AS passed FROM f
UNION ALL SELECT 'tickers', tickers, 10.0, tickers >= 10 FROM f UNION ALL SELECT 'classes', classes, 7.0, classes >= 7 FROM f
UNION ALL SELECT 'mean_confidence', round(mc, 6), 0.3, mc >= 0.3 FROM f""")
def d30(spark, d):
    rows = windows(spark, d).where("before IS NOT NULL AND after IS NOT NULL")
    out = reactions.sufficiency(rows, {"windows": 50, "tickers": 10, "classes": 7, "mean_confidence": 0.3})
    return out.select("check", r("found"), "least", "passed")


PROBS = """sc AS (SELECT *, exp(value / 50 - 1) AS up, exp(-value / 50) AS dn FROM eff),
sp AS (SELECT *, up / (up + dn + 1) AS pos, 1 / (up + dn + 1) AS neu, dn / (up + dn + 1) AS neg, confidence AS weight FROM sc)"""


def with_probs(rows):
    return rows.select("*", *reactions.sentiment(F.col("value")), F.col("confidence").alias("weight"))


@query("d1_daily_sentiment", f"""WITH {QUOTES}, {PROBS} SELECT ticker, CAST(local AS DATE) AS day, count(*) AS n, round(avg(pos), 6) AS mean_pos,
  round(avg(neu), 6) AS mean_neu, round(avg(neg), 6) AS mean_neg, round(avg(pos - neg), 6) AS mean_score,
  round(sum((pos - neg) * weight) / nullif(sum(weight), 0), 6) AS weighted, round(avg(CASE WHEN pos = greatest(pos, neu, neg) THEN 1.0 ELSE 0 END), 6) AS ratio_pos,
  round(avg(CASE WHEN neg = greatest(pos, neu, neg) THEN 1.0 ELSE 0 END), 6) AS ratio_neg FROM sp GROUP BY 1, 2""")
def d1(spark, d):
    rows = reactions.daily_sentiment(with_probs(events_of(spark, d)), ZONE)
    return rows.select("ticker", "day", "n", *(r(c) for c in rows.columns[3:]))


def frame(n):
    return f"(PARTITION BY ticker ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def frame_sql(n):
    f = frame(n)
    return f"""CAST(sum(c) OVER {f} AS BIGINT) AS n_{n}, round(sum(s) OVER {f} / nullif(sum(c) OVER {f}, 0), 6) AS mean_{n},
  round(sqrt(greatest(sum(ss) OVER {f} / nullif(sum(c) OVER {f}, 0) - pow(sum(s) OVER {f} / nullif(sum(c) OVER {f}, 0), 2), 0)), 5) AS std_{n},
  round(sum(sw) OVER {f} / nullif(sum(w) OVER {f}, 0), 6) AS weighted_{n}"""


@query("d2_session_sentiment", f"""WITH {QUOTES}, {PROBS}, g AS (SELECT ticker, effective AS session, count(*) AS c, sum(pos - neg) AS s, sum((pos - neg) ** 2) AS ss,
  sum((pos - neg) * weight) AS sw, sum(weight) AS w FROM sp WHERE effective IS NOT NULL GROUP BY 1, 2),
f AS (SELECT q.ticker, q.session, coalesce(c, 0) AS c, coalesce(s, 0) AS s, coalesce(ss, 0) AS ss, coalesce(sw, 0) AS sw, coalesce(w, 0) AS w FROM quotes q LEFT JOIN g USING (ticker, session))
SELECT ticker, session, {frame_sql(1)}, {frame_sql(3)}, {frame_sql(5)} FROM f""")
def d2(spark, d):
    rows = reactions.session_sentiment(with_probs(effective(spark, d)), A.quotes(spark, d), [1, 3, 5])
    out = [c for n in (1, 3, 5) for c in (F.col(f"n_{n}"), r(f"mean_{n}"), r(f"std_{n}", 5), r(f"weighted_{n}"))]
    return rows.select("ticker", "session", *out)


@query("j6_gate_signal", """WITH s AS (SELECT event_id, ts AS published_at, ts + (user_id % 5 - 1) * INTERVAL 6 HOUR AS available_at,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END AS score FROM events),
t AS (SELECT *, CASE WHEN score IS NULL THEN 'ABSTAIN_NO_SCORE' WHEN available_at < published_at THEN 'ABSTAIN_ORDER'
  WHEN available_at > TIMESTAMP '2024-01-20 05:30:00' THEN 'ABSTAIN_NOT_AVAILABLE' ELSE 'EXPOSED' END AS status FROM s)
SELECT event_id, status, CASE WHEN status = 'EXPOSED' THEN score END AS shown, CASE WHEN status = 'EXPOSED' THEN
  CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.4 THEN 'MIDDLE' ELSE 'LOW' END END AS band FROM t""")
def j6(spark, d):
    shift = F.make_dt_interval(hours=((F.pmod("user_id", F.lit(5)) - 1) * 6).cast("int"))
    rows = events_of(spark, d).select(
        "event_id", "published_at", (F.col("published_at") + shift).alias("available_at"), F.when(F.col("event_id") % 11 != 0, F.col("confidence")).alias("score"),
    )
    cutoff = F.lit("2024-01-20 05:30:00").cast("timestamp")
    return reactions.gate_signal(rows, cutoff, 0.4, 0.8).select("event_id", "status", "shown", "band")


@query("d33_feed_batches", """SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY CUBE (event_type, CAST(ts AS DATE))""")
def d33(spark, d):
    rows = A.table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return rows.cube("event_type", "day").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def landed(spark, d, tag):
    path = jobs.work_dir(spark, tag)
    events = A.table(spark, d, "events")
    jobs.land(events, f"{path}/landed")
    return jobs.event_stream(spark, f"{path}/landed", events.schema), path


def collected(spark, d, tag, reason=None):
    """The events landed in files and taken in by one run; the schema and the folder for what else the log tells."""
    stream, path = landed(spark, d, tag)
    return commits.collect(stream, path, "run-1", ["event_id"], reason), stream.schema, path


@query("j1_ingest_stream", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def j1(spark, d):
    rows, _, _ = collected(spark, d, "j1")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def odd():
    """The reason to reject an event; made when a query runs, as a registry is read without a session."""
    return F.when(F.col("value").isNull(), "no_value").when(F.col("value") > 150, "large_value").when(F.col("user_id") % 97 == 0, "blocked_user")


@query("j1_quarantine", """SELECT event_type, CASE WHEN value IS NULL THEN 'no_value' WHEN value > 150 THEN 'large_value' WHEN user_id % 97 = 0 THEN 'blocked_user' ELSE 'stored' END AS reason,
  count(*) AS n FROM events GROUP BY 1, 2""")
def j1_quarantine(spark, d):
    """Rejects by reason beside what was stored: together every row that came in."""
    rows, schema, path = collected(spark, d, "j1q", odd())
    every = rows.select("event_type", F.lit("stored").alias("reason")).unionByName(commits.quarantined(spark, path, schema).select("event_type", "reason"))
    return every.groupBy("event_type", "reason").agg(F.count("*").alias("n"))


@query("j1_run_records", """SELECT 'run-1' AS run, CASE WHEN count(*) FILTER (WHERE value > 150 OR value IS NULL OR user_id % 97 = 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
  count(*) AS n_in, count(*) FILTER (WHERE value <= 150 AND user_id % 97 <> 0) AS n_fresh, count(*) FILTER (WHERE value > 150 OR value IS NULL OR user_id % 97 = 0) AS n_rejected FROM events""")
def j1_runs(spark, d):
    _, _, path = collected(spark, d, "j1r", odd())
    return commits.runs(spark, path).select("run", "status", "n_in", "n_fresh", "n_rejected")


@query("j2_dedup_stream", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def j2(spark, d):
    stream, path = landed(spark, d, "j2")
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = jobs.run_to_parquet(jobs.dedup_stream(doubled, ["event_id"]), path)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("j3_stream_sessions", f"WITH {QUOTES} SELECT event_id, effective FROM eff")
def j3(spark, d):
    """The stream joined to the static day map: no state."""
    stream, path = landed(spark, d, "j3")
    sessions = A.quotes(spark, d).select("session").distinct()
    placed = calendars.assign_sessions(stream, sessions, ZONE, 13, 30, at="ts")
    return jobs.run_to_parquet(placed.select("event_id", "effective"), path)


@query("j4_daily_stream", """WITH w AS (SELECT date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR AS start, event_type, value FROM events),
m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w, m WHERE start + INTERVAL 1 DAY <= mark GROUP BY 1, 2""")
def j4(spark, d):
    stream, path = landed(spark, d, "j4")
    return jobs.run_to_parquet(jobs.daily_sums(stream), path)


@query("j5_sliding_activity", """WITH s AS (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS start, event_type FROM events, range(0, 5) t(k)), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT start, event_type, count(*) AS n FROM s, m WHERE start + INTERVAL 5 DAY <= mark GROUP BY 1, 2""")
def j5(spark, d):
    stream, path = landed(spark, d, "j5")
    return jobs.run_to_parquet(jobs.sliding_activity(stream), path)


@query("j5_user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, s""")
def j5_sessions(spark, d):
    return jobs.sessions_of(A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("j5_closed_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events),
x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, s)
SELECT user_id, start, "end", n FROM x, m WHERE "end" < mark""")
def j5_closed(spark, d):
    """The same sessions out of a stream with state and timers, as far as the watermark has closed them."""
    stream, path = landed(spark, d, "j5c")
    return jobs.run_to_parquet(sessions.closed_sessions(stream), path)


@query("j7_run_manifest", """WITH b AS (SELECT event_type, ts, md5(CAST(event_id AS VARCHAR)) AS h FROM events)
SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last, sha256(concat_ws('|', count(*),
  sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)), sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)))) AS digest FROM b GROUP BY 1""")
def j7(spark, d):
    """The manifests of all committed micro-batches, rolled up."""
    _, schema, path = collected(spark, d, "j7")
    return commits.manifests(spark, path, schema)
