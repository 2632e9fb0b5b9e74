"""Queries over documents, pages and labels: scalar functions, dedup, matching, votes, audits, parsers and sinks."""

from pyspark.sql import functions as F

from panelspark.functions import text as T
from panelspark.operators import newsroom as N
from panelspark.plans.market import r
from panelspark.plans.registering import BARS, query
from panelspark.sources import adapters as A
from panelspark.sources import parsers, sinks
from panelspark.streaming.jobs import work_dir

NEWS = """news AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS summary, text, lang, source,
  TIMESTAMP '2024-01-01' + doc_id * INTERVAL 7 MINUTE AS published_at,
  CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM documents)"""


def news(spark, d):
    return A.news(spark, d).withColumnRenamed("doc_id", "id")


def batches(rows, key, size=10_000):
    """Adds ``batch``, a hash bucket; the number of buckets follows that of the rows, so that none outgrows a payload."""
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(rows.count() // size + 1)))


def q(name, sql):
    return query(name, f"WITH {NEWS} {sql}")


@query("b1_norm_ticker", """SELECT l_suppkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST(l_suppkey AS VARCHAR) WHEN l_linenumber = 2 THEN 'X' || l_suppkey
  WHEN l_linenumber = 3 THEN CAST(l_suppkey AS VARCHAR) END AS ticker FROM lineitem""")
def b1(spark, d):
    rows = A.table(spark, d, "lineitem")
    raw = F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" '"), F.col("l_suppkey").cast("string"), F.lit(".tw "))).when(
        F.col("l_linenumber") == 2, F.concat(F.lit("x"), F.col("l_suppkey").cast("string"), F.lit(".TWO"))).when(
        F.col("l_linenumber") == 3, F.col("l_suppkey").cast("string")).otherwise(F.concat(F.lit("?"), F.col("l_suppkey").cast("string")))
    return rows.select("l_suppkey", "l_linenumber", T.norm_ticker(raw).alias("ticker"))


@q("b9_language_routing", "SELECT source, count(*) FILTER (WHERE lower(lang) IN ('en', 'de') OR lower(lang) LIKE 'en-%' OR lower(lang) LIKE 'de-%') AS supported, count(*) AS n FROM news GROUP BY 1")
def b9(spark, d):
    return news(spark, d).groupBy("source").agg(F.count_if(T.supports_language(F.col("lang"), ("en", "de"))).alias("supported"), F.count("*").alias("n"))


@q("h1_norm_title", r"""SELECT id, sha256(regexp_replace(replace(lower(nfc_normalize(title)), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}_]+', '', 'g')) AS fingerprint FROM news""")
def h1(spark, d):
    return news(spark, d).select("id", T.fingerprint(F.col("title")).alias("fingerprint"))


@query("h2_canonical_url", r"""WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
s AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS h, regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS p,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains(['fbclid', 'gclid', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source'], lower(split_part(x, '=', 1))))) AS k FROM p)
SELECT page_id, h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(k) = 0 THEN '' ELSE '?' || array_to_string(k, '&') END AS url FROM s""")
def h2(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@q("h3_stable_id", "SELECT id, sha256(source || chr(31) || lang || chr(31) || title) AS stable_id FROM news")
def h3(spark, d):
    return news(spark, d).select("id", T.stable_id(F.col("source"), F.col("lang"), F.col("title")).alias("stable_id"))


@q("h5_norm_line", r"""SELECT id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM news""")
def h5(spark, d):
    return news(spark, d).select("id", F.sha2(T.norm_line(F.col("text")), 256).alias("h"))


@query("h6_parse_roc_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def h6(spark, d):
    rows = A.table(spark, d, "orders")
    y = (F.year("o_orderdate") - 1911).cast("string")
    m, n = F.date_format("o_orderdate", "MM"), F.date_format("o_orderdate", "dd")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("/", y, m, n)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lpad(y, 3, "0"), m, n)).otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    return rows.select("o_orderkey", T.parse_roc_date(raw).alias("day"))


@query("h7_excerpt", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM b)
SELECT page_id, nullif(substr(trim(regexp_replace(t, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 500), '') AS excerpt FROM c""")
def h7(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.excerpt(F.col("html")).alias("excerpt"))


@query("h8_quantised", "SELECT o_orderkey, round_even(o_totalprice / 7, 2) AS v FROM orders")
def h8(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", T.quantised(F.col("o_totalprice") / 7, 2).alias("v"))


@query("h9_row_hash", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS h FROM labels""")
def h9(spark, d):
    return A.table(spark, d, "labels").select("doc_id", T.row_hash("toxic", "doc_id", "quality").alias("h"))


@q("h10_shingles", r"""SELECT id, len(list_distinct(list_transform(range(1, greatest(length(c) - 3, 1)), lambda i: substr(c, i, 5)))) AS n FROM (SELECT id, regexp_replace(text, '\s+', '', 'g') AS c FROM news)""")
def h10(spark, d):
    return news(spark, d).select("id", F.size(T.shingles(F.col("text"), 5)).cast("long").alias("n"))


LEXICON = (("tion",), ("ing",), ("er",))
LEXICON_SQL = """, s AS (SELECT id, (length(summary) - length(replace(summary, 'tion', ''))) / 4 AS p0, (length(summary) - length(replace(summary, 'ertion', ''))) / 6 AS p1,
  (length(summary) - length(replace(summary, 'ing', ''))) / 3 AS n0, (length(summary) - length(replace(summary, 'ering', ''))) / 5 AS n1 FROM news),
x AS (SELECT id, p0 - 2 * p1 AS up, n0 - 2 * n1 AS dn, CASE WHEN p0 - 2 * p1 = n0 - 2 * n1 THEN p0 - 2 * p1 + 1 ELSE 0 END AS mid FROM s),
y AS (SELECT id, exp(up - greatest(up, mid, dn)) AS a, exp(mid - greatest(up, mid, dn)) AS b, exp(dn - greatest(up, mid, dn)) AS c FROM x),
lex AS (SELECT id, round(a / (a + b + c), 6) AS pos, round(b / (a + b + c), 6) AS neu, round(c / (a + b + c), 6) AS neg FROM y)"""


@q("h12_lexicon_sentiment", f"{LEXICON_SQL} SELECT * FROM lex")
def h12(spark, d):
    s = T.lexicon_sentiment(F.col("summary"), *LEXICON)
    return news(spark, d).select("id", s.alias("s")).select("id", *(F.round(f"s.{c}", 6).alias(c) for c in ("pos", "neu", "neg")))


FAMILIES = {"A": ("erth", "eaon"), "B": ("thth",), "C": ("onon", "ndnd")}


@q("h13_rule_vote", """, m AS (SELECT id, regexp_matches(title, 'erth|eaon') AS a, regexp_matches(title, 'thth') AS b, regexp_matches(title, 'onon|ndnd') AS c,
  regexp_matches(title, 'tion') AS p, regexp_matches(title, 'ing') AS n FROM news),
v AS (SELECT id, CASE WHEN a::INT + b::INT + c::INT = 1 THEN CASE WHEN a THEN 'A' WHEN b THEN 'B' ELSE 'C' END END AS event_type,
  CASE WHEN p AND n THEN 'AMBIGUOUS' WHEN p THEN 'POSITIVE' WHEN n THEN 'NEGATIVE' END AS impact FROM m)
SELECT id, event_type, impact, CASE WHEN event_type IS NULL AND impact IS NULL THEN 0.0 ELSE 0.8 END AS confidence FROM v""")
def h13(spark, d):
    v = T.rule_vote(F.col("title"), FAMILIES, ("tion",), ("ing",))
    return news(spark, d).select("id", v.alias("v")).select("id", "v.event_type", "v.impact", "v.confidence")


@q("h14_cue_terms", """SELECT id, array_to_string(list_filter(['and', 'erth', 'tion'], lambda t: contains(title, t)), ',') AS cues FROM news""")
def h14(spark, d):
    return news(spark, d).select("id", F.array_join(T.cue_terms(F.col("title"), ("tion", "erth", "and")), ",").alias("cues"))


@q("h15_model_text", "SELECT id, length(CASE WHEN trim(summary) = '' OR trim(summary) = trim(title) THEN trim(title) ELSE trim(title) || chr(10) || trim(summary) END) AS n FROM news")
def h15(spark, d):
    return news(spark, d).select("id", F.length(T.model_text(F.col("title"), F.col("summary"))).cast("long").alias("n"))


@query("h21_meta", "SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS k, nullif(trim(json_extract_string(props, '$.missing')), '') AS m FROM events")
def h21(spark, d):
    return A.table(spark, d, "events").select("event_id", T.meta(F.col("props"), "k").alias("k"), T.meta(F.col("props"), "missing").alias("m"))


@q("e21_dedup_first", "SELECT min(id) AS id, count(*) AS n FROM news GROUP BY md5(text)")
def e21(spark, d):
    rows = news(spark, d).withColumn("h", F.md5("text"))
    sizes = rows.groupBy("h").agg(F.count("*").alias("n"))
    return N.dedup_first(rows, ["h"], ["id"]).join(sizes, "h").select("id", "n")


FAMILY = """, fam AS (SELECT id, source || '/' || (id % 40) AS family, CAST(published_at AS DATE) AS day FROM news),
anc AS (SELECT *, max(day) OVER (PARTITION BY family) AS anchor FROM fam),
spl AS (SELECT *, CASE WHEN anchor <= DATE '2024-01-05' THEN 'train' WHEN anchor <= DATE '2024-01-05' THEN 'validation' ELSE 'test' END AS split FROM anc)"""


def families(spark, d):
    rows = news(spark, d).withColumns({"family": F.concat_ws("/", "source", (F.col("id") % 40).cast("string")), "day": F.to_date("published_at")}).drop("split")
    return N.family_split(rows, "family", "day", "2024-01-05", "2024-01-05")


@q("e22_family_split", f"{FAMILY} SELECT id, anchor, split FROM spl")
def e22(spark, d):
    return families(spark, d).select("id", "anchor", "split")


@q("g3_split_leakage", "SELECT md5(text) AS h, count(DISTINCT split) AS n_splits FROM news GROUP BY 1 HAVING count(DISTINCT split) > 1")
def g3(spark, d):
    return N.split_leakage(news(spark, d).withColumn("h", F.md5("text")), "h")


@q("g2_set_difference", "SELECT DISTINCT source, lang FROM news WHERE id % 2 = 0 EXCEPT SELECT source, lang FROM news WHERE id % 3 = 0")
def g2(spark, d):
    rows = news(spark, d)
    return rows.where("id % 2 = 0").select("source", "lang").subtract(rows.where("id % 3 = 0").select("source", "lang"))


@query("g1_union_sources", """SELECT 'doc' AS feed, count(*) AS n, count(lang) AS with_lang FROM documents UNION ALL SELECT 'page', count(*), 0 FROM pages""")
def g1(spark, d):
    docs = A.table(spark, d, "documents").select(F.lit("doc").alias("feed"), F.col("doc_id").alias("id"), "lang")
    pages = A.table(spark, d, "pages").select(F.lit("page").alias("feed"), F.col("page_id").alias("id"))
    return docs.unionByName(pages, allowMissingColumns=True).groupBy("feed").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"))


@q("g4_distinct_ids", "SELECT DISTINCT source, lang FROM news")
def g4(spark, d):
    return news(spark, d).select("source", "lang").distinct()


@q("f1_recent", "SELECT source, id, rank FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id DESC) AS rank FROM news) WHERE rank <= 5")
def f1(spark, d):
    return N.recent(news(spark, d), 5).select("source", "id", "rank")


@q("f2_hash_sample", "SELECT id, sha256(CAST(id AS VARCHAR)) AS h FROM news ORDER BY 2, 1 LIMIT 50")
def f2(spark, d):
    return N.hash_sample(news(spark, d), "id", 50).select("id", "h")


@q("c3_pending_pairs", "SELECT id, source FROM news WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = id)")
def c3(spark, d):
    done = A.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return N.pending_pairs(news(spark, d).select("id", "source"), done, ["id"])


@q("c1_scored_events", "SELECT n.id, n.source, l.quality FROM news n JOIN labels l ON l.doc_id = n.id JOIN pages p ON p.page_id = n.id WHERE n.published_at >= '2024-01-01 06:00:00' AND n.published_at < '2024-01-02 12:00:00'")
def c1(spark, d):
    at = F.col("published_at")
    rows = news(spark, d).where((at >= F.lit("2024-01-01 06:00:00").cast("timestamp")) & (at < F.lit("2024-01-02 12:00:00").cast("timestamp")))
    labels = A.table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    pages = A.table(spark, d, "pages").select(F.col("page_id").alias("id"))
    return rows.join(labels, "id").join(pages, "id").select("id", "source", "quality")


@q("c2_left_versions", "SELECT n.id, l.quality FROM news n LEFT JOIN labels l ON l.doc_id = n.id AND l.toxic = 0")
def c2(spark, d):
    rows, labels = news(spark, d), A.table(spark, d, "labels")
    return rows.join(labels, (labels["doc_id"] == rows["id"]) & (labels["toxic"] == 0), "left").select("id", "quality")


@q("c14_near_dup_pairs", r""", t AS (SELECT id, split, left(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')), 4000) AS plain FROM news),
k AS (SELECT plain, min(id) AS id, list_sort(list(DISTINCT split)) AS splits FROM t WHERE length(plain) >= 20 GROUP BY plain),
c AS (SELECT id, splits, left(regexp_replace(plain, '[^0-9a-z\x{3400}-\x{9fff}]+', '', 'g'), 2000) AS c FROM k),
s AS (SELECT id, splits, list_distinct(list_transform(range(1, greatest(length(c) - 3, 2)), lambda i: substr(c, i, 5))) AS s FROM c WHERE c <> ''),
g AS (SELECT id, splits, len(s) AS m, unnest(s) AS g FROM s),
p AS (SELECT a.id AS l, b.id AS r, any_value(a.m) AS m, any_value(b.m) AS n, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.id < b.id
  AND a.m >= 0.7 * b.m AND b.m >= 0.7 * a.m AND NOT (len(a.splits) = 1 AND a.splits = b.splits) GROUP BY 1, 2)
SELECT l AS "left", r AS "right", round(i / (m + n - i), 6) AS jaccard FROM p WHERE i / (m + n - i) >= 0.7""")
def c14(spark, d):
    return N.cross_split_pairs(news(spark, d)).select("left", "right", r("jaccard"))


@query("c14_audit_pairs")
def c14_audit(spark, d):
    """With the ratio of matching blocks as the last step."""
    return N.audit_pairs(news(spark, d)).withColumn("jaccard", r("jaccard"))


@query("c13_fuzzy_dups")
def c13(spark, d):
    return N.fuzzy_dups(news(spark, d))


@q("c20_match_entities", """, a(ticker, alias) AS (VALUES ('the', 'erth'), ('and', 'onnt'), ('of', 'ingre')), m AS (SELECT id, ticker,
  CASE WHEN id % 50 = 0 AND ticker = 'and' THEN 1.0 WHEN regexp_matches(title, '(^|[^A-Za-z0-9])' || ticker || '($|[^A-Za-z0-9])') THEN 0.95 WHEN contains(title, alias) THEN 0.9
  WHEN regexp_matches(text, '(^|[^A-Za-z0-9])' || ticker || '($|[^A-Za-z0-9])') THEN 0.75 WHEN contains(text, alias) THEN 0.65 END AS score FROM news, a)
SELECT id, ticker, CAST(score AS DOUBLE) AS score FROM m WHERE score IS NOT NULL""")
def c20(spark, d):
    made = F.array(*(F.struct(F.lit(t).alias("ticker"), F.lit(a).alias("alias")) for t, a in (("the", "erth"), ("and", "onnt"), ("of", "ingre"))))
    aliases = spark.range(1).select(F.explode(made).alias("a")).select("a.*")
    rows = news(spark, d).withColumns({"summary": F.col("text"), "own": F.when(F.col("id") % 50 == 0, F.array(F.lit("and"))).otherwise(F.array().cast("array<string>"))})
    return N.match_entities(rows, aliases, "own").select("id", "ticker", "score")


@query("c15_compare_panels", f"""WITH {BARS}, a AS (SELECT * FROM bars WHERE ticker <> '5'), b AS (SELECT ticker, session, close + CASE WHEN volume % 4 = 0 THEN 0.5 ELSE 0 END AS close, volume FROM bars WHERE ticker <> '7'),
j AS (SELECT a.ticker AS ta, b.ticker AS tb, a.close AS ca, b.close AS cb, a.volume AS va, b.volume AS vb FROM a FULL JOIN b ON a.ticker = b.ticker AND a.session = b.session),
u AS (SELECT 'close' AS field, ta, tb, ca AS u, cb AS v FROM j UNION ALL SELECT 'volume', ta, tb, va, vb FROM j)
SELECT field, count(*) FILTER (WHERE ta IS NOT NULL AND tb IS NOT NULL) AS n_both, count(*) FILTER (WHERE ta IS NOT NULL AND tb IS NOT NULL AND u = v) AS n_exact,
  round(max(abs(u - v)), 6) AS max_diff, round(quantile_cont(abs(u - v), 0.5), 6) AS median_diff, count(*) FILTER (WHERE tb IS NULL) AS only_a, count(*) FILTER (WHERE ta IS NULL) AS only_b FROM u GROUP BY field""")
def c15(spark, d):
    bars = A.bars(spark, d).select("ticker", "session", "close", "volume")
    moved = bars.where("ticker <> '7'").withColumn("close", F.col("close") + F.when(F.col("volume") % 4 == 0, 0.5).otherwise(0.0))
    out = N.compare_panels(bars.where("ticker <> '5'"), moved, ["ticker", "session"], ["close", "volume"])
    return out.select("field", "n_both", "n_exact", r("max_diff"), r("median_diff"), "only_a", "only_b")


@query("a11_upsert_bars", f"""WITH {BARS}, e AS (SELECT * FROM bars WHERE ticker <> '5'), i AS (SELECT ticker, session, close, volume + 1 AS volume,
  adj + CASE WHEN volume % 2 = 0 THEN 0.004 ELSE 0.5 END AS adj FROM bars WHERE session >= '1999-01-01')
SELECT coalesce(i.ticker, e.ticker) AS ticker, coalesce(i.session, e.session) AS session, coalesce(i.close, e.close) AS close, coalesce(i.volume, e.volume) AS volume,
  round(CASE WHEN abs(e.adj - i.adj) <= 0.005 AND abs(e.close - i.close) <= 1e-6 THEN e.adj ELSE coalesce(i.adj, e.adj) END, 6) AS adj,
  CASE WHEN e.ticker IS NULL THEN 'insert' WHEN i.ticker IS NULL THEN 'keep' ELSE 'update' END AS change
FROM e FULL JOIN i ON e.ticker = i.ticker AND e.session = i.session""")
def a11(spark, d):
    bars = A.bars(spark, d).select("ticker", "session", "close", "volume", "adj")
    incoming = bars.where("session >= '1999-01-01'").withColumns({
        "adj": F.col("adj") + F.when(F.col("volume") % 2 == 0, 0.004).otherwise(0.5), "volume": F.col("volume") + 1})
    return N.upsert_bars(bars.where("ticker <> '5'"), incoming).withColumn("adj", F.round("adj", 6))


@query("c19_snapshot_diff", """WITH o AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0)
SELECT c_custkey, o.v AS old, n.v AS new, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'updated' END AS kind FROM o FULL JOIN n USING (c_custkey)
WHERE o.v IS NULL OR n.v IS NULL OR o.v <> n.v""")
def c19(spark, d):
    rows = A.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    moved = F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("v"))
    return N.snapshot_diff(rows.where("c_custkey % 5 <> 0"), rows.where("c_custkey % 7 <> 0").withColumn("v", moved), ["c_custkey"], "v")


@query("c18_pair_reviews", """WITH a AS (SELECT doc_id, quality AS q FROM labels WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, 1 - toxic AS q FROM labels WHERE doc_id % 8 <> 0)
SELECT CASE WHEN a.q IS NULL THEN 'missing_a' WHEN b.q IS NULL THEN 'missing_b' WHEN a.q = b.q THEN 'agree' ELSE 'conflict' END AS status, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def c18(spark, d):
    labels = A.table(spark, d, "labels")
    a = labels.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("candidate_id"), F.col("quality").alias("label"))
    b = labels.where("doc_id % 8 <> 0").select(F.col("doc_id").alias("candidate_id"), (1 - F.col("toxic")).alias("label"))
    return N.pair_reviews(a, b).groupBy("status").agg(F.count("*").alias("n"))


def votes(spark, d):
    """Three labelling functions over titles."""
    v = T.rule_vote(F.col("title"), FAMILIES, ("tion",), ("ing",))
    rows = news(spark, d).select(F.col("id").alias("input_id"), "title", v.alias("v"))
    one = rows.select("input_id", F.lit("rules").alias("function_id"), "v.impact", "v.confidence")
    word = lambda n, a, b: rows.select(
        "input_id", F.lit(n).alias("function_id"), F.when(F.contains("title", F.lit(a)), "POSITIVE").when(F.contains("title", F.lit(b)), "NEGATIVE").alias("impact"),
        F.when(F.contains("title", F.lit(a)) | F.contains("title", F.lit(b)), 0.6).otherwise(0.0).alias("confidence"))
    return one.unionByName(word("first", "erth", "onth")).unionByName(word("second", "anth", "that"))


VOTES = """, vt AS (SELECT id AS input_id, 'rules' AS function_id, CASE WHEN regexp_matches(title, 'tion') AND regexp_matches(title, 'ing') THEN 'AMBIGUOUS'
    WHEN regexp_matches(title, 'tion') THEN 'POSITIVE' WHEN regexp_matches(title, 'ing') THEN 'NEGATIVE' END AS impact, 0.8 AS confidence, 1.0 AS weight FROM news
  UNION ALL SELECT id, 'first', CASE WHEN contains(title, 'erth') THEN 'POSITIVE' WHEN contains(title, 'onth') THEN 'NEGATIVE' END, 0.6, 0.5 FROM news
  UNION ALL SELECT id, 'second', CASE WHEN contains(title, 'anth') THEN 'POSITIVE' WHEN contains(title, 'that') THEN 'NEGATIVE' END, 0.6, 0.75 FROM news),
vs AS (SELECT input_id, impact, sum(weight * confidence) AS s, count(*) AS c FROM vt WHERE impact IS NOT NULL GROUP BY 1, 2),
vr AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY s DESC, impact DESC) AS k, sum(s) OVER (PARTITION BY input_id) AS w, sum(c) OVER (PARTITION BY input_id) AS n, count(*) OVER (PARTITION BY input_id) AS m FROM vs),
va AS (SELECT input_id, max(impact) FILTER (WHERE k = 1) AS top, max(s / w) FILTER (WHERE k = 1) AS a, coalesce(max(s / w) FILTER (WHERE k = 2), 0) AS b,
  max(c / n) FILTER (WHERE k = 1) AS agreement, any_value(n) AS n, CASE WHEN any_value(m) > 1 THEN -sum(s / w * ln(s / w)) / ln(any_value(m)) ELSE 0 END AS e FROM vr GROUP BY 1)"""


@q("d25_aggregate_votes", f"""{VOTES} SELECT i.id AS input_id, CASE WHEN coalesce(n, 0) < 2 THEN NULL WHEN a - b < 0.2 THEN 'AMBIGUOUS' ELSE top END AS label,
  CASE WHEN coalesce(n, 0) < 2 THEN 'INSUFFICIENT_INDEPENDENT_SOURCES' WHEN a - b < 0.2 THEN 'VOTE_CONFLICT' END AS reason, round(agreement, 6) AS agreement,
  CASE WHEN n IS NULL THEN NULL ELSE round(e, 6) END AS entropy, CAST(coalesce(n, 0) AS BIGINT) AS n_signals FROM news i LEFT JOIN va ON va.input_id = i.id""")
def d25(spark, d):
    made = F.array(*(F.struct(F.lit(n).alias("function_id"), F.lit(w).alias("weight")) for n, w in (("rules", 1.0), ("first", 0.5), ("second", 0.75))))
    weights = spark.range(1).select(F.explode(made).alias("w")).select("w.*")
    return N.aggregate_votes(votes(spark, d), weights).select("input_id", "label", "reason", r("agreement"), r("entropy"), "n_signals")


@q("d26_text_audit", r""", k AS (SELECT split, length(text) AS n, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM news), s AS (SELECT h, count(DISTINCT split) AS s, count(*) AS c FROM k GROUP BY h)
SELECT split, count(*) AS n, count(*) FILTER (WHERE k.n = 0) AS empty, count(*) FILTER (WHERE s > 1) AS cross_split, count(*) FILTER (WHERE c > 1) AS repeated, min(k.n) AS min_length,
  quantile_cont(k.n, 0.5) AS median_length, max(k.n) AS max_length, round(avg(k.n), 6) AS mean_length FROM k JOIN s USING (h) GROUP BY split""")
def d26(spark, d):
    return N.text_audit(news(spark, d)).withColumn("mean_length", F.round("mean_length", 6))


@q("d27_feed_coverage", """, k AS (SELECT *, count(*) OVER (PARTITION BY source) AS m, row_number() OVER (PARTITION BY source ORDER BY length(text), id) AS rn, count(*) OVER (PARTITION BY source, title) AS t FROM news)
SELECT source, count(*) AS n, count(DISTINCT lang) AS languages, count(*) FILTER (WHERE t > 1) AS repeated_titles, max(length(text)) FILTER (WHERE rn = round_even((m - 1) * 0.1, 0) + 1) AS p10,
  max(length(text)) FILTER (WHERE rn = round_even((m - 1) * 0.9, 0) + 1) AS p90 FROM k GROUP BY source""")
def d27(spark, d):
    return N.feed_coverage(news(spark, d))


@q("d28_record_audit", """, u AS (SELECT source, 'title' AS field, title AS v FROM news UNION ALL SELECT source, 'lang', lang FROM news UNION ALL SELECT source, 'text', text FROM news),
c AS (SELECT field, v, count(*) AS n, count(DISTINCT source) AS s, v IS NULL OR trim(v) = '' AS missing FROM u GROUP BY 1, 2)
SELECT field, CAST(coalesce(sum(n) FILTER (WHERE missing), 0) AS BIGINT) AS missing, count(*) FILTER (WHERE NOT missing AND n > 1) AS repeated_values,
  CAST(coalesce(sum(n - 1) FILTER (WHERE NOT missing AND n > 1), 0) AS BIGINT) AS extra_rows, count(*) FILTER (WHERE NOT missing AND s > 1) AS cross_source FROM c GROUP BY field""")
def d28(spark, d):
    return N.record_audit(news(spark, d), ["title", "lang", "text"])


@q("k2_score_once", f"""{LEXICON_SQL} SELECT id AS article_id, CAST(id % 3 AS VARCHAR) AS ticker, pos, neu, neg FROM news JOIN lex USING (id)
WHERE lang IN ('en', 'fr') AND id NOT IN (SELECT doc_id FROM labels)""")
def k2(spark, d):
    rows = news(spark, d)
    articles = rows.select(F.col("id").alias("article_id"), "lang", "summary")
    links = articles.select("article_id", (F.col("article_id") % 3).cast("string").alias("ticker"))
    done = links.join(A.table(spark, d, "labels").select(F.col("doc_id").alias("article_id")), "article_id", "left_semi")
    out = N.score_once(articles, links, done, ("en", "fr"), T.lexicon_sentiment(F.col("summary"), *LEXICON))
    return out.select("article_id", "ticker", r("pos"), r("neu"), r("neg"))


@q("k1_score_texts", f"{LEXICON_SQL} SELECT id, 'suffixes-1' AS model_version, pos, neu, neg FROM lex JOIN news USING (id) WHERE lang IN ('en', 'fr', 'de')")
def k1(spark, d):
    """The lexicon as a batch scorer behind the hook that any other model takes: whole texts, once per worker made."""
    scorer = N.LexiconScorer(*LEXICON, version="suffixes-1", prefixes=("en", "fr", "de"))
    out = N.score_texts(news(spark, d).select("id", "lang", "summary"), scorer, "summary")
    return out.select("id", "model_version", r("pos"), r("neu"), r("neg"))


@query("a2_read_table", "SELECT * FROM labels")
def a2(spark, d):
    rows, path = A.table(spark, d, "labels"), work_dir(spark, "a2")
    part = lambda n: rows.where(F.pmod("doc_id", F.lit(3)) == n)
    part(0).write.json(f"{path}/jsonl")
    part(1).write.option("header", True).csv(f"{path}/csv")
    part(2).write.parquet(f"{path}/parquet")
    read = [parsers.read_table(spark, f"{path}/{f}", rows.schema, f) for f in ("jsonl", "csv", "parquet")]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("a3_parse_chart", f"""WITH {BARS} SELECT ticker, session, open, high, low, close, volume, adj,
  CASE WHEN volume % 11 = 0 THEN 'incomplete' END AS reject FROM (SELECT * REPLACE (CASE WHEN volume % 11 = 0 THEN NULL ELSE open END AS open,
  CASE WHEN volume % 4 = 0 THEN close ELSE adj END AS adj) FROM bars)""")
def a3(spark, d):
    """Bars laid out as one chart payload per ticker and read back."""
    bars = A.bars(spark, d)
    stamp = (F.unix_timestamp(F.col("session").cast("timestamp")) + 3600).alias("timestamp")
    row = F.struct(stamp, F.when(F.col("volume") % 11 != 0, F.col("open")).alias("open"), "high", "low", "close", "volume",
                   F.when(F.col("volume") % 4 != 0, F.col("adj")).alias("adjclose"))
    packed = bars.groupBy("ticker").agg(F.array_sort(F.collect_list(row)).alias("b"))
    fields = ("timestamp", "open", "high", "low", "close", "volume", "adjclose")
    columns = [F.col(f"b.{f}").alias(f) for f in fields]
    payload = F.to_json(F.struct("ticker", F.lit("Asia/Taipei").alias("zone"), *columns), {"ignoreNullFields": "false"})
    return parsers.parse_chart(packed.select(payload.alias("payload")))


@query("a4_parse_positional", "SELECT CAST(o_orderkey AS VARCHAR) AS code, round(o_totalprice, 2) AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS volume, CASE WHEN o_orderkey % 10 = 0 THEN 'number' END AS reject FROM orders")
def a4(spark, d):
    rows = A.table(spark, d, "orders")
    cells = F.array(F.col("o_orderkey").cast("string"), F.format_number("o_totalprice", 2), F.when(F.col("o_orderkey") % 10 == 0, "--").otherwise(F.col("o_custkey").cast("string")))
    head = F.array(F.lit("code"), F.lit("price"), F.lit("volume"), F.lit("note"))
    packed = rows.groupBy("o_custkey").agg(F.collect_list(cells).alias("data")).select(F.to_json(F.struct(head.alias("fields"), "data")).alias("payload"))
    return parsers.parse_positional(packed, ["code", "price", "volume"])


@q("a5_announcements_json", "SELECT id % 100 || '' AS ticker, sha256((id % 100) || '|' || strftime(published_at, '%Y-%m-%d %H:%M:%S') || '|' || id || ' ' || source) AS external_id, strftime(published_at - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS at FROM news")
def a5(spark, d):
    item = F.create_map(*(x for k, v in {
        " ticker": (F.col("id") % 100).cast("string"), "date ": F.date_format("published_at", "yyyy-MM-dd"), "time": F.date_format("published_at", "HH:mm:ss"),
        "title": F.concat_ws(" ", F.col("id").cast("string"), "source"), "body": F.col("summary")}.items() for x in (F.lit(k), v)))
    packed = batches(news(spark, d), "id").groupBy("source", "batch").agg(F.to_json(F.collect_list(item)).alias("payload"))
    return parsers.parse_announcements_json(packed).select("ticker", "external_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@q("a7_parse_rss", "SELECT 'n' || id AS title, 'http://x.example/' || id AS link, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS at FROM news")
def a7(spark, d):
    path = work_dir(spark, "a7")
    iso, mail = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.date_format("published_at", "E, d MMM yyyy HH:mm:ss Z")
    item = F.concat(F.lit("<item><title>n"), F.col("id").cast("string"), F.lit("</title><link>http://x.example/"), F.col("id").cast("string"), F.lit("</link><pubDate>"),
                    F.when(F.col("id") % 2 == 0, iso).otherwise(mail), F.lit("</pubDate></item>"))
    feed = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>"))
    batches(news(spark, d), "id").groupBy("source", "batch").agg(feed.alias("value")).write.partitionBy("source", "batch").text(path)
    return parsers.parse_rss(spark, path).select("title", "link", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("a9_parse_events", """SELECT event_type AS ticker, CASE WHEN event_id % 13 = 0 THEN 'time' WHEN event_id % 7 = 0 THEN 'confidence' END AS reject, count(*) AS n FROM events GROUP BY 1, 2""")
def a9(spark, d):
    rows = A.table(spark, d, "events")
    clock = F.when(F.col("event_id") % 13 == 0, "25:00:00").otherwise(F.date_format("ts", "HH:mm:ss"))
    e = F.struct(F.col("event_type").alias("ticker"), F.date_format("ts", "yyyy-MM-dd").alias("date"), clock.alias("time"), F.lit("c").alias("class"),
                 F.when(F.col("event_id") % 7 == 0, 1.5).otherwise(0.5).alias("confidence"))
    packed = rows.groupBy(F.col("event_type").alias("ticker"), F.pmod("user_id", F.lit(50)).alias("b")).agg(F.collect_list(e).alias("events"))
    out = parsers.parse_events(packed.select(F.to_json(F.struct("ticker", "events")).alias("payload")), 10_000_000)
    return out.groupBy("ticker", "reject").agg(F.count("*").alias("n"))


@query("a12_append_versions", "SELECT count(*) AS stored FROM documents")
def a12(spark, d):
    path, rows = work_dir(spark, "a12"), A.table(spark, d, "documents").select("doc_id", "text")
    sinks.append_versions(rows.where("doc_id % 2 = 0"), path, "doc_id", "text")
    sinks.append_versions(rows, path, "doc_id", "text")
    return spark.read.schema(rows.schema).parquet(path).agg(F.count("*").alias("stored"))


@query("a13_write_archive", "SELECT source, lang AS run, count(*) AS n FROM documents GROUP BY 1, 2")
def a13(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", "source", F.lit("2024-01-01").cast("date").alias("date"), F.col("lang").alias("run"))
    return sinks.write_archive(rows, work_dir(spark, "a13")).groupBy("source", "run").agg(F.count("*").alias("n"))


@q("a14_export_splits", "SELECT split, count(*) AS n, min(CAST(published_at AS DATE)) AS first, max(CAST(published_at AS DATE)) AS last FROM news GROUP BY split")
def a14(spark, d):
    rows = news(spark, d).select("id", "split", F.to_date("published_at").alias("day"))
    return sinks.export_splits(rows, work_dir(spark, "a14")).drop("digest")


@query("a15_replace_partition", "SELECT lang, count(*) AS n, CAST(sum(CASE WHEN lang = 'de' THEN 2 ELSE 1 END) AS BIGINT) AS total FROM documents GROUP BY lang")
def a15(spark, d):
    path, rows = work_dir(spark, "a15"), A.table(spark, d, "documents").select("doc_id", "lang", F.lit(1).alias("v"))
    sinks.replace_partition(rows, path, "lang")
    out = sinks.replace_partition(rows.where("lang = 'de'").withColumn("v", F.lit(2)), path, "lang")
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
