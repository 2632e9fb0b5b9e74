"""Products composed of the other operators: audits, corpora, intelligence records and reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions import text as T
from panelspark.operators import newsroom as N
from panelspark.operators.validate import finite
from panelspark.streaming.jobs import work_dir


def concentration(axis: DataFrame, least_n: int, absolute: float, ratio: float) -> DataFrame:
    """Flags axis values with many rows whose rate is above the whole's by a difference and by a ratio."""
    whole = axis.where("axis = 'all'").select(F.col("excluded_rate").alias("base"))
    rows = axis.where("axis <> 'all'").crossJoin(F.broadcast(whole))
    gap = F.col("excluded_rate") - F.col("base")
    hit = (F.col("n") >= least_n) & (gap > absolute) & (F.coalesce(F.try_divide("excluded_rate", "base"), F.lit(0.0)) > ratio)
    return rows.withColumn("flagged", hit)


def audit_rows(rows: DataFrame, cal: DataFrame, features: list[str]) -> DataFrame:
    """Violations per rule: targets that are not the exact next session, features or targets that are not finite, and
    targets that the bars do not give again."""
    known = F.broadcast(cal.select("session", F.col("next_session").alias("_next")))
    joined = rows.drop("_next").join(known, "session", "left")
    again = F.col("next_abs") / F.col("volatility_log_return_20")
    bad = ~finite(F.col(features[0]))
    for c in features[1:]:
        bad = bad | ~finite(F.col(c))
    return joined.agg(
        F.count("*").alias("n"), F.count_if(~F.col("next_session").eqNullSafe(F.col("_next"))).alias("wrong_target_session"),
        F.count_if(bad).alias("not_finite"), F.count_if(F.abs(again - F.col("primary")) > 1e-9).alias("wrong_target"),
    )


def enrich(oof: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions rejoined to their rows, with what does not agree marked."""
    joined = oof.join(data.withColumnRenamed("y", "_y"), keys, "left")
    status = F.when(F.col("_y").isNull(), "unknown_row").when(F.abs(F.col("y") - F.col("_y")) > 1e-12, "target_differs").otherwise("ok")
    return joined.withColumn("status", status)


def feature_parity(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Per feature: rows in both, the largest difference, and PASS, FAIL or NOT_EVALUABLE."""
    rows = N.compare_panels(a, b, keys, fields)
    status = F.when(F.col("max_diff").isNull(), "NOT_EVALUABLE").when(F.col("max_diff") <= tolerance, "PASS").otherwise("FAIL")
    return rows.select("field", "n_both", "max_diff", status.alias("status"))


def persistence_prob(df: DataFrame, label: str) -> DataFrame:
    """The previous row's label if its target is this session, else the mean label of all rows."""
    order = Window.partitionBy("ticker").orderBy("session")
    before = F.lag(F.struct("next_session", label)).over(order)
    prevalence = df.agg(F.avg(label).alias("_prevalence"))
    rows = df.withColumn("_b", before).crossJoin(F.broadcast(prevalence))
    follows = F.col("_b.next_session") == F.col("session")
    return rows.withColumn("persisted", F.when(follows, F.col(f"_b.{label}").cast("double")).otherwise(F.col("_prevalence"))).drop("_b", "_prevalence")


def build_corpus(records: DataFrame, train_end: str, validation_end: str) -> DataFrame:
    """Records with content and a date, the first of each content, split by family without straddling."""
    clean = records.withColumn("norm", T.norm_text(F.coalesce("content", F.lit(""))))
    kept = clean.where((F.col("norm") != "") & F.col("day").isNotNull()).withColumn("h", F.sha2("norm", 256))
    return N.family_split(N.dedup_first(kept, ["h"], ["day", "id"]), "family", "day", train_end, validation_end)


def stored_once(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read back, so that those who read it do not work it out again."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ingest_news(news: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items once per content hash, without those whose title resembles an earlier item's of the days before, with their
    canonical URL, best entity and its score; ``n_exact`` and ``n_fuzzy`` count what each step dropped from the run. Items
    and the ids of those that resemble others are each worked out once and stored."""
    rows = news.withColumn("url", T.canonical_url(F.col("url")))
    rows = rows.withColumn("h", T.stable_id(F.lower("title"), F.col("url"))).select("id", "url", "h", "title", "summary", "published_at")
    path = work_dir(news.sparkSession, "ingest_news")
    exact = stored_once(N.dedup_first(rows, ["h"], ["published_at", "id"]), f"{path}/exact")
    fuzzy = stored_once(N.fuzzy_dups(exact).select("id").distinct(), f"{path}/fuzzy")
    first = exact.join(fuzzy, "id", "left_anti")
    counts = [f.agg(F.count("*").alias(n)) for f, n in ((rows, "n_all"), (exact, "n_unique"), (first, "n_kept"))]
    told = counts[0].crossJoin(counts[1]).crossJoin(counts[2]).select(
        (F.col("n_all") - F.col("n_unique")).alias("n_exact"), (F.col("n_unique") - F.col("n_kept")).alias("n_fuzzy"))
    best = N.match_entities(first, aliases).groupBy("id").agg(F.max(F.struct("score", "ticker")).alias("b"))
    return first.join(best, "id", "left").crossJoin(F.broadcast(told)).select("id", "url", "h", F.col("b.ticker").alias("ticker"), F.col("b.score").alias("score"), "n_exact", "n_fuzzy")


def assemble_items(news: DataFrame, prefixes: tuple[str, ...], vote: Column, cues: Column) -> DataFrame:
    """Records routed by language and rule signal, with event, cues, excerpt and lineage as structs."""
    known = T.supports_language(F.col("lang"), prefixes)
    rows = news.withColumns({"vote": vote, "cues": cues})
    signal = F.col("vote.confidence") > 0
    status = F.when(known & signal, "SCORED").when(known, "ELIGIBLE_NOT_SCORED").otherwise("ABSTAIN")
    lineage = F.struct("source", T.stable_id(F.col("source"), F.col("title")).alias("input_hash"))
    return rows.select("id", status.alias("status"), F.when(known, F.struct("vote.event_type", "vote.impact")).alias("event"), "cues",
                       F.substring("summary", 1, 120).alias("excerpt"), lineage.alias("lineage"))


def to_documents(news: DataFrame, rights: dict[str, str]) -> DataFrame:
    """Canonical documents: an id of identity, a version id of content, and the text that the source's rights permit."""
    tiers = F.create_map(*(F.lit(x) for kv in rights.items() for x in kv))
    tier = F.coalesce(F.try_element_at(tiers, F.col("source")), F.lit("EXCERPT"))
    document = T.stable_id(F.col("source"), F.col("id"))
    permitted = F.when(tier == "FULL", F.col("text")).when(tier == "EXCERPT", F.substring("text", 1, 200))
    return news.select("id", document.alias("document_id"), T.stable_id(document, F.sha2("text", 256)).alias("version_id"), tier.alias("tier"), permitted.alias("permitted_text"))
