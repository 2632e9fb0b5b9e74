"""Parsers of landed payloads: text in, typed rows and rejects with a reason out, all by column expressions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHART = (
    "ticker string, zone string, timestamp array<bigint>, open array<double>, high array<double>, low array<double>, "
    "close array<double>, volume array<bigint>, adjclose array<double>"
)


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str) -> DataFrame:
    """JSON lines, a JSON list, CSV or Parquet, with the schema given and no inference."""
    if fmt == "jsonl":
        return spark.read.schema(schema).json(path)
    if fmt == "json":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def parse_chart(raw: DataFrame) -> DataFrame:
    """One row per bar of charts of parallel arrays; ``reject`` says why a bar is no bar."""
    chart = raw.select(F.from_json("payload", CHART).alias("c")).select("c.*")
    bars = F.arrays_zip("timestamp", "open", "high", "low", "close", "volume", "adjclose")
    rows = chart.select("ticker", "zone", F.explode(bars).alias("b")).select("ticker", "zone", "b.*")
    local = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("timestamp"), F.col("zone")))
    rows = rows.withColumns({"session": local, "adj": F.coalesce("adjclose", "close")})
    reject = F.when(F.greatest(*(F.col(c).isNull() for c in ("open", "high", "low", "close", "volume"))), "incomplete")
    reject = reject.when(F.least("open", "high", "low", "close") <= 0, "non_positive")
    reject = reject.when((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), "range")
    return rows.select("ticker", "session", "open", "high", "low", "close", "volume", "adj", reject.alias("reject"))


def number(text: Column) -> Column:
    """Thousands separators go; "--" and anything else that is no number is null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def parse_positional(raw: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of a positional table whose header starts with ``fields``; other payloads and bad numbers are rejected."""
    kind = "fields array<string>, data array<array<string>>"
    doc = raw.select(F.from_json("payload", kind).alias("d")).select("d.*")
    known = F.slice("fields", 1, len(fields)) == F.array(*map(F.lit, fields))
    rows = doc.select(known.alias("known"), F.explode("data").alias("r"))
    cells = [F.trim(F.get("r", F.lit(0))).alias(fields[0]), *(number(F.get("r", F.lit(i))).alias(f) for i, f in enumerate(fields) if i)]
    out = rows.select("known", *cells)
    bad = F.when(~F.coalesce("known", F.lit(False)), "header").when(F.greatest(*(F.col(f).isNull() for f in fields)), "number")
    return out.withColumn("reject", bad).drop("known")


def announcement(ticker: Column, date: Column, clock: Column, title: Column, body: Column) -> list[Column]:
    """A news row: local date and time to an instant, a stable id, a bounded excerpt."""
    at = F.concat_ws(" ", date, clock).try_cast("timestamp")
    return [
        ticker.alias("ticker"), F.to_utc_timestamp(at, "Asia/Taipei").alias("published_at"), title.alias("title"),
        F.sha2(F.concat_ws("|", ticker, F.concat_ws(" ", date, clock), title), 256).alias("external_id"), F.substring(F.trim(body), 1, 500).alias("excerpt"),
    ]


def parse_announcements_json(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.explode(F.from_json("payload", "array<map<string,string>>")).alias("m"))
    m = F.transform_keys("m", lambda k, _: F.trim(k))
    rows = rows.select(m.alias("m"))
    return rows.select(*announcement(*(F.col("m")[k] for k in ("ticker", "date", "time", "title", "body"))))


def parse_announcements_csv(spark: SparkSession, path: str) -> DataFrame:
    kind = "ticker string, date string, time string, title string, body string"
    rows = spark.read.schema(kind).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return rows.select(*announcement(*(F.col(k) for k in ("ticker", "date", "time", "title", "body"))))


def parse_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items with title, link and a date, ISO 8601 or RFC 822."""
    rows = spark.read.schema("title string, link string, pubDate string, description string").option("rowTag", "item").format("xml").load(path)
    mail = F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", "")
    at = F.coalesce(F.col("pubDate").try_cast("timestamp"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    return rows.where("title IS NOT NULL AND link IS NOT NULL").select("title", "link", at.alias("published_at"), "description").where("published_at IS NOT NULL")


def read_law_xml(spark: SparkSession, path: str) -> DataFrame:
    """Records with the reason why one is no corpus candidate."""
    from panelspark.functions.text import parse_roc_date

    rows = spark.read.schema("id string, title string, date string, content string").option("rowTag", "Law").format("xml").load(path)
    day = parse_roc_date(F.col("date"))
    reason = F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty_content").when(day.isNull(), "invalid_publication_date")
    return rows.select("id", "title", day.alias("published_on"), "content", reason.alias("exclusion"))


def parse_events(raw: DataFrame, limit: int) -> DataFrame:
    """Typed events; a payload that reaches the request's limit is rejected whole, others by their clock and confidence."""
    kind = "ticker string, events array<struct<ticker:string,date:string,time:string,class:string,confidence:double>>"
    doc = raw.select(F.from_json("payload", kind).alias("d")).select("d.*").withColumn("full", F.size("events") >= limit)
    rows = doc.select(F.col("ticker").alias("asked"), "full", F.explode("events").alias("e")).select("asked", "full", "e.*")
    reject = F.when(F.col("full"), "limit_reached").when(F.col("ticker") != F.col("asked"), "ticker")
    reject = reject.when(~F.col("time").rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"), "time")
    reject = reject.when(~F.col("confidence").between(0, 1), "confidence")
    key = F.sha2(F.concat_ws("|", "ticker", "date", "time", "class"), 256)
    return rows.select(key.alias("event_id"), "ticker", "date", "time", "class", "confidence", reject.alias("reject"))
