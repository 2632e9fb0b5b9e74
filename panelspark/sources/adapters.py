"""The driver's tables as the domain frames of the library: bars, calendar, events, news."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A row per trade, shuffled by ``by``, if it is given, as narrow as it is read."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("session"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
    )
    rows = rows.repartition(*by) if by else rows
    return rows.select(
        "ticker", "session", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("k"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, session, open, high, low, close, volume, adj, source``: one row per ticker and month. First and last trades
    are told by structs, which Spark aggregates by sorting; trades are shuffled before, because a scan's task holds about
    as many bars as trades and sorts them all, in memory that does not follow the number of partitions."""
    made = trades(spark, sf_dir, ("ticker", "session")).groupBy("ticker", "session").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "k").alias("close"), F.sum("quantity").cast("long").alias("volume"),
    )
    half = F.when(F.col("session") < F.lit("1998-01-01").cast("date"), 0.5).otherwise(1.0)
    return made.withColumn("adj", F.col("close") * half).withColumn("source", F.lit("lineitem"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("session").agg(F.avg("price").alias("price"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event study prices: ``ticker, session, price`` per event type and weekday."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("date").alias("session"), "value"
    )
    return events.where(F.weekday("session") < 5).groupBy("ticker", "session").agg(F.avg("value").alias("price"))


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ticker, published_at, confidence, event_class, user_id, value``; times are UTC."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("published_at"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(7)).cast("string")).alias("event_class"), "user_id", "value",
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, title, summary, text, lang, source, published_at, split``; the title is the text's first line and the
    summary all that follows it."""
    minutes = F.make_dt_interval(mins=(F.col("doc_id") * 7).cast("int"))
    part = F.pmod("doc_id", F.lit(10))
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", title.alias("title"), F.substr(F.col("text"), F.length(title) + 2).alias("summary"), "text", "lang",
        "source", (F.lit("2024-01-01").cast("timestamp") + minutes).alias("published_at"),
        F.when(part < 8, "train").when(part == 8, "validation").otherwise("test").alias("split"),
    )


def calendar(bench: DataFrame) -> DataFrame:
    """``session, price, idx, next_session``: the benchmark's dates are the sessions. The only window without a
    partition; an exchange calendar has a few thousand rows whatever the number of tickers."""
    order = Window.orderBy("session")
    return bench.select(
        "session", "price", (F.row_number().over(order) - 1).alias("idx"), F.lead("session").over(order).alias("next_session")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the calendar's ``idx`` and ``next_session``."""
    cal = calendar(benchmark(spark, sf_dir)).select("session", "idx", "next_session")
    return bars(spark, sf_dir).join(F.broadcast(cal), "session")
