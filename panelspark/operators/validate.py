"""Filters, validation and exclusion accounting over bars."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_bars(bars: DataFrame, tickers: list[str], start: str, end: str, source: str) -> DataFrame:
    day = F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return bars.where(F.col("ticker").isin(*tickers) & day & (F.col("source") == source))


def load_benchmark(bench: DataFrame, start: str, end: str) -> DataFrame:
    """Positive prices in the range, on dates that occur once."""
    day = F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    good = bench.where(day & (F.col("price") > 0))
    return good.groupBy("session").agg(F.count("*").alias("n"), F.min("price").alias("price")).where("n = 1").drop("n")


def bar_issues(bars: DataFrame) -> DataFrame:
    """A row for each rule that a bar breaks."""
    rules = {
        "non_positive_price": F.least("open", "high", "low", "close") <= 0,
        "high_below_body": F.col("high") < F.greatest("open", "close"),
        "low_above_body": F.col("low") > F.least("open", "close"),
        "high_below_low": F.col("high") < F.col("low"),
        "negative_volume": F.col("volume") < 0,
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return bars.select("ticker", "session", F.explode(broken).alias("issue"))


def quality_report(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per ticker: rows, first and last session, duplicates, missing sessions in between, and whether it passes."""
    per = bars.groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.count_distinct("session").alias("n_sessions"),
        F.min("session").alias("first_session"), F.max("session").alias("last_session"),
        F.sum((F.col("high") < F.col("low")).cast("int")).alias("n_invalid"),
    )
    spans = per.join(F.broadcast(sessions.select("session")), F.col("session").between(F.col("first_session"), F.col("last_session")))
    expected = spans.groupBy("ticker").agg(F.count("*").alias("expected"))
    duplicates = F.col("n_rows") - F.col("n_sessions")
    return per.join(expected, "ticker").select(
        "ticker", "n_rows", "first_session", "last_session", duplicates.alias("n_duplicates"),
        (F.col("expected") - F.col("n_sessions")).alias("n_gaps"), "n_invalid",
        ((duplicates == 0) & (F.col("n_invalid") == 0)).alias("passed"),
    )


def split_for(day: Column, ranges: list[tuple[str, str, str]]) -> Column:
    """The name of the first range that holds the day, null outside all."""
    parts = [F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in ranges]
    return F.coalesce(*parts)


def information_cutoff(day: Column, zone: str, hour: int, minute: int) -> Column:
    """The instant in UTC at which a session's information ends, given in local time."""
    local = day.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
    return F.to_utc_timestamp(local, zone)


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def complete_case(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (finite(F.col(c)) for c in columns)))


def with_exclusion(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``exclusion``: the name of the first rule that holds, null for rows that stay."""
    return df.withColumn("exclusion", F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules)))


def exclusion_report(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("exclusion", F.lit("eligible")).alias("reason")).agg(
        F.count("*").alias("n"), F.count_distinct("ticker").alias("n_tickers"), F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error if rows share ``keys``."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"rows share {', '.join(keys)}")
    return df
