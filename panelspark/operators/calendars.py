"""Joins on the exchange calendar: grids, gaps, folds and as-of assignment."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def candidate_grid(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Each ticker on each session, with its bar where there is one. The calendar is the broadcast side."""
    keys = bars.select("ticker").distinct().crossJoin(F.broadcast(cal.select("session", "idx", "next_session")))
    return keys.join(bars.drop("idx", "next_session"), ["ticker", "session"], "left")


def session_gaps(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Per ticker: sessions expected, present and missing."""
    grid = candidate_grid(bars, cal)
    missing = F.sum(F.col("close").isNull().cast("int"))
    return grid.groupBy("ticker").agg(
        F.count("*").alias("expected"), missing.alias("missing"), F.round(missing / F.count("*"), 8).alias("missing_ratio")
    )


def extra_sessions(bars: DataFrame, cal: DataFrame) -> DataFrame:
    return bars.join(F.broadcast(cal.select("session")), "session", "left_anti").select("ticker", "session")


def systematic_gaps(bars: DataFrame, cal: DataFrame, least: int = 2) -> DataFrame:
    """Sessions that several tickers miss; the list is of tickers that miss one session."""
    missing = candidate_grid(bars, cal).where("close IS NULL")
    return missing.groupBy("session").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("tickers")
    ).where(F.col("n") >= least)


def recent_coverage(bars: DataFrame, cal: DataFrame, n: int) -> DataFrame:
    """Per ticker: bars in the last ``n`` sessions, its last session, and how many sessions it is behind."""
    last = cal.agg(F.max("idx").alias("end"))
    rows = bars.join(F.broadcast(cal.select("session", "idx")), "session").crossJoin(F.broadcast(last))
    return rows.groupBy("ticker").agg(
        F.sum((F.col("idx") > F.col("end") - n).cast("int")).alias("recent"), F.max("session").alias("last_session"),
        (F.max("end") - F.max("idx")).alias("behind"),
    )


def assign_folds(df: DataFrame, folds: DataFrame, day: str = "session", target: str = "next_session") -> DataFrame:
    """Roles of each row in each fold: evaluation inside the fold's range, training before it if the target ends before
    the evaluation begins. ``folds`` is a table of tens of ranges: the broadcast side of a range join."""
    first, last = F.col("evaluation_start"), F.col("evaluation_end")
    trains = (F.col(day) <= F.col("train_end")) & (F.col(day) >= F.col("train_start")) & (F.col(target) < first)
    role = F.when(F.col(day).between(first, last), F.lit("evaluation")).when(trains, F.lit("train"))
    joined = df.join(F.broadcast(folds), (F.col(day) <= last) & (F.col(day) >= F.col("train_start")))
    return joined.withColumn("role", role).where("role IS NOT NULL").drop("train_start", "train_end", "evaluation_start", "evaluation_end")


def yearly_folds(spark, years: range, start: str) -> DataFrame:
    rows = [(str(y), start, f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31") for y in years]
    names = ["fold", "train_start", "train_end", "evaluation_start", "evaluation_end"]
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))
    days = [F.col(n) if n == "fold" else F.col(n).cast("date").alias(n) for n in names]
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*").select(*days)


def day_map(sessions: DataFrame) -> DataFrame:
    """``day, same, next``: for each calendar day, the first session on it or after it, and the first after it. A dense
    spine of days turns as-of joins into equi-joins."""
    order = Window.orderBy("day").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ends = sessions.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    days = ends.select(F.explode(F.sequence(F.date_sub("a", 40), "b")).alias("day"))
    placed = days.join(sessions.select(F.col("session").alias("day"), F.col("session")), "day", "left")
    placed = placed.withColumn("same", F.min("session").over(order))
    return placed.select("day", F.col("same").alias("same"), F.lead("same").over(Window.orderBy("day")).alias("next"))


def assign_sessions(events: DataFrame, sessions: DataFrame, zone: str, hour: int, minute: int, at: str = "published_at") -> DataFrame:
    """``effective``: the session an event belongs to, the same day up to the cutoff and the next session after it or on
    other days. Events after the last session get null."""
    local = F.from_utc_timestamp(F.col(at), zone)
    minutes = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    late = (minutes > hour * 3600 + minute * 60) | (
        (minutes == hour * 3600 + minute * 60) & (F.date_format(local, "SSSSSS") > "000000")
    )
    rows = events.withColumns({"local_day": F.to_date(local), "_late": late})
    spine = F.broadcast(day_map(sessions).withColumnRenamed("day", "local_day"))
    effective = F.when(F.col("_late") & (F.col("same") == F.col("local_day")), F.col("next")).otherwise(F.col("same"))
    return rows.join(spine, "local_day", "left").withColumn("effective", effective).drop("_late", "same", "next")


def reaction_window(events: DataFrame, sessions: DataFrame, zone: str, open_minute: int, close_minute: int) -> DataFrame:
    """``before, after``: the sessions around an event; during trading hours it abstains, after the close the window is
    (that session, next), else (previous, next)."""
    order = Window.orderBy("session")
    known = sessions.select("session", F.lag("session").over(order).alias("previous"), F.lead("session").over(order).alias("following"))
    local = F.from_utc_timestamp("published_at", zone)
    minute = F.hour(local) * 60 + F.minute(local)
    rows = events.withColumns({"local_day": F.to_date(local), "_minute": minute})
    spine = F.broadcast(day_map(sessions).select(F.col("day").alias("local_day"), F.col("same").alias("session")))
    rows = rows.join(spine, "local_day", "left").join(F.broadcast(known), "session", "left")
    trading = F.col("session") == F.col("local_day")
    during = trading & (F.col("_minute") >= open_minute) & (F.col("_minute") < close_minute)
    closed = trading & (F.col("_minute") >= close_minute)
    return rows.select(
        *events.columns, F.coalesce(during, F.lit(False)).alias("abstained"),
        F.when(during, None).when(closed, F.col("session")).otherwise(F.col("previous")).alias("before"),
        F.when(during, None).when(closed, F.col("following")).otherwise(F.col("session")).alias("after"),
    )


def regime(value: Column, low: Column, high: Column) -> Column:
    known = F.when(value <= low, F.lit("LOW")).when(value <= high, F.lit("MIDDLE")).otherwise(F.lit("HIGH"))
    return F.when(value.isNull() | low.isNull(), F.lit("UNKNOWN")).otherwise(known)
