"""Event studies and daily aggregates over publications."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.calendars import assign_sessions


def reaction_labels(
    events: DataFrame, prices: DataFrame, horizons: dict[str, int], band: float, anomaly: float, zone: str, hour: int, minute: int
) -> DataFrame:
    """A row per event and horizon. The anchor is the session before the effective one, the end ``h - 1`` sessions after;
    the first reason that holds makes a row abstain. Lookups are equi-joins on the session index."""
    bench = prices.groupBy("session").agg(F.avg("price").alias("bench"))
    order = Window.orderBy("session")
    sessions = bench.select("session", "bench", (F.row_number().over(order) - 1).alias("idx"))
    rows = assign_sessions(events, sessions.select("session"), zone, hour, minute)
    table = F.broadcast(sessions)
    rows = rows.join(table.select(F.col("session").alias("effective"), F.col("idx").alias("at")), "effective", "left")
    made = F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(h).alias("h")) for n, h in horizons.items()))
    rows = rows.withColumn("x", F.explode(made)).select("*", "x.horizon", "x.h").drop("x")
    rows = rows.withColumns({"start_idx": F.col("at") - 1, "end_idx": F.col("at") + F.col("h") - 1})
    for side in ("start", "end"):
        rows = rows.join(table.select(
            F.col("idx").alias(f"{side}_idx"), F.col("session").alias(f"{side}_session"), F.col("bench").alias(f"{side}_bench")
        ), f"{side}_idx", "left")
        own = prices.select("ticker", F.col("session").alias(f"{side}_session"), F.col("price").alias(f"{side}_price"))
        rows = rows.join(own, ["ticker", f"{side}_session"], "left")
    raw = F.col("end_price") / F.nullif("start_price", F.lit(0.0)) - 1
    market = F.col("end_bench") / F.nullif("start_bench", F.lit(0.0)) - 1
    reason = F.coalesce(
        F.when(F.col("published_at").isNull(), "ABSTAIN_TIMESTAMP"), F.when(F.col("at").isNull(), "ABSTAIN_NO_SESSION"),
        F.when(F.col("start_session").isNull(), "ABSTAIN_NO_ANCHOR"), F.when(F.col("end_session").isNull(), "ABSTAIN_INCOMPLETE_HORIZON"),
        F.when(F.col("start_price").isNull() | F.col("end_price").isNull(), "ABSTAIN_MISSING_STOCK_PRICE"),
        F.when(F.abs(raw) > anomaly, "ABSTAIN_PRICE_ANOMALY"),
    )
    abnormal = raw - market
    kind = F.when(abnormal > band, "POSITIVE_REACTION").when(abnormal < -band, "NEGATIVE_REACTION").otherwise("NEUTRAL_REACTION")
    return rows.withColumns({
        "reason": reason, "raw": F.when(reason.isNull(), raw), "market": F.when(reason.isNull(), market),
        "abnormal": F.when(reason.isNull(), abnormal), "label": F.when(reason.isNull(), kind),
    })


def sentiment(value: Column) -> list[Column]:
    """Deterministic class probabilities of a value, for tables that carry none."""
    up, down = F.exp(value / 50 - 1), F.exp(-value / 50)
    total = up + down + 1
    return [(up / total).alias("pos"), (F.lit(1.0) / total).alias("neu"), (down / total).alias("neg")]


def daily_sentiment(scored: DataFrame, zone: str) -> DataFrame:
    """Per ticker and local day: count, mean probabilities and score, weighted score and label ratios."""
    score = F.col("pos") - F.col("neg")
    best = F.greatest("pos", "neu", "neg")
    return scored.groupBy("ticker", F.to_date(F.from_utc_timestamp("published_at", zone)).alias("day")).agg(
        F.count("*").alias("n"), F.avg("pos").alias("mean_pos"), F.avg("neu").alias("mean_neu"), F.avg("neg").alias("mean_neg"),
        F.avg(score).alias("mean_score"), F.try_divide(F.sum(score * F.col("weight")), F.sum("weight")).alias("weighted"),
        F.avg((F.col("pos") == best).cast("int")).alias("ratio_pos"), F.avg((F.col("neg") == best).cast("int")).alias("ratio_neg"),
    )


def session_sentiment(assigned: DataFrame, prices: DataFrame, windows: list[int]) -> DataFrame:
    """Per ticker and session, over its last sessions: counts (0 where none), means and deviations (null where none). Events
    are summed per session first, so frames run over sessions and not over events."""
    score = F.col("pos") - F.col("neg")
    sums = assigned.where("effective IS NOT NULL").groupBy("ticker", F.col("effective").alias("session")).agg(
        F.count("*").alias("c"), F.sum(score).alias("s"), F.sum(score * score).alias("ss"), F.sum(score * F.col("weight")).alias("sw"),
        F.sum("weight").alias("w"), F.max("published_at").alias("latest"),
    )
    rows = prices.select("ticker", "session").join(sums, ["ticker", "session"], "left").fillna(0, ["c", "s", "ss", "sw", "w"])
    out = rows
    for n in windows:
        frame = Window.partitionBy("ticker").orderBy("session").rowsBetween(1 - n, 0)
        c, s, ss = (F.sum(x).over(frame) for x in ("c", "s", "ss"))
        mean = F.try_divide(s, c)
        out = out.withColumns({
            f"n_{n}": c, f"mean_{n}": mean, f"std_{n}": F.sqrt(F.greatest(F.try_divide(ss, c) - mean * mean, F.lit(0.0))),
            f"weighted_{n}": F.try_divide(F.sum("sw").over(frame), F.sum("w").over(frame)),
        })
    return out.drop("c", "s", "ss", "sw", "w")


def window_rows(windows: DataFrame) -> DataFrame:
    """Events of one class and window count once (the first); then per window: events, mean confidence, dominant class
    (most frequent, then by name) and first event."""
    keep = Window.partitionBy("ticker", "before", "after", "event_class").orderBy("published_at", "event_id")
    per_class = windows.withColumn("_n", F.count("*").over(Window.partitionBy("ticker", "before", "after", "event_class")))
    first = per_class.withColumn("_r", F.row_number().over(keep)).where("_r = 1")
    rank = F.struct((-F.col("_n")).alias("n"), "event_class")
    return first.groupBy("ticker", "before", "after").agg(
        F.sum("_n").alias("n_events"), F.avg("confidence").alias("mean_confidence"), F.min(rank).alias("top"), F.min("event_id").alias("first_event"),
    ).withColumn("dominant", F.col("top.event_class")).drop("top")


def sufficiency(rows: DataFrame, gate: dict[str, float]) -> DataFrame:
    """A row per check: what there is, what is asked, and whether it passes. Counts are exact."""
    found = rows.agg(
        F.count_distinct("ticker", "before", "after").cast("double").alias("windows"), F.count_distinct("ticker").cast("double").alias("tickers"),
        F.count_distinct("event_class").cast("double").alias("classes"), F.avg("confidence").alias("mean_confidence"),
    )
    checks = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("found"), F.lit(float(v)).alias("least")) for n, v in gate.items()))
    return found.select(F.explode(checks).alias("c")).select("c.*").withColumn("passed", F.col("found") >= F.col("least"))


def gate_signal(signals: DataFrame, cutoff: Column, low: float, high: float) -> DataFrame:
    """A stored score is shown only if it was published before it was available and that before the cutoff."""
    status = F.when(F.col("score").isNull(), "ABSTAIN_NO_SCORE").when(F.col("available_at") < F.col("published_at"), "ABSTAIN_ORDER")
    status = status.when(F.col("available_at") > cutoff, "ABSTAIN_NOT_AVAILABLE").otherwise("EXPOSED")
    band = F.when(F.col("score") >= high, "HIGH").when(F.col("score") >= low, "MIDDLE").otherwise("LOW")
    shown = status == "EXPOSED"
    return signals.withColumns({"status": status, "shown": F.when(shown, F.col("score")), "band": F.when(shown, band)})
