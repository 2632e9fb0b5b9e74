"""Panel windows: one partitioning by ticker and one sort by session serve every feature.

Lags count bars; rows with a complete history of consecutive sessions (``history``) are those where bars and sessions
agree, and only those leave ``study_rows``."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The names and order of the feature contract.
FEATURE_NAMES = (
    "return_log_1",
    "return_log_5",
    "return_log_10",
    "return_log_20",
    "overnight_gap_log_1",
    "close_ma_deviation_5",
    "close_ma_deviation_20",
    "volume_log_change_1p_1",
    "volume_zscore_20",
    "zero_volume_flag",
    "volatility_log_return_5",
    "volatility_log_return_20",
    "high_low_log_range_1",
    "atr_14_normalized",
    "parkinson_mean_5",
    "rsi_14",
    "macd_12_26_normalized",
    "macd_signal_9_normalized",
    "benchmark_return_log_1",
    "benchmark_return_log_20",
    "benchmark_volatility_log_return_20",
    "stock_minus_benchmark_return_log_1",
    "benchmark_drawdown_20",
)
HISTORY = 35
PARKINSON = math.sqrt(4 * math.log(2))


def order() -> Window:
    return Window.partitionBy("ticker").orderBy("idx")


def last(n: int) -> Window:
    return order().rowsBetween(1 - n, 0)


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def log_return(column: str, k: int) -> Column:
    return log_ratio(F.col(column), F.lag(column, k).over(order()))


def pct_change(column: str, k: int) -> Column:
    return F.try_divide(F.col(column), F.lag(column, k).over(order())) - 1


def ma_deviation(column: str, n: int) -> Column:
    return F.when(F.count(column).over(last(n)) == n, F.try_divide(F.col(column), F.avg(column).over(last(n))) - 1)


def zscore(column: str, n: int) -> Column:
    """0 without spread, which is tested by the extremes and not by a floating-point deviation."""
    flat = F.max(column).over(last(n)) == F.min(column).over(last(n))
    score = F.try_divide(F.col(column) - F.avg(column).over(last(n)), F.stddev_pop(column).over(last(n)))
    return F.when(F.count(column).over(last(n)) == n, F.when(flat, F.lit(0.0)).otherwise(score))


def volatility(returns: str, n: int) -> Column:
    return F.when(F.count(returns).over(last(n)) == n, F.stddev_pop(returns).over(last(n)))


def rsi(change: str, n: int) -> Column:
    """Simple averages of gains and losses; 50 without moves, 100 without losses."""
    gain = F.avg(F.greatest(F.col(change), F.lit(0.0))).over(last(n))
    loss = F.avg(F.greatest(-F.col(change), F.lit(0.0))).over(last(n))
    value = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return F.when(F.count(change).over(last(n)) == n, value)


def ema_weights(span: int, n: int) -> list[float]:
    """The weights by which the recursion, seeded with the first of n values, mixes them."""
    alpha = 2 / (span + 1)
    return [(1 - alpha) ** (n - 1)] + [alpha * (1 - alpha) ** (n - 1 - i) for i in range(1, n)]


def macd_weights(n: int) -> tuple[list[float], list[float]]:
    """MACD 12/26 and its 9-signal over n values are fixed filters: their weights."""
    lines = [[f - s for f, s in zip(ema_weights(12, m), ema_weights(26, m), strict=True)] + [0.0] * (n - m) for m in range(1, n + 1)]
    signal = [sum(w * line[i] for w, line in zip(ema_weights(9, n), lines, strict=True)) for i in range(n)]
    return lines[-1], signal


def filtered(values: Column, weights: list[float]) -> Column:
    """The weighted sum of an array of len(weights) values."""
    told = F.array(*map(F.lit, weights))
    products = F.zip_with(values, told, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def history(n: int = HISTORY) -> Column:
    """How many of the last n sessions have a bar."""
    return F.count("*").over(Window.partitionBy("ticker").orderBy("idx").rangeBetween(1 - n, 0))


def benchmark_features(cal: DataFrame) -> DataFrame:
    """The benchmark's own windows, on the calendar, to be broadcast to the panel."""
    by = Window.orderBy("idx")
    frame = by.rowsBetween(-19, 0)
    rows = cal.withColumn("r1", log_ratio(F.col("price"), F.lag("price").over(by)))
    return rows.select(
        "session", F.col("r1").alias("benchmark_return_log_1"),
        log_ratio(F.col("price"), F.lag("price", 20).over(by)).alias("benchmark_return_log_20"),
        F.when(F.count("r1").over(frame) == 20, F.stddev_pop("r1").over(frame)).alias("benchmark_volatility_log_return_20"),
        (F.col("price") / F.max("price").over(frame) - 1).alias("benchmark_drawdown_20"),
    )


def risk_features(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """The panel with the 23 features, ``history`` and the daily log return ``r1``."""
    rows = panel.join(F.broadcast(benchmark_features(cal)), "session")
    before = F.lag("close").over(order())
    rows = rows.withColumns({
        "r1": log_return("adj", 1), "change": F.col("adj") - F.lag("adj").over(order()),
        "range": F.ln(F.col("high") / F.col("low")),
        "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        "adjs": F.collect_list("adj").over(last(HISTORY)),
    })
    macd, signal = macd_weights(HISTORY)
    full = F.size("adjs") == HISTORY
    rows = rows.withColumns({
        "return_log_1": F.col("r1"), "return_log_5": log_return("adj", 5), "return_log_10": log_return("adj", 10),
        "return_log_20": log_return("adj", 20), "overnight_gap_log_1": log_ratio(F.col("open"), before),
        "close_ma_deviation_5": ma_deviation("adj", 5), "close_ma_deviation_20": ma_deviation("adj", 20),
        "volume_log_change_1p_1": F.log1p("volume") - F.log1p(F.lag("volume").over(order())),
        "volume_zscore_20": zscore("volume", 20), "zero_volume_flag": (F.col("volume") == 0).cast("int"),
        "volatility_log_return_5": volatility("r1", 5), "volatility_log_return_20": volatility("r1", 20),
        "high_low_log_range_1": F.col("range"),
        "atr_14_normalized": F.when(F.count("true_range").over(last(14)) == 14, F.avg("true_range").over(last(14)) / F.col("close")),
        "parkinson_mean_5": F.avg(F.abs("range") / PARKINSON).over(last(5)), "rsi_14": rsi("change", 14),
        "macd_12_26_normalized": F.when(full, filtered(F.col("adjs"), macd) / F.col("adj")),
        "macd_signal_9_normalized": F.when(full, filtered(F.col("adjs"), signal) / F.col("adj")),
        "stock_minus_benchmark_return_log_1": F.col("r1") - F.col("benchmark_return_log_1"),
        "history": history(),
    })
    return rows.drop("adjs", "change", "true_range", "range")


def volatility_surprise(features: DataFrame, least: float = 1e-8) -> DataFrame:
    """Targets at the exact next session: ``primary`` is the absolute return over the trailing deviation."""
    follows = F.lead("idx").over(order()) == F.col("idx") + 1
    ahead = lambda c: F.when(follows, F.lead(c).over(order()))
    rows = features.withColumns({
        "next_abs": F.abs(log_ratio(ahead("adj"), F.col("adj"))), "next_range": F.abs(log_ratio(ahead("high"), ahead("low"))),
    })
    scale = F.col("volatility_log_return_20")
    return rows.withColumns({
        "primary": F.when(scale > least, F.col("next_abs") / scale), "next_parkinson": F.col("next_range") / PARKINSON,
        "additive": F.col("next_abs") - scale,
    })


def study_rows(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Rows with a full history and a target, with features and targets."""
    rows = volatility_surprise(risk_features(panel, cal))
    return rows.where((F.col("history") == HISTORY) & F.col("primary").isNotNull())


def persistence(rows: DataFrame, least: float = 1e-8) -> DataFrame:
    """The naive forecast: today's absolute return over the trailing deviation."""
    return rows.withColumn("prediction", F.abs("r1") / F.greatest(F.col("volatility_log_return_20"), F.lit(least)))


def forward_label(panel: DataFrame, warm_up: int = 25) -> DataFrame:
    """Return to the ticker's own next bar and whether it is strictly positive, after ``warm_up`` bars."""
    rows = panel.withColumns({"forward_return": F.lead("adj").over(order()) / F.col("adj") - 1, "bar": F.row_number().over(order())})
    return rows.where((F.col("bar") > warm_up) & F.col("forward_return").isNotNull()).withColumn(
        "label_up", (F.col("forward_return") > 0).cast("int")
    )


def macd_full(panel: DataFrame) -> DataFrame:
    """MACD seeded at the ticker's first bar: unbounded recursion, one ticker's bars at a time in Arrow."""
    def recur(rows):
        rows = rows.sort_values("idx")
        fast, slow = (rows["adj"].ewm(span=n, adjust=False).mean() for n in (12, 26))
        rows["macd"] = fast - slow
        rows["macd_signal"] = rows["macd"].ewm(span=9, adjust=False).mean()
        return rows[["ticker", "session", "macd", "macd_signal"]]

    kind = "ticker string, session date, macd double, macd_signal double"
    return panel.select("ticker", "session", "idx", "adj").groupBy("ticker").applyInPandas(recur, kind)


def anchor_features(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Return, deviation, the benchmark's, the difference, and volume against the 20 sessions before."""
    earlier = order().rowsBetween(-20, -1)
    rows = panel.join(F.broadcast(benchmark_features(cal)), "session").withColumn("r1", log_return("adj", 1))
    flat = F.max("volume").over(earlier) == F.min("volume").over(earlier)
    z = F.try_divide(F.col("volume") - F.avg("volume").over(earlier), F.stddev_pop("volume").over(earlier))
    return rows.select(
        "ticker", "session", "r1", volatility("r1", 20).alias("std20"), F.col("benchmark_return_log_1").alias("bench_r1"),
        F.col("benchmark_volatility_log_return_20").alias("bench_std20"),
        (F.col("r1") - F.col("benchmark_return_log_1")).alias("relative"),
        F.when(F.count("volume").over(earlier) == 20, F.when(flat, F.lit(0.0)).otherwise(z)).alias("volume_z"),
    )
