"""Bootstrap of rankings by whole sessions, stratified by fold: all replicates at once, by multiplicities.

A replicate draws as many sessions of a fold as it has, with replacement. No row is copied: a session carries an array of
how often each replicate has drawn it. Errors and decile means come from sums per session. Rank correlation needs the
average rank of a value under the multiplicities of its rows, and lift the mean target of the first tenth of the drawn
rows; both need running sums of weights over all values in order. These run in two levels: sums per stretch of values
first, with the sums of all stretches before; then each stretch streams its values in order. A value that many rows
share enters as one cell per session, so no task grows with it, and a task holds one batch of values at a time.

Rows need ``fold, session, ticker``; null scores or targets are left out. A replicate in which a fold's scores or targets
are all equal has correlation 0 there; a fold without drawn target (sum 0) has no lift, and its replicate has none."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import stats

METRICS = ["mae", "rmse", "rho", "lift"]
MOST_SESSIONS = 100_000
SLICE = 512


def session_draws(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """``fold, session, w``: how often each replicate draws the session; a hash decides, so any run draws alike."""

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("session", ignore_index=True)
        n, fold = len(own), own["fold"].iloc[0]
        w = np.zeros((n, reps), dtype=np.int32)
        for rep in range(reps):
            at = [int(hashlib.md5(f"{seed}|{rep}|{fold}|{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]
            w[:, rep] = np.bincount(at, minlength=n)
        return own.assign(w=list(w))

    sessions = rows.select(F.col("fold").cast("string").alias("fold"), "session").distinct()
    if sessions.limit(MOST_SESSIONS + 1).count() > MOST_SESSIONS:
        raise ValueError(f"more than {MOST_SESSIONS} sessions and folds")
    return sessions.groupBy("fold").applyInPandas(draw, "fold string, session date, w array<int>")


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length, without nulls, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def stretch_bases(cells: DataFrame, draws: DataFrame, falling: bool) -> DataFrame:
    """``fold, _s, base, total``: drawn weight of the stretches before each one, and of the whole fold, by replicate."""

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        total = (np.stack(rows["w"].to_numpy()).astype(np.int64) * rows["c"].to_numpy()[:, None]).sum(axis=0)
        return pd.DataFrame({"fold": rows["fold"].iloc[:1], "_s": rows["_s"].iloc[:1], "own": [total.tolist()]})

    def before(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_s", ascending=not falling)
        weights = np.stack(rows["own"].to_numpy())
        upto = np.cumsum(weights, axis=0)
        return pd.DataFrame({"fold": rows["fold"], "_s": rows["_s"], "base": list(upto - weights), "total": [upto[-1]] * len(rows)})

    counts = cells.groupBy("fold", "_s", "session").agg(F.sum("c").alias("c")).join(F.broadcast(draws), ["fold", "session"])
    sums = counts.groupBy("fold", "_s").applyInPandas(own, "fold string, _s long, own array<long>")
    return sums.groupBy("fold").applyInPandas(before, "fold string, _s long, base array<long>, total array<long>")


def in_order(cells: DataFrame, draws: DataFrame, order: list, falling: bool) -> DataFrame:
    """The cells of each stretch in order, behind a row with the stretch's base and total; weights are joined."""
    bases = stretch_bases(cells, draws, falling)
    rows = bases.withColumn("_first", F.lit(0)).unionByName(cells.withColumn("_first", F.lit(1)), allowMissingColumns=True)
    # The weights (a row per session and fold) are joined behind the shuffle; a sort below a join would be left out.
    laid = rows.repartition("fold", "_s").join(F.broadcast(draws), ["fold", "session"], "left")
    return laid.sortWithinPartitions("fold", "_s", "_first", *order)


def weighted_ranks(rows: DataFrame, value: str, draws: DataFrame) -> DataFrame:
    """``fold, value, rank``: the average rank of each value in each replicate (where nothing drawn has it, the place
    between its neighbours)."""
    cells = rows.groupBy("fold", "session", F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("_s", stats.stretch("v"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = held = None  # weight before the current value, weight of the value so far
        at = None  # the current fold and value

        def told(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["fold", "v", "rank"],
            )

        found: list = []
        for batch in batches:
            firsts, folds, values = batch.column("_first").to_pylist(), batch.column("fold").to_pylist(), batch.column("v").to_pylist()
            counts, bases, weights = batch.column("c").to_pylist(), batch.column("base"), batch.column("w")
            for k, first in enumerate(firsts):
                key = None if first == 0 else (folds[k], values[k])
                if at is not None and key != at:
                    found.append((*at, upto + (held + 1) / 2))
                    upto, at = upto + held, None
                if first == 0:
                    upto = bases[k].values.to_numpy().astype(float)
                elif at is None:
                    at, held = key, counts[k] * weights[k].values.to_numpy().astype(float)
                else:
                    held = held + counts[k] * weights[k].values.to_numpy()
                if len(found) >= SLICE:
                    yield told(found)
                    found = []
        if at is not None:
            found.append((*at, upto + (held + 1) / 2))
        if found:
            yield told(found)

    laid = in_order(cells, draws, ["v", "session"], False).select("fold", "_first", F.col("v").cast("double").alias("v"), "c", "base", "w")
    return laid.mapInArrow(rank, "fold string, v double, rank array<double>").withColumnRenamed("v", value)


def rank_correlations(rows: DataFrame, score: str, y: str, draws: DataFrame) -> DataFrame:
    """``fold, rep, rho``."""
    cells = rows.groupBy("fold", "session", score, y).agg(F.count("*").alias("c"))
    a = weighted_ranks(rows, score, draws).withColumnRenamed("rank", "a")
    b = weighted_ranks(rows, y, draws).withColumnRenamed("rank", "b")
    ranked = cells.join(a, ["fold", score]).join(b, ["fold", y]).join(F.broadcast(draws), ["fold", "session"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for first in range(0, len(batch), SLICE):
                part = batch.slice(first, SLICE)
                folds = np.array(part.column("fold").to_pylist(), dtype=object)
                w = stacked(part.column("w")) * part.column("c").to_numpy()[:, None]
                x, z = stacked(part.column("a")), stacked(part.column("b"))
                terms = [w, w * x, w * z, w * x * x, w * z * z, w * x * z]
                for f in set(folds.tolist()):
                    own = np.stack([t[folds == f].sum(axis=0) for t in terms]).astype(float)
                    held[f] = own + held.get(f, 0.0)
        for f, total in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * total.shape[1]), pa.array(range(total.shape[1]), pa.int32()), *(pa.array(t) for t in total)],
                names=["fold", "rep", "w", "wx", "wz", "wxx", "wzz", "wxz"],
            )

    kind = "fold string, rep int, w double, wx double, wz double, wxx double, wzz double, wxz double"
    total = ranked.select("fold", "c", "w", "a", "b").mapInArrow(sums, kind).groupBy("fold", "rep").agg(
        *(F.sum(c).alias(c) for c in ("w", "wx", "wz", "wxx", "wzz", "wxz")))
    spread = lambda s, ss: F.col(ss) - F.col(s) ** 2 / F.col("w")
    over = F.sqrt(spread("wx", "wxx") * spread("wz", "wzz"))
    flat = (spread("wx", "wxx") < 1e-6) | (spread("wz", "wzz") < 1e-6)
    return total.select("fold", "rep", F.when(flat, 0.0).otherwise((F.col("wxz") - F.col("wx") * F.col("wz") / F.col("w")) / over).alias("rho"))


def top_sums(rows: DataFrame, score: str, y: str, draws: DataFrame, fraction: float) -> DataFrame:
    """``fold, rep, k, top``: the sum of the target over the first ``k`` = ceil(fraction * n) drawn rows by falling score,
    session and ticker; a row that is drawn often may count in part."""
    cells = rows.select("fold", "session", "ticker", F.col(score).alias("v"), F.col(y).cast("double").alias("y"), F.lit(1).cast("long").alias("c"))
    cells = cells.withColumn("_s", stats.stretch("v"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        upto = k = fold = None
        for batch in batches:
            firsts, folds = batch.column("_first").to_pylist(), batch.column("fold").to_pylist()
            targets, bases, totals, weights = (batch.column(c) for c in ("y", "base", "total", "w"))
            for i, first in enumerate(firsts):
                if first == 0:
                    fold = folds[i]
                    upto = bases[i].values.to_numpy().astype(np.int64)
                    k = np.ceil(np.round(fraction * totals[i].values.to_numpy(), 9)).astype(np.int64)
                    held.setdefault(fold, (k, np.zeros(len(k))))
                    continue
                w = weights[i].values.to_numpy()
                if (upto < k).any():
                    held[fold][1][:] += targets[i].as_py() * np.clip(k - upto, 0, w)
                upto = upto + w
        for f, (ks, top) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(ks)), pa.array(range(len(ks)), pa.int32()), pa.array(ks), pa.array(top)], names=["fold", "rep", "k", "top"])

    laid = in_order(cells, draws, [F.desc("v"), "session", "ticker"], True).select("fold", "_first", "y", "base", "total", "w")
    parts = laid.mapInArrow(take, "fold string, rep int, k long, top double")
    return parts.groupBy("fold", "rep").agg(F.max("k").alias("k"), F.sum("top").alias("top"))


def session_sums(rows: DataFrame, by: list[str], columns: list[str], draws: DataFrame) -> DataFrame:
    """Per group of ``by`` and replicate, the drawn sums of columns that are summed per session first."""
    slim = rows.groupBy(*by, "session").agg(*(F.sum(c).cast("double").alias(c) for c in columns))
    if "fold" not in by:
        raise ValueError("draws are made per fold")

    def total(own: pd.DataFrame) -> pd.DataFrame:
        w = np.stack(own["w"].to_numpy()).astype(float)
        sums = w.T @ own[columns].to_numpy(dtype=float)
        out = pd.DataFrame(sums, columns=columns)
        return out.assign(rep=range(len(out)), **{c: own[c].iloc[0] for c in by})

    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in by)
    joined = slim.join(F.broadcast(draws), ["fold", "session"])
    return joined.groupBy(*by).applyInPandas(total, f"{', '.join(f'`{c}` double' for c in columns)}, rep int, {kinds}")


def replicates(rows: DataFrame, y: str, p: str, score: str, reps: int = 1000, seed: int = 7, fraction: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """``rep, mae, rmse, rho, lift``, each the mean over folds, and ``rep, decile, mean_y`` over all drawn rows. Deciles are
    those of the whole sample of each fold."""
    rows = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull()).withColumn("fold", F.col("fold").cast("string"))
    draws = session_draws(rows, reps, seed)
    error = F.col(p) - F.col(y)
    told = rows.withColumns({"_abs": F.abs(error), "_square": error**2, "_one": F.lit(1), "_target": F.col(y).cast("double")})
    sums = session_sums(told, ["fold"], ["_abs", "_square", "_one", "_target"], draws)
    each = sums.join(rank_correlations(rows, score, y, draws), ["fold", "rep"]).join(top_sums(rows, score, y, draws, fraction), ["fold", "rep"])
    lift = F.try_divide(F.col("top") / F.col("k"), F.col("_target") / F.col("_one"))
    each = each.select("fold", "rep", (F.col("_abs") / F.col("_one")).alias("mae"), F.sqrt(F.col("_square") / F.col("_one")).alias("rmse"), "rho", lift.alias("lift"))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c)
    metrics = each.groupBy("rep").agg(*map(whole, METRICS))
    placed = stats.assign_deciles(told, score, ["fold"])
    deciles = session_sums(placed, ["fold", "decile"], ["_target", "_one"], draws).groupBy("rep", "decile").agg(F.try_divide(F.sum("_target"), F.sum("_one")).alias("mean_y"))
    return metrics, deciles


def intervals(metrics: DataFrame, deciles: DataFrame, level: float = 0.95) -> DataFrame:
    """``name, replicates, mean, low, high``: percentile intervals of the metrics and of each decile's mean target."""
    ends = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    long = metrics.select(F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("x")) for m in METRICS))).alias("m")).select("m.*")
    long = long.unionByName(deciles.select(F.concat(F.lit("D"), "decile").alias("name"), F.col("mean_y").alias("x"))).where("x IS NOT NULL")
    rows = long.groupBy("name").agg(F.count("*").alias("replicates"), F.avg("x").alias("mean"), F.percentile("x", ends).alias("ci"))
    return rows.select("name", "replicates", "mean", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))
