"""Metrics, rankings, comparisons and threshold choices as grouped aggregates and windows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def linear_quantile(df: DataFrame, column: str, q: float, by: list[str]) -> DataFrame:
    """The exact quantile with linear interpolation, as ``percentile`` gives it, without a map of a group's distinct values in
    one task: rows are counted by stretches of values, and only the rows of the stretch (or two) that holds the place of
    the quantile are counted by value."""
    rows = df.select(F.struct(*by).alias("_g"), F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL").withColumn("_s", stretch("_v"))
    own = rows.groupBy("_g", "_s").agg(F.count("*").alias("_own"))
    upto = F.sum("_own").over(Window.partitionBy("_g").orderBy("_s"))
    place = (F.sum("_own").over(Window.partitionBy("_g")) - 1) * F.lit(q)
    bases = own.select("_g", "_s", (upto - F.col("_own")).alias("_base"), upto.alias("_upto"), place.alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    inside = lambda at, first, end: (first <= at) & (at < end)
    bases = bases.where(inside(low, F.col("_base"), F.col("_upto")) | inside(high, F.col("_base"), F.col("_upto"))).drop("_upto")
    values = rows.join(bases, ["_g", "_s"]).groupBy("_g", "_s", "_v", "_base", "_at").agg(F.count("*").alias("_own"))
    running = F.sum("_own").over(Window.partitionBy("_g", "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("_end", F.col("_base") + running)
    held = lambda at: F.max(F.when(inside(at, F.col("_end") - F.col("_own"), F.col("_end")), F.col("_v")))
    found = values.groupBy("_g").agg(held(low).alias("_low"), held(high).alias("_high"), F.max("_at").alias("_at"))
    between = (high - F.col("_at")) * F.col("_low") + (F.col("_at") - low) * F.col("_high")
    found = found.select("_g", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("quantile"))
    groups = df.select(F.struct(*by).alias("_g")).distinct()
    return groups.join(found, "_g", "left").select(*(F.col(f"_g.{c}").alias(c) for c in by), "quantile")


def fold_tertiles(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """Cut points of each fold from its training rows only."""
    cuts = F.array(F.lit(1 / 3), F.lit(2 / 3))
    rows = assigned.where("role = 'train'").groupBy("fold").agg(*(F.percentile(c, cuts).alias(c) for c in columns))
    return rows.select("fold", *(F.col(c)[i].alias(f"{c}_{n}") for c in columns for i, n in enumerate(("low", "high"))))


def confusion(y: str, hit: Column) -> list[Column]:
    one = F.col(y) == 1
    return [F.sum(c.cast("long")).alias(n) for n, c in
            (("tp", one & hit), ("fp", ~one & hit), ("fn", one & ~hit), ("tn", ~one & ~hit))]


def confusion_metrics(df: DataFrame) -> DataFrame:
    """Adds the usual ratios to ``tp, fp, fn, tn``; a ratio without a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    df = df.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })
    return df.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def ranking_metrics(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Average precision and ROC area; equal scores form one step."""
    steps = df.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    down = Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    average = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return steps.groupBy(*by).agg(
        F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("roc_auc"), F.try_divide(average, F.sum("pos")).alias("average_precision")
    )


def binary_metrics(df: DataFrame, y: str, p: str, threshold: float, by: list[str]) -> DataFrame:
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), *confusion(y, F.col(p) >= threshold)
    )
    return confusion_metrics(counts).join(ranking_metrics(df, y, p, by), by)


def calibration(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """Uniform bins; empty ones stay, with nulls."""
    placed = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    found = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    empty = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return empty.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def prob_buckets(df: DataFrame, y: str, p: str, edges: list[float]) -> DataFrame:
    """Buckets [low, high), the last one closed."""
    made = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(b == edges[-1]).alias("last")) for a, b in zip(edges, edges[1:])))
    buckets = df.sparkSession.range(1).select(F.explode(made).alias("b")).select("b.*")
    inside = (F.col(p) >= F.col("low")) & ((F.col(p) < F.col("high")) | (F.col("last") & (F.col(p) == F.col("high"))))
    found = df.select(p, y).join(F.broadcast(buckets), inside).groupBy(F.col("low").alias("_low")).agg(F.count("*").alias("n"), F.avg(y).alias("rate"))
    return buckets.join(found, F.col("low") == F.col("_low"), "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"), "rate")


def threshold_table(df: DataFrame, y: str, p: str, by: list[str], steps: int = 50) -> DataFrame:
    """Confusion counts for the thresholds 0.01 to ``steps`` / 100 of each group, from one histogram and running sums."""
    bucket = F.least(F.floor(F.round(F.col(p) * 1_000_000) / 10_000), F.lit(steps)).cast("int")
    counted = df.groupBy(*by, bucket.alias("step")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    grid = counted.select(*by).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    full = grid.join(counted, [*by, "step"], "left").fillna(0, ["pos", "neg"])
    up = Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    full = full.withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up)})
    full = full.withColumns({"fn": F.sum("pos").over(whole) - F.col("tp"), "tn": F.sum("neg").over(whole) - F.col("fp")})
    return confusion_metrics(full.where("step > 0")).withColumn("threshold", F.col("step") / 100).drop("pos", "neg")


def class_report(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Per class: support, precision, recall and F1."""
    pairs = df.groupBy(truth, said).agg(F.count("*").alias("n"))
    sides = pairs.select(F.col(truth).alias("label"), "n", F.lit(1).alias("is_true"), (F.col(truth) == F.col(said)).cast("int").alias("same")).unionByName(
        pairs.where(F.col(truth) != F.col(said)).select(F.col(said).alias("label"), "n", F.lit(0).alias("is_true"), F.lit(0).alias("same")))
    sums = sides.groupBy("label").agg(
        F.sum(F.col("n") * F.col("is_true")).alias("support"), F.sum(F.col("n") * F.col("same")).alias("tp"),
        F.sum(F.col("n") * (1 - F.col("is_true"))).alias("fp"),
    )
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("tp") + F.col("fp")), F.lit(0.0))
    return sums.select("label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    error = F.col(p) - F.col(y)
    total = F.sum(F.col(y) ** 2) - F.count(y) * F.avg(y) ** 2
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error**2)).alias("rmse"),
        (1 - F.try_divide(F.sum(error**2), total)).alias("r2"),
    )


def stretch(value: str) -> Column:
    """A number that never falls as the value rises and that values within about one percent share; null is the smallest
    and NaN the largest, as in Spark's own order."""
    size = F.floor(F.log2(1 + F.abs(F.col(value).cast("double")) * 1024) * 64)
    placed = F.when(F.isnan(value), 2**62).otherwise(F.when(F.col(value) < 0, -size).otherwise(size))
    return F.coalesce(placed, F.lit(-(2**62)))


def value_cells(df: DataFrame, by: list[str], value: str, more: tuple[str, ...], falling: bool) -> DataFrame:
    """``by, _cell, _own, _before, _n``: the rows that share a value (and ``more``), the rows of the group before them, and
    the group's rows. ``_cell`` is a struct, so that nulls meet in joins. Values are counted first, and the running sum
    has two levels, stretches of values and the distinct values of a stretch; tied rows are a number there and no work."""
    cell = F.struct(F.col(value).alias("v"), *more)
    own = df.groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("_own")).withColumn("_v", F.col("_cell.v"))
    own = own.withColumn("_s", stretch("_v"))
    sums = own.groupBy(*by, "_s").agg(F.sum("_own").alias("_all"))
    rising = lambda c: F.desc(c) if falling else F.asc(c)
    upto = F.sum("_all").over(Window.partitionBy(*by).orderBy(rising("_s")))
    bases = sums.select(*by, "_s", (upto - F.col("_all")).alias("_base"), F.sum("_all").over(Window.partitionBy(*by)).alias("_n"))
    inside = Window.partitionBy(*by, "_s").orderBy(rising("_v"), *(f"_cell.{c}" for c in more)).rowsBetween(Window.unboundedPreceding, 0)
    placed = own.join(bases, [*by, "_s"]).withColumn("_before", F.col("_base") + F.sum("_own").over(inside) - F.col("_own"))
    return placed.select(*by, "_cell", "_own", "_before", "_n")


def positions(df: DataFrame, by: list[str], score: str, minor: tuple[str, ...] = ("session", "ticker")) -> DataFrame:
    """Adds ``_r``, the place of a row in its group by falling score and rising ``minor``, and ``_n``, the group's rows.
    Rows are only ordered among those of one score and one first ``minor``, so a score that all rows hold is as many tasks
    as there are sessions."""
    first, *rest = minor
    cells = value_cells(df, by, score, (first,), True)
    rows = df.withColumn("_cell", F.struct(F.col(score).alias("v"), first)).join(cells, [*by, "_cell"])
    order = Window.partitionBy(*by, "_cell").orderBy(*(rest or [F.lit(0)]))
    return rows.withColumn("_r", F.col("_before") + F.row_number().over(order)).drop("_cell", "_own", "_before")


def average_rank(df: DataFrame, by: list[str], value: str, source: DataFrame) -> DataFrame:
    """Adds ``_rank_<value>``; ``source`` is the frame whose rows are counted. A rank follows from counts of distinct values;
    rows of one value meet it in a plain join, whose hot values adaptive execution splits."""
    cells = value_cells(source, by, value, (), False)
    rows = df.withColumn("_cell", F.struct(F.col(value).alias("v"))).join(cells, [*by, "_cell"])
    return rows.withColumn(f"_rank_{value}", F.col("_before") + (F.col("_own") + 1) / 2).drop("_cell", "_own", "_before", "_n")


def spearman(df: DataFrame, x: str, y: str, by: list[str], of_y: DataFrame | None = None, y_by: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks; 0 and a flag where one side is constant. Equal pairs are one weighted row. Where groups
    of ``by`` have the same ``y`` in all their rows, ``of_y`` may give these once per group of ``y_by``, a part of ``by``, to be ranked once."""
    slim = df.select(*by, x, y)
    pairs = slim.groupBy(*by, x, y).agg(F.count("*").alias("_w"))
    rows = average_rank(average_rank(pairs, by, x, slim), y_by or by, y, slim if of_y is None else of_y.select(*(y_by or by), y))
    a, b, w = F.col(f"_rank_{x}"), F.col(f"_rank_{y}"), F.col("_w").cast("double")
    half = (F.sum("_w") + 1) / 2
    moments = rows.groupBy(*by).agg(
        (F.max(x) == F.min(x)).alias("_fx"), (F.max(y) == F.min(y)).alias("_fy"), F.sum("_w").alias("_n"), half.alias("_m"),
        F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"))
    off = F.col("_n") * F.col("_m") ** 2
    rho = F.try_divide(F.col("_ab") - off, F.sqrt((F.col("_aa") - off) * (F.col("_bb") - off)))
    flat = F.col("_fx") | F.col("_fy")
    return moments.select(*by, F.when(flat, 0.0).otherwise(rho).alias("rho"), flat.alias("constant"))


def lift(df: DataFrame, y: str, score: str, q: float, by: list[str]) -> DataFrame:
    """Mean target of the top ceil(q * n) over the mean of all; null where that is 0."""
    rows = positions(df, by, score)
    top = F.when(F.col("_r") <= F.ceil(F.col("_n") * q), F.col(y))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.try_divide(F.avg(top), F.nullif(F.avg(y), F.lit(0.0))).alias("lift"))


def assign_deciles(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """D10 is the top; position * 10 / n, not ``ntile``, which deals remainders otherwise."""
    bucket = F.least(F.floor((F.col("_r") - 1) * 10 / F.col("_n")), F.lit(9))
    return positions(df, by, score).withColumn("decile", (10 - bucket).cast("int")).drop("_r", "_n")


def decile_summary(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    rows = df.groupBy(*by, "decile").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("mean_y"),
        F.percentile(y, F.lit(0.5)).alias("median_y"), F.stddev_samp(y).alias("std_y"),
    )
    before = F.lag("mean_y").over(Window.partitionBy(*by).orderBy("decile"))
    return rows.withColumn("non_decreasing", F.col("mean_y") >= before)


def ecdf_band(df: DataFrame, score: str, reference: DataFrame, rows: str | None = None) -> DataFrame:
    """Right-inclusive percentile of each score in the reference scores, and its band. Both are counted by value first,
    and the running sum runs in two levels, over ranges of values and over the values of a range, so no task sorts them all. ``rows`` names the reference's counts, if it has any."""
    weight = (F.col(rows) if rows else F.lit(1)).cast("long")
    both = reference.select(F.col(score).alias("v"), weight.alias("c")).unionByName(df.select(F.col(score).alias("v"), F.lit(0).cast("long").alias("c")))
    counted = both.groupBy("v").agg(F.sum("c").alias("c")).withColumn("stretch", stretch("v"))
    total = reference.agg(F.sum(weight)).first()[0] if rows else reference.count()
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.groupBy("stretch").agg(F.sum("c").alias("own")).select("stretch", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("stretch").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("base") + F.sum("c").over(inside)
    placed = counted.join(bases, "stretch").select(F.col("v").alias(score), (upto / total).alias("percentile"))
    p = F.col("percentile")
    band = F.when(p >= 0.95, "P95").when(p >= 0.80, "P80").when(p >= 0.50, "P50").otherwise("BELOW")
    return df.join(placed, score).withColumn("band", band)


def separation(df: DataFrame, outcome: str, said: str, by: list[str], least: int = 1) -> DataFrame:
    """Means and medians of the outcome for predicted 1 and 0, and their difference where both cells are large enough."""
    pick = lambda v: F.when(F.col(said) == v, F.col(outcome))
    rows = df.groupBy(*by).agg(
        F.count(pick(1)).alias("n_high"), F.count(pick(0)).alias("n_normal"), F.avg(pick(1)).alias("mean_high"), F.avg(pick(0)).alias("mean_normal"),
        F.percentile(pick(1), F.lit(0.5)).alias("median_high"), F.percentile(pick(0), F.lit(0.5)).alias("median_normal"),
    )
    enough = (F.col("n_high") >= least) & (F.col("n_normal") >= least)
    return rows.withColumns({
        "difference": F.when(enough, F.col("mean_high") - F.col("mean_normal")), "status": F.when(enough, "OK").otherwise("INSUFFICIENT"),
    })


def composition(df: DataFrame, key: str, said: str) -> DataFrame:
    """Shares of each key value in both predicted groups."""
    one, zero = F.sum(F.col(said)), F.sum(1 - F.col(said))
    whole = Window.partitionBy(F.lit(0))
    rows = df.groupBy(key).agg(one.alias("h"), zero.alias("o"))
    return rows.select(key, (F.col("h") / F.sum("h").over(whole)).alias("share_high"), (F.col("o") / F.sum("o").over(whole)).alias("share_normal"))


def total_variation(shares: DataFrame) -> DataFrame:
    return shares.agg((F.sum(F.abs(F.col("share_high") - F.col("share_normal"))) / 2).alias("distance"))


def standardise(df: DataFrame, key: str, outcome: str, said: str) -> DataFrame:
    """The observed difference, the one with both groups weighted like all rows over ``key``, and what composition adds."""
    pick = lambda v: F.when(F.col(said) == v, F.col(outcome))
    cells = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(pick(1)).alias("h"), F.avg(pick(0)).alias("o"))
    cells = cells.where("h IS NOT NULL AND o IS NOT NULL")
    direct = cells.agg((F.sum(F.col("n") * (F.col("h") - F.col("o"))) / F.sum("n")).alias("standardised"), F.min(F.col("h") - F.col("o")).alias("least"), F.max(F.col("h") - F.col("o")).alias("most"))
    seen = df.agg((F.avg(pick(1)) - F.avg(pick(0))).alias("observed"))
    rows = seen.crossJoin(direct)
    reversal = ((F.col("least") > 0) & (F.col("observed") < 0)) | ((F.col("most") < 0) & (F.col("observed") > 0))
    return rows.select("observed", "standardised", (F.col("observed") - F.col("standardised")).alias("composition"), reversal.alias("reversal"))


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def select_params(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Best mean correlation, then error, worst correlation, complexity and name."""
    order = [F.desc(F.round("mean_rho", 9)), F.round("mae", 9), F.desc(F.round("worst_rho", 9)), F.col("complexity"), F.col("params")]
    return first_by(evidence, by, order)


def select_model(summary: DataFrame, margin: float = 0.01) -> DataFrame:
    """Among models within ``margin`` of the best correlation: error, worst correlation, complexity, name."""
    best = F.max("mean_rho").over(Window.partitionBy(F.lit(0)))
    near = summary.withColumn("_best", best).where(F.col("mean_rho") >= F.col("_best") - margin).drop("_best")
    return first_by(near, [], [F.round("mae", 9), F.desc(F.round("worst_rho", 9)), F.col("complexity"), F.col("model")])


def operating_modes(table: DataFrame, rules: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """For each mode, the first row in its order that meets its constraint; INCONCLUSIVE where none does."""
    names = F.array(*(F.struct(F.lit(n).alias("mode"), F.lit(i).alias("at")) for i, n in enumerate(rules)))
    modes = table.sparkSession.range(1).select(F.explode(names).alias("m")).select("m.*")
    picked = [first_by(table.where(ok), [], order).withColumn("mode", F.lit(n)) for n, (ok, order) in rules.items()]
    found = reduce(DataFrame.unionByName, picked)
    return modes.join(found, "mode", "left").withColumn("status", F.when(F.col("threshold").isNull(), "INCONCLUSIVE").otherwise("SELECTED")).drop("at")


def regime_policy(table: DataFrame, least_recall: float, least_specificity: float) -> DataFrame:
    """One threshold per regime: all triplets of the three small tables that meet the constraints, the most even first."""
    part = lambda name: table.where(F.col("regime") == name).where(
        (F.col("recall") >= least_recall) & (F.col("specificity") >= least_specificity)
    ).select(*(F.col(c).alias(f"{c}_{name.lower()}") for c in ("threshold", "recall", "specificity", "tp", "fp", "fn", "tn")))
    triples = part("LOW").crossJoin(F.broadcast(part("MIDDLE"))).crossJoin(F.broadcast(part("HIGH")))
    names = ("low", "middle", "high")
    spread = lambda c: F.greatest(*(f"{c}_{n}" for n in names)) - F.least(*(f"{c}_{n}" for n in names))
    sums = {c: F.col(f"{c}_low") + F.col(f"{c}_middle") + F.col(f"{c}_high") for c in ("tp", "fp", "fn", "tn")}
    triples = confusion_metrics(triples.withColumns(sums)).withColumn("unevenness", F.greatest(spread("recall"), spread("specificity")))
    order = [F.round("unevenness", 9), F.desc(F.round("mcc", 9)), F.desc(F.round("f1", 9)), *(F.col(f"threshold_{n}") for n in names)]
    return first_by(triples, [], order).select(*(f"threshold_{n}" for n in names), "unevenness", "mcc", "f1")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa and raw agreement; 1 where chance alone would agree always."""
    n = F.sum("n").over(Window.partitionBy(F.lit(0)))
    pairs = df.groupBy(a, b).agg(F.count("*").alias("n")).withColumn("total", n)
    left = pairs.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("l"), F.first("total").alias("total"))
    right = pairs.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("m"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("l") * F.col("m") / F.col("total") / F.col("total")), F.lit(0.0)).alias("e"))
    seen = pairs.agg((F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"), F.sum("n").alias("n"))
    value = F.when(F.col("e") == 1, 1.0).otherwise((F.col("agreement") - F.col("e")) / (1 - F.col("e")))
    return seen.crossJoin(chance).select("n", "agreement", value.alias("kappa"))


def cluster_bootstrap(df: DataFrame, y: str, p: str, reps: int, seed: int) -> DataFrame:
    """Per fold: the mean absolute error and its 95 % interval over ``reps`` draws of whole sessions. Draws are
    multiplicities from a hash, and sessions enter by their sums, so no row is copied."""
    sums = df.groupBy("fold", "session").agg(F.sum(F.abs(F.col(p) - F.col(y))).alias("e"), F.count("*").alias("c"))
    of = Window.partitionBy("fold")
    sums = sums.withColumns({"at": F.row_number().over(of.orderBy("session")) - 1, "s": F.count("*").over(of)})
    slots = sums.select("fold", "s", F.col("at").alias("j")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    key = F.concat_ws("|", F.lit(seed), "rep", "fold", "j")
    drawn = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.col("s"))
    weights = slots.withColumn("at", drawn).groupBy("fold", "rep", "at").agg(F.count("*").alias("w"))
    each = weights.join(sums, ["fold", "at"]).groupBy("fold", "rep").agg((F.sum(F.col("w") * F.col("e")) / F.sum(F.col("w") * F.col("c"))).alias("mae"))
    ends = F.percentile("mae", F.array(F.lit(0.025), F.lit(0.975)))
    whole = sums.groupBy("fold").agg((F.sum("e") / F.sum("c")).alias("mae"))
    return each.groupBy("fold").agg(ends.alias("ci")).join(whole, "fold").select("fold", "mae", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))
