"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each document gets a vector of six transformed statistics. Per group of one language and source the minimum covariance
determinant estimate is sought, regularised so that no group is singular: of all halves (``share``) of the group's
documents the one whose covariance, plus the squares of ``FLOORS`` on its diagonal, has the least determinant.

1. **Starts.** Of a bounded sample of a group, ``SAMPLE`` documents by hash, ``TRIALS`` random subsets of one document
   more than there are statistics, and the half nearest to the coordinates' medians, are each concentrated twice inside
   the sample; the ``KEEP`` estimates of least determinant go on.
2. **Concentration** over *all* documents of the group, for each of these: distances from the current estimate, the half
   nearest by them (to a bin of a fine histogram, so every run finds the same ones), its mean and covariance, and so
   on for ``steps`` steps; each lowers the determinant. The least one is the estimate.
3. **Consistency.** Squared Mahalanobis distances are scaled so that the group's median is the chi-square median.

A document goes if its scaled squared distance is beyond the value that a chi-square variable exceeds with probability
``tail``. The statistics have heavier tails than normal ones, hence a far tail: on labelled rows the distances of junk
start at many times those of the worst good document.

Sources with fewer than ``min_group`` documents are pooled per language, languages that stay smaller are pooled
together, and a pool with fewer than four documents per statistic has no outliers.

Defined cases: null and empty texts have no words and fail the base rules; null language or source is a value of its
own; equal rows get equal verdicts; a group without spread uses the floors of ``FLOORS``; empty tables give no rows.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm import textkit
from panelspark.llm.decontaminate import broadcast_if_small
from panelspark.llm.store import materialise

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = ["v_word_length", "v_symbols", "v_upper", "v_digits", "v_marks", "v_stutter"]
FLOORS = np.array([0.10, 0.10, 0.15, 0.20, 0.15, 0.10])  # least standard deviation of each statistic
P = len(VECTOR)
SAMPLE, SLICES, TRIALS, KEEP = 512, 16, 200, 3
MOST_GROUPS = 30_000  # up to which tables of a row per group and start are broadcast
# Shares are taken as if each text also had this much usual text: short texts vary more, and are no outliers for that.
PRIOR_CHARS, PRIOR_WORDS = 600, 120
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
DIGITS = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)
MARKS = np.isin(np.arange(256), np.frombuffer(b"!\"'(),-./:;?[]_{}", np.uint8))
LEADING = (np.arange(256) & 0xC0) != 0x80  # the first byte of each code point


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _repeated(words: textkit.Words, k: int) -> np.ndarray:
    """Per document: words inside k-word windows that occur there twice or more."""
    n = len(words.hash)
    if n < k:
        return np.zeros(words.n_docs, dtype=np.int64)
    inside = np.flatnonzero(words.local[: n - k + 1] == words.local[k - 1 :])
    key = textkit.mix(words.windows(k)[inside] + words.local[inside].astype(np.uint64) * textkit.BASE)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, inside[twice], 1)
    np.add.at(cover, inside[twice] + k, -1)
    return np.bincount(words.local[np.cumsum(cover)[:n] > 0], minlength=words.n_docs)


def _dup_lines(words: textkit.Words) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    size = len(words.bytes)
    breaks = words.bytes == 0x0A
    edge = np.zeros(size + 1, dtype=bool)
    edge[words.offsets] = True
    edge[1:] |= breaks
    begin = np.flatnonzero(edge[:size])
    if not len(begin) or not len(words.start):
        return np.zeros(words.n_docs, dtype=np.int64)
    finish = np.concatenate([begin[1:], [size]])
    finish = finish - breaks[finish - 1]
    has_word = np.searchsorted(words.start, finish) > np.searchsorted(words.start, begin)
    begin, finish = begin[has_word], finish[has_word]
    up, down = textkit.powers(size + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((words.bytes.astype(np.uint64) + np.uint64(1)) * up[:size])])
    doc = np.searchsorted(words.offsets[1:], begin, side="right")
    hashed = (total[finish] - total[begin]) * down[begin] + (finish - begin).astype(np.uint64)
    key = textkit.mix(textkit.mix(hashed) + doc.astype(np.uint64) * textkit.BASE)
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=words.n_docs) - np.bincount(doc[first], minlength=words.n_docs)


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts and the statistic vector of each text of a string column."""
    parts: dict[str, list[np.ndarray]] = {x: [] for x in [*COUNTS, *VECTOR]}
    for words in textkit.chunks(column, fold=False):
        part, off = words.bytes, words.offsets
        solid = ~textkit.SPACE[part]
        chars = _per_doc(solid & LEADING[part], off)
        symbols = _per_doc(SYMBOLS[part], off)
        n = words.count.astype(np.int64)
        letters, many = chars + PRIOR_CHARS, n + PRIOR_WORDS
        again = (words.hash[1:] == words.hash[:-1]) & (words.local[1:] == words.local[:-1])
        stutter = np.bincount(words.local[1:][again], minlength=words.n_docs)

        def share(flags: np.ndarray, usual: float) -> np.ndarray:
            return (_per_doc(flags[part], off) + usual * PRIOR_CHARS) / letters

        found = {
            "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": _dup_lines(words),
            "n_repeat_words": _repeated(words, 8),
            "v_word_length": np.log((chars + 5.0 * PRIOR_WORDS) / many),
            "v_symbols": np.log(0.01 + share(SYMBOLS, 0.0)),
            "v_upper": np.log(0.03 + share(UPPER, 0.02)),
            "v_digits": np.log(0.10 + share(DIGITS, 0.0)),
            "v_marks": np.log(0.05 + share(MARKS, 0.04)),
            "v_stutter": np.log(0.05 + stutter / many),
        }
        for name, values in found.items():
            parts[name].append(values)
    return {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}


def with_statistics(df: DataFrame) -> DataFrame:
    """``df`` with its text replaced by the counts and the vector of the text."""
    names = [c for c in df.columns if c != "text"]
    at = df.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_statistics(batch.column(at))
            own = [batch.column(i) for i, c in enumerate(batch.schema.names) if i != at]
            counts = [pa.array(found[c].astype(np.int64)) for c in COUNTS]
            vector = [pa.array(np.round(found[c].astype(float), 9)) for c in VECTOR]
            yield pa.RecordBatch.from_arrays([*own, *counts, *vector], names=[*names, *COUNTS, *VECTOR])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"]
    kinds += [f"{c} long" for c in COUNTS] + [f"{c} double" for c in VECTOR]
    return df.mapInArrow(read, ", ".join(kinds))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def chi2_tail(x: float, dof: int) -> float:
    """P(X > x), for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_beyond(tail: float, dof: int) -> float:
    """The value that is exceeded with probability ``tail``."""
    low, high = 0.0, 1400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > tail else (low, mid)
    return high


def grouped(documents: DataFrame, min_group: int) -> DataFrame:
    """``documents`` with ``_group``: language and source, or the pool that a small source belongs to."""
    lang, source = F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))
    counts = documents.groupBy(lang.alias("_lang"), source.alias("_source")).agg(F.count("*").alias("_n"))
    small = F.sum(F.when(F.col("_n") < min_group, F.col("_n")).otherwise(0)).over(Window.partitionBy("_lang"))
    named = F.when(F.col("_n") >= min_group, F.concat_ws("\1", "_lang", "_source"))
    named = named.when(F.col("_pool") >= min_group, F.concat("_lang", F.lit("\1\1"))).otherwise(F.lit("\2"))
    groups = counts.withColumn("_pool", small).select("_lang", "_source", named.alias("_group"))
    groups = broadcast_if_small(groups, 100_000)
    return documents.join(groups, (lang == groups["_lang"]) & (source == groups["_source"])).drop("_lang", "_source")


def _bin(distance: Column) -> Column:
    return F.floor(F.lit(64) * F.log2(F.lit(1) + distance)).cast("int")


def _distance() -> Column:
    diff = [F.col(c) - F.col("_mu")[i] for i, c in enumerate(VECTOR)]
    terms = [diff[i] * diff[j] * F.col("_prec")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _solved(mu: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, precision and log determinant of the regularised covariance, from the first and second moments."""
    cov = second - np.outer(mu, mu) + np.diag(FLOORS**2)
    return mu, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def concentrated(x: np.ndarray, mu: np.ndarray, prec: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One concentration step over rows in memory."""
    diff = x - mu
    near = x[np.argsort(np.einsum("ij,jk,ik->i", diff, prec, diff), kind="stable")[: max(1, math.ceil(share * len(x)))]]
    return _solved(near.mean(axis=0), near.T @ near / len(near))


def first_estimates(x: np.ndarray, share: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The estimates of least determinant after two steps from many small subsets and from the medians."""
    rng = np.random.default_rng(0)
    starts = [(np.median(x, axis=0), np.diag(1 / FLOORS**2))]
    for _ in range(TRIALS):
        few = x[rng.choice(len(x), min(P + 1, len(x)), replace=False)]
        starts.append(_solved(few.mean(axis=0), few.T @ few / len(few))[:2])
    found = {}
    for mu, prec in starts:
        for _ in range(2):
            mu, prec, logdet = concentrated(x, mu, prec, share)
        found.setdefault(round(logdet, 9), (mu, prec, logdet))
    return [found[x] for x in sorted(found)[:KEEP]]


ESTIMATE = "_group string, _start int, _n long, _mu array<double>, _prec array<double>, _logdet double"


def _starts(good: DataFrame, share: float) -> DataFrame:
    rank = Window.partitionBy("_group", "_slice").orderBy("_h", *VECTOR)
    keyed = good.withColumn("_h", F.xxhash64("doc_id", *VECTOR)).withColumn("_slice", F.pmod("_h", F.lit(SLICES)))
    sample = keyed.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= SAMPLE // SLICES)

    def start(rows: pd.DataFrame) -> pd.DataFrame:
        found = first_estimates(rows.sort_values(["_h", *VECTOR])[VECTOR].to_numpy(dtype=float), share)
        return pd.DataFrame({
            "_group": rows["_group"].iloc[0], "_start": range(len(found)), "_n": 0, "_mu": [f[0].tolist() for f in found],
            "_prec": [f[1].ravel().tolist() for f in found], "_logdet": [f[2] for f in found],
        })

    return sample.select("_group", "_h", *VECTOR).groupBy("_group").applyInPandas(start, ESTIMATE)


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean, precision, log determinant and count of the rows of each group and start."""
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(VECTOR)]
    sums += [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q_{i}_{j}") for i in range(P) for j in range(i, P)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            mus, precs, dets = [], [], []
            for r in rows.to_dict("records"):
                second = np.array([[r[f"q_{min(i, j)}_{max(i, j)}"] for j in range(P)] for i in range(P)]) / r["n"]
                mu, prec, logdet = _solved(np.array([r[f"s_{i}"] for i in range(P)]) / r["n"], second)
                mus.append(np.round(mu, 9).tolist())
                precs.append(np.round(prec, 6).ravel().tolist())
                dets.append(round(logdet, 9))
            yield pd.DataFrame({
                "_group": rows["_group"], "_start": rows["_start"], "_n": rows["n"], "_mu": mus, "_prec": precs, "_logdet": dets,
            })

    return rows.groupBy("_group", "_start").agg(F.count("*").alias("n"), *sums).mapInPandas(solve, ESTIMATE)


def _cuts(binned: DataFrame, share: float, name: str) -> DataFrame:
    """Per group and start, the first bin with ``share`` of its rows up to it."""
    counts = binned.groupBy("_group", "_start", "_bin").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_group", "_start")
    upto = F.sum("_c").over(whole.orderBy("_bin")) / F.sum("_c").over(whole)
    reached = counts.withColumn("_upto", upto).where(F.col("_upto") >= share)
    return reached.groupBy("_group", "_start").agg(F.min("_bin").alias(name))


def estimates(good: DataFrame, share: float, steps: int) -> DataFrame:
    """Per group of at least four documents per statistic: ``_group, _mu, _prec, _logdet`` of least determinant."""
    return hinted_estimates(good, share, steps)[0]


def hinted_estimates(good: DataFrame, share: float, steps: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The estimates, and the hint for tables of a row per group and start: broadcast if there are few groups.

    A step is one job, in which the cuts are a branch of the plan; its estimates are stored, so no step is worked out
    twice."""
    large = materialise(good.groupBy("_group").agg(F.count("*").alias("_all")).where(F.col("_all") >= 4 * P).select("_group"), "groups")
    hint = F.broadcast if large.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS else lambda rows: rows
    good = good.join(hint(large), "_group", "left_semi")
    estimate = materialise(_starts(good, share), "mcd0")
    for step in range(1, steps + 1):
        near = good.join(hint(estimate), "_group").withColumn("_bin", _bin(_distance()))
        kept = near.join(hint(_cuts(near, share, "_cut")), ["_group", "_start"]).where("_bin <= _cut")
        estimate = materialise(_estimate(kept), f"mcd{step}")
    best = F.min(F.struct("_logdet", "_start", "_mu", "_prec")).alias("b")
    return estimate.groupBy("_group").agg(best).select("_group", "b.*"), hint


def outlier_distances(vectors: DataFrame, share: float, steps: int) -> DataFrame:
    """``vectors`` with ``_distance``: the scaled squared distance from its group's estimate, null without one."""
    good = vectors.where(~base_failed())
    estimate, hint = hinted_estimates(good, share, steps)
    near = good.join(hint(estimate), "_group").withColumn("_bin", _bin(_distance()))
    scaled = materialise(estimate.join(hint(_cuts(near, 0.5, "_mid").drop("_start")), "_group"), "mcd")
    scale = F.lit(chi2_beyond(0.5, P)) / (F.pow(F.lit(2.0), (F.col("_mid") + 1) / F.lit(64.0)) - 1)
    out = vectors.join(hint(scaled), "_group", "left")
    return out.withColumn("_distance", F.round(_distance() * scale, 6)).drop("_mu", "_prec", "_start", "_logdet", "_mid")


def judge(
    documents: DataFrame, share: float = 0.5, tail: float = 1e-30, steps: int = 4, min_group: int = 100
) -> DataFrame:
    """``documents`` without its text, with the counts, ``base_failed``, ``distance`` and ``kept``."""
    grouped_docs = grouped(documents, min_group)
    vectors = materialise(with_statistics(grouped_docs), "statistics")
    out = outlier_distances(vectors, share, steps)
    cutoff = chi2_beyond(tail, P)
    kept = ~base_failed() & (F.coalesce("_distance", F.lit(0.0)) <= cutoff)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", kept).withColumnRenamed("_distance", "distance")


def quality_digest(documents: DataFrame) -> DataFrame:
    judged = judge(documents.select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def keep_good(documents: DataFrame) -> DataFrame:
    """``documents`` that pass the base rules and are no outliers; the same columns."""
    keyed = documents.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("_key"))
    bad = judge(keyed).where("NOT kept").select(F.col("doc_id").alias("_bad_id"), F.col("_key").alias("_bad_key"))
    bad = broadcast_if_small(materialise(bad.distinct(), "rejected"), 1_000_000)
    same = documents["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(documents["text"]) == bad["_bad_key"])
    return documents.join(bad, same, "left_anti")
