"""Operators over news, annotations and snapshots: matching, dedup, votes, agreement, parity and upserts."""

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from panelspark.functions import text as T
from panelspark.operators import blockpairs
from panelspark.streaming.jobs import work_dir


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def family_split(df: DataFrame, family: str, day: str, train_end: str, validation_end: str) -> DataFrame:
    """Families are placed by their latest date, so none is in two splits."""
    anchor = F.max(day).over(Window.partitionBy(family))
    split = F.when(F.col("anchor") <= F.lit(train_end).cast("date"), "train").when(F.col("anchor") <= F.lit(validation_end).cast("date"), "validation")
    return df.withColumn("anchor", anchor).withColumn("split", split.otherwise("test"))


def split_leakage(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def near_dup_pairs(df: DataFrame, k: int = 5, least: float = 0.7, apart: str | None = None) -> DataFrame:
    """Pairs of different texts with a shingle Jaccard of ``least``, only those with different values of ``apart`` if it is
    given. Partners share ``least`` of either set, hence one of each set's rarest shingles, as many as may be missing and
    one more: only these are joined. All that two sets share up to the earlier end of the two is counted there, so a pair
    goes on only if that count and what stands behind could suffice. The measure is on whole sets."""
    sets = df.withColumn("s", T.shingles(F.col("text"), k)).where(F.size("s") > 0)
    side = F.col(apart) if apart else F.lit(0)
    posts = sets.select("id", side.alias("side"), F.size("s").alias("m"), F.explode(F.transform("s", lambda s: F.xxhash64(s))).alias("g"))
    counts = posts.groupBy("g").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("id").orderBy("n", "g")
    held = posts.join(counts, "g").withColumn("r", F.row_number().over(rarest))
    behind = F.ceil(F.col("m") * least - 1e-9) - 1
    held = held.withColumn("rest", behind).where((F.col("r") <= F.col("m") - behind) & (F.col("n") > 1))
    near = F.least("a.m", "b.m") >= F.greatest("a.m", "b.m") * least - 1e-9
    met = (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id")) & near
    pairs = held.alias("a").join(held.alias("b"), met & (F.col("a.side") != F.col("b.side")) if apart else met)
    pairs = pairs.groupBy(F.col("a.id").alias("left"), F.col("b.id").alias("right")).agg(
        F.count("*").alias("c"), F.first(F.greatest("a.rest", "b.rest")).alias("rest"), F.first(F.col("a.m") + F.col("b.m")).alias("both"))
    pairs = pairs.where((F.col("c") + F.col("rest")) * (1 + least) >= F.col("both") * least - 1e-9).select("left", "right")
    both = pairs.join(sets.select(F.col("id").alias("left"), F.col("s").alias("x")), "left").join(sets.select(F.col("id").alias("right"), F.col("s").alias("y")), "right")
    inter = F.size(F.array_intersect("x", "y"))
    out = both.withColumn("jaccard", inter / (F.size("x") + F.size("y") - inter))
    return out.where((F.col("jaccard") >= least) & (F.col("jaccard") < 1)).select("left", "right", "jaccard")


AUDIT_CHARS, SET_CHARS, RUN = 4000, 2000, 5
MAP_BYTES = 512
NO_LETTERS = re.compile("[^0-9a-z\u3400-\u9fff]+")


def audit_texts(df: DataFrame, text: str, split: str, whole: bool = False) -> DataFrame:
    """A row per distinct normalised text of 20 characters or more: ``id`` (the smallest), ``plain``, ``n_rows``,
    ``splits`` and their bit ``mask``. Unless ``whole``, the text is cut at 4,000 characters."""
    plain = F.trim(F.regexp_replace(T.folded(F.col(text)), r"\s+", " "))
    rows = df.select("id", F.col(split).alias("split"), (plain if whole else F.substring(plain, 1, AUDIT_CHARS)).alias("plain"))
    marks = {name: 1 << k for k, name in enumerate(("train", "validation", "test"))}
    bit = F.coalesce(*(F.when(F.col("split") == n, m) for n, m in marks.items()), F.lit(8))
    return rows.groupBy("plain").agg(
        F.min("id").alias("id"), F.count("*").alias("n_rows"), F.array_sort(F.collect_set("split")).alias("splits"), F.bit_or(bit).alias("mask"),
        F.max(F.length("plain")).alias("chars")).where("chars >= 20").drop("chars")  # a condition on the key would fold the rows twice


def runs_of(plain: str, whole: bool) -> np.ndarray:
    """Hashes of the distinct runs of five characters among the letters and digits, sorted; of the first 2,000 of these,
    unless ``whole``. A shorter text is one run, an empty one has none."""
    step = np.uint64(0x9E3779B97F4A7C15)
    codes = np.frombuffer(NO_LETTERS.sub("", plain)[: None if whole else SET_CHARS].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = max(len(codes) - RUN + 1, min(len(codes), 1))
    out = np.full(n, len(codes) if len(codes) < RUN else RUN, dtype=np.uint64)
    for k in range(min(RUN, len(codes))):
        out = (out ^ codes[k : k + n]) * step
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def map_bytes(level: int, least: float) -> int:
    """The size of the bit maps of a level of set sizes: a power of two, ``MAP_BYTES`` for sets of up to 1,800 runs."""
    return 1 << max(math.ceil((level + 1) * -math.log2(least) + math.log2(MAP_BYTES / 1800) - 0.001), 6)


def run_sets(plain: str, whole: bool, least: float) -> Column:
    """``set_id`` (a hash of the text's runs), their number ``size``, the level ``g`` of that number and ``sig``, a bit map of
    the runs as large as the next level's; the last two null where there are none."""

    @F.pandas_udf("set_id long, size int, g long, sig binary")
    def sets(text: pd.Series) -> pd.DataFrame:
        rows = []
        for found in (runs_of(t, whole) for t in text):
            key = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
            if not len(found):
                rows.append((key, 0, None, None))
                continue
            level = math.floor(math.log(len(found)) / -math.log(least) + 1e-9)
            flags = np.zeros(8 * map_bytes(level + 1, least), dtype=np.uint8)
            flags[found & (len(flags) - 1)] = 1
            rows.append((key, len(found), level, np.packbits(flags).tobytes()))
        return pd.DataFrame(rows, columns=["set_id", "size", "g", "sig"]).astype({"g": "Int64"})

    return sets(plain)


def folded_map(sig: str, level: str, least: float) -> Column:
    """The bit map of the same set in the size of a level."""

    @F.pandas_udf(BinaryType())
    def fold(sig: pd.Series, level: pd.Series) -> pd.Series:
        own = lambda x, g: np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, map_bytes(int(g), least)), axis=0)
        return pd.Series([own(x, g).tobytes() for x, g in zip(sig, level, strict=True)])

    return fold(sig, level)


@F.pandas_udf(BinaryType())
def character_counts(text: pd.Series) -> pd.Series:
    """How often characters fall to each of 64 places, as 16-bit numbers."""
    def counts(t):
        codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        return np.minimum(np.bincount(codes % 64, minlength=64), (1 << 15) - 1).astype(np.int16).tobytes()

    return text.map(counts)


def common_most(a: str, b: str, least: float) -> bool:
    """Whether a common subsequence, which matching blocks are, could make up ``least`` of both. Bits of one number stand
    for the places of ``a``, so a character of ``b`` is a few operations on it."""
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    every = (1 << len(a)) - 1
    row, both = every, len(a) + len(b)
    for k, c in enumerate(b):
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row ^ hit)) & every
        if k % 256 == 255 and 2.0 * (len(a) - row.bit_count() + len(b) - k - 1) / both < least:
            return False
    return 2.0 * (len(a) - row.bit_count()) / both >= least


class Windows:
    """Hashes of a text's windows of any size, from prefix sums."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        up, down = (np.full(len(codes) + 1, x, dtype=np.uint64) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        self.down = np.multiply.accumulate(down)
        mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        self.upto = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mixed * up[:-1], out=self.upto[1:])

    def of(self, low: int, high: int, size: int) -> np.ndarray:
        return (self.upto[low + size : high + 1] - self.upto[low : high + 1 - size]) * self.down[low : high + 1 - size]


SMALL = 1024  # a rectangle of so many cells is left to difflib
UNSURE = 32  # so many rectangles are taken before the common subsequence is asked whether the rest is worth it
WIDE, MOST_EQUAL = 16, 16  # common runs of so many characters are found at once, where a window has few equal ones


def wide_matches(x: Windows, y: Windows, n: int, m: int) -> np.ndarray | None:
    """Start, other start and size of all longest-possible common runs of ``WIDE`` characters or more, as rows of one
    array; None where texts repeat themselves so often that these are too many to be listed."""
    if min(n, m) < WIDE:
        return np.zeros((3, 0), np.int64)
    own, other = x.of(0, n, WIDE), y.of(0, m, WIDE)
    by_own, by_other = np.argsort(own), np.argsort(other)
    own, other = own[by_own], other[by_other]
    low, high = np.searchsorted(other, own), np.searchsorted(other, own, "right")
    times = high - low
    total = int(times.sum())
    if total > MOST_EQUAL * (n + m):
        return None
    i = np.repeat(by_own, times)
    j = by_other[np.arange(total) + np.repeat(low - np.cumsum(times) + times, times)]
    spots = np.sort(((i - j + m) << 32) | i)  # one diagonal after the other
    fresh = np.flatnonzero(np.diff(spots, prepend=-2) != 1)
    start = spots[fresh] & 0xFFFFFFFF
    return np.stack([start, start - (spots[fresh] >> 32) + m, np.diff(fresh, append=total) + WIDE - 1])


def longest_match(x: Windows, y: Windows, low: int, high: int, first: int, last: int, most: int) -> tuple[int, int, int]:
    """Start, other start and size of the longest common run of two ranges, which is of ``most`` characters at most; the
    earliest of those, as difflib finds it."""
    best, least, most = (low, first, 0), 1, min(high - low, last - first, most)
    while least <= most:
        size = (least + most) // 2
        own, other = x.of(low, high, size), y.of(first, last, size)
        ordered = np.sort(other)
        hit = ordered[np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)] == own
        i = int(hit.argmax())
        if hit[i]:
            best, least = (low + i, first + int((other == own[i]).argmax()), size), size + 1
        else:
            most = size - 1
    return best


def matching_ratio(a: str, b: str, least: float) -> float | None:
    """difflib's ratio without junk, or None if it is below ``least``: the same blocks, found by hashes of windows in
    place of all pairs of equal characters. Long common runs are found once; those of a rectangle are what it holds of
    them. What equal hashes found is compared."""
    both = len(a) + len(b)
    if not both:
        return 1.0
    if 2.0 * min(len(a), len(b)) / both < least:
        return None
    x, y = Windows(a), Windows(b)
    wide = wide_matches(x, y, len(a), len(b))
    todo, matched, open_, taken = [(0, len(a), 0, len(b), wide)], 0, min(len(a), len(b)), 0
    while todo:
        low, high, first, last, wide = todo.pop()
        taken += 1
        if taken == UNSURE and 2.0 * matched / both < least and not common_most(a, b, least):
            return None
        open_ -= min(high - low, last - first)
        if small := (high - low) * (last - first) <= SMALL:
            i, j, n = 0, 0, 0
        else:
            n, most = 0, high - low
            if wide is not None:
                start = np.maximum(np.maximum(low - wide[0], first - wide[1]), 0)
                size = np.minimum(np.minimum(high - wide[0], last - wide[1]), wide[2]) - start
                n, most = int(size.max(initial=0)), WIDE - 1
            if n >= WIDE:
                i, j = min((int(wide[0, k] + start[k]), int(wide[1, k] + start[k])) for k in np.flatnonzero(size == n).tolist())
                wide = wide[:, size >= WIDE]
            else:
                i, j, n = longest_match(x, y, low, high, first, last, most)
                wide = None if wide is None else wide[:, :0]
        if small or a[i : i + n] != b[j : j + n]:
            matched += sum(m.size for m in SequenceMatcher(None, a[low:high], b[first:last], autojunk=False).get_matching_blocks())
        elif n:
            matched += n
            for part in ((low, i, first, j), (i + n, high, j + n, last)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append((*part, wide))
                    open_ += min(part[1] - part[0], part[3] - part[2])
        if 2.0 * (matched + open_) / both < least:
            return None
    return 2.0 * matched / both


@F.pandas_udf(DoubleType())
def block_ratio(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio of matching blocks, no character set aside for being frequent; null where it is below ``least``."""
    return pd.Series([matching_ratio(a, b, x) for a, b, x in zip(left, right, least, strict=True)], dtype=float)


def cross_split_pairs(df: DataFrame, least: float = 0.7, text: str = "text", split: str = "split", whole: bool = False, ratio: float | None = None) -> DataFrame:
    """Pairs of different texts in different splits whose runs of five characters have a Jaccard index of ``least``:
    ``left, right`` (the smallest ids of the two texts), ``jaccard``, ``a`` and ``b`` (the texts' rows). Equal texts are
    one text with its splits, and texts of equal runs are one point with its members, so copies make no pairs of points.
    With a ``ratio``, only pairs whose texts' matching blocks make it up, and it is told as ``similarity``.

    The rows outside the first split are the stated query set, compared with all rows: groups are classes of set size, of
    which near sets lie in one or in two adjacent ones."""
    spark = df.sparkSession
    path = work_dir(spark, "near")
    marked = audit_texts(df, text, split, whole).withColumn("s", run_sets("plain", whole, least)).select("*", "s.*").drop("s")
    marked = blockpairs.stored(marked, f"{path}/texts")  # many steps read them
    points = marked.groupBy("set_id").agg(F.min("id").alias("id"), F.bit_or("mask").alias("mask"), F.first("size").alias("size"), F.first("g").alias("g"), F.first("sig").alias("sig"))
    points = blockpairs.stored(points, f"{path}/points")
    held = points.where("g IS NOT NULL")  # a text without runs meets nothing
    fit = lambda p: p.withColumn("sig", folded_map("sig", "g", least))
    asked = held.where("mask != 1").withColumn("g", F.explode(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1)))
    near = blockpairs.product_pairs(fit(asked), fit(held), blockpairs.bitmap_near(least), path)
    near = near.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    near = blockpairs.stored(near, f"{path}/pairs")  # the product of blocks is worked out once
    sets = points.select("id", "set_id")
    of = lambda side: sets.select(F.col("id").alias(side), F.col("set_id").alias(f"{side}_set"))
    met = near.join(of("left"), "left").join(of("right"), "right").select("left_set", "right_set")
    own = marked.groupBy("set_id").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n > 1 AND size > 0").select(F.col("set_id").alias("left_set"), F.col("set_id").alias("right_set"))
    met = met.unionByName(own)
    wanted = met.select(F.explode(F.array("left_set", "right_set")).alias("set_id")).distinct()
    held = marked.select("set_id", "id", "plain", "splits", "mask").join(wanted, "set_id", "left_semi")
    member = lambda side: held.select(F.col("set_id").alias(f"{side}_set"), F.struct("id", "plain", "splits", "mask").alias(side))
    pairs = met.join(member("left"), "left_set").join(member("right"), "right_set")
    one_split = (F.col("left.mask") == F.col("right.mask")) & (F.bit_count("left.mask") == 1)
    pairs = pairs.where(~one_split & ((F.col("left_set") != F.col("right_set")) | (F.col("left.id") < F.col("right.id"))))
    swap = F.col("left.id") > F.col("right.id")
    slim = lambda c: F.struct(f"{c}.id", f"{c}.plain", f"{c}.splits")
    first, second = F.when(swap, slim("right")).otherwise(slim("left")), F.when(swap, slim("left")).otherwise(slim("right"))
    pairs = pairs.select(first.alias("a"), second.alias("b"))
    # comparing takes long, so pairs are dealt evenly, however few bytes they are or texts they hold
    parts = max(8 * spark.sparkContext.defaultParallelism, near.count() // 4096 + 1)
    told = measured(pairs.repartition(parts, "a.id", "b.id"), least, ratio, whole)
    return told.select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), "jaccard", "a", "b", *(["similarity"] if ratio is not None else []))


def measured(pairs: DataFrame, least: float, ratio: float | None, whole: bool) -> DataFrame:
    """``a, b, jaccard, similarity`` of the pairs whose texts' runs have a Jaccard index of ``least`` and, with a ``ratio``,
    whose matching blocks make it up. A filter on a column of a Python function would work it out twice."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple[int, float, float | None]] = []
            a, b = (batch.column(c).field("plain") for c in ("a", "b"))
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = x.as_py(), y.as_py()
                one, two = runs_of(x, whole), runs_of(y, whole)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                jaccard = shared / (len(one) + len(two) - shared)
                if jaccard < least:
                    continue
                similarity = None if ratio is None else matching_ratio(x, y, ratio)
                if ratio is None or similarity is not None:
                    kept.append((k, jaccard, similarity))
            rows = batch.select(["a", "b"]).take(pa.array([k for k, _, _ in kept], pa.int64()))
            values = [pa.array([k[i] for k in kept], pa.float64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *values], names=["a", "b", "jaccard", "similarity"])

    kind = StructType([*pairs.select("a", "b").schema.fields, StructField("jaccard", DoubleType()), StructField("similarity", DoubleType())])
    return pairs.mapInArrow(measure, kind)


def audit_pairs(df: DataFrame, ratio: float = 0.92, text: str = "text", split: str = "split") -> DataFrame:
    """The near pairs of whole texts whose matching blocks make up ``ratio`` of both: ``left, right, jaccard,
    similarity``, the splits and the texts' hashes."""
    pairs = cross_split_pairs(df, 0.7, text, split, True, ratio)
    return pairs.select("left", "right", "jaccard", F.round("similarity", 6).alias("similarity"), F.col("a.splits").alias("left_splits"),
                        F.col("b.splits").alias("right_splits"), F.sha2("a.plain", 256).alias("left_sha256"), F.sha2("b.plain", 256).alias("right_sha256"))


def title_links(news: DataFrame, days: int = 2, least: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """``classes`` (``class, day, plain, n, ids``: one per day and normalised title; ``class`` is its smallest id) and
    ``links`` (``a, b, ratio``: classes of at most ``days`` days apart whose titles' matching blocks make up ``least``, each
    once, equal titles of different days included). Titles without a letter or digit link with nothing.

    Titles are compared in blocks by counts of characters first; only those within the bound reach the matcher. A day's
    work is the product of its distinct titles and those of the days around it."""
    rows = news.select("id", T.norm_title(F.col("title")).alias("plain"), F.unix_date(F.to_date("published_at")).cast("long").alias("day"))
    classes = rows.where("plain <> '' AND day IS NOT NULL").groupBy("day", "plain").agg(
        F.min("id").alias("class"), F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    point = classes.select(F.col("class").alias("id"), F.length("plain").alias("size"), F.lit(0).alias("mask"), character_counts("plain").alias("sig"), "day")
    near = [blockpairs.near_pairs(point.withColumn("g", F.col("day")), point.withColumn("g", F.col("day")), blockpairs.counts_near(least), True)]
    if days:
        later = point.withColumn("g", F.explode(F.array(*(F.col("day") + k for k in range(1, days + 1)))))
        near.append(blockpairs.near_pairs(later, point.withColumn("g", F.col("day")), blockpairs.counts_near(least), False))
    pairs = reduce(DataFrame.unionByName, near).select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))
    of = lambda side, name: classes.select(F.col("class").alias(side), F.col("plain").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    ratio = F.when(F.col("x") == F.col("y"), 1.0).otherwise(block_ratio("x", "y", F.lit(least)))
    return classes, both.withColumn("ratio", ratio).where(F.col("ratio") >= least).select("a", "b", F.round("ratio", 6).alias("ratio"))


def fuzzy_dups(news: DataFrame, days: int = 2, least: float = 0.92) -> DataFrame:
    """Items whose title resembles that of an item with a smaller id within some days: ``id, duplicate_of`` (the smallest
    such id), ``class`` and ``n_links`` (classes that its own links with)."""
    classes, links = title_links(news, days, least)
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = ways.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("other"), F.count("*").alias("n_links"))
    rows = classes.join(best, "class", "left").select("class", "other", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.explode("ids").alias("id"))
    first = F.least("class", F.coalesce("other", F.col("class")))
    return rows.withColumn("duplicate_of", first).where(F.col("duplicate_of") < F.col("id")).select("id", "duplicate_of", "class", "n_links")


def match_keys(fields: list[str], k: int) -> Column:
    """The words of the fields and their runs of ``k`` characters, marked by kind."""
    marked = lambda mark, found: F.transform(F.array_distinct(found), lambda w: F.concat(F.lit(mark), w))
    text = F.concat_ws("\n", *fields)
    return F.concat(marked("t", F.split(text, "[^A-Za-z0-9]+")), marked("a", T.runs(text, k)))


def match_entities(news: DataFrame, aliases: DataFrame, explicit: str | None = None, most_broadcast: int = 100_000) -> DataFrame:
    """Best tier per item and ticker: named by the item's own array column ``explicit`` 1.0, ticker in title .95, alias in
    title .90, ticker in summary .75, alias in summary .65. Texts meet ``aliases`` (ticker, alias) by equal keys only: a
    ticker by its first word, an alias by its first characters, as many as the shortest alias has; both are then looked up
    in the text. Tickers hold a letter or digit and aliases a character, else they match nothing."""
    known = aliases.where("length(alias) > 0 AND ticker IS NOT NULL")
    size = known.agg(F.min(F.length("alias")), F.count("*")).first()
    k = size[0] or 1
    sides = F.array(F.concat(F.lit("t"), F.regexp_extract("ticker", "[A-Za-z0-9]+", 0)), F.concat(F.lit("a"), F.substring("alias", 1, k)))
    keyed = known.select("ticker", "alias", F.explode(sides).alias("key")).where("length(key) > 1")
    if size[1] <= most_broadcast:
        keyed = F.broadcast(keyed)
    met = news.select("id", F.explode(match_keys(["title", "summary"], k)).alias("key")).join(keyed, "key").select("id", "ticker", "alias").distinct()
    tiers = [(0.95, "ticker_title", T.mentions(F.col("title"), F.col("ticker"))), (0.90, "alias_title", F.contains("title", "alias")),
             (0.75, "ticker_summary", T.mentions(F.col("summary"), F.col("ticker"))), (0.65, "alias_summary", F.contains("summary", "alias"))]
    method = reduce(lambda c, t: c.when(t[2], F.struct(F.lit(t[0]).alias("score"), F.lit(t[1]).alias("method"))), tiers[1:],
                    F.when(tiers[0][2], F.struct(F.lit(tiers[0][0]).alias("score"), F.lit(tiers[0][1]).alias("method"))))
    joined = news.select("id", "title", "summary").join(met, "id").withColumn("m", method).where("m IS NOT NULL").select("id", "ticker", "m")
    if explicit:
        named = news.select("id", F.explode(explicit).alias("ticker")).join(known.select("ticker").distinct(), "ticker", "left_semi")
        joined = joined.unionByName(named.withColumn("m", F.struct(F.lit(1.0).alias("score"), F.lit("explicit").alias("method"))))
    return joined.groupBy("id", "ticker").agg(F.max("m").alias("m")).select("id", "ticker", "m.score", "m.method")


def upsert_bars(existing: DataFrame, incoming: DataFrame, adj_tolerance: float = 0.005, close_tolerance: float = 1e-6) -> DataFrame:
    """Stored rows take the incoming values, but keep their adjusted close where only rounding moved it."""
    e, i = existing.alias("e"), incoming.alias("i")
    both = e.join(i, (F.col("e.ticker") == F.col("i.ticker")) & (F.col("e.session") == F.col("i.session")), "full_outer")
    jitter = (F.abs(F.col("e.adj") - F.col("i.adj")) <= adj_tolerance) & (F.abs(F.col("e.close") - F.col("i.close")) <= close_tolerance)
    pick = lambda c: F.coalesce(f"i.{c}", f"e.{c}").alias(c)
    change = F.when(F.col("e.ticker").isNull(), "insert").when(F.col("i.ticker").isNull(), "keep").otherwise("update")
    return both.select(pick("ticker"), pick("session"), pick("close"), pick("volume"),
                       F.when(jitter, F.col("e.adj")).otherwise(F.coalesce("i.adj", "e.adj")).alias("adj"), change.alias("change"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    joined = old.withColumnRenamed(value, "_old").join(new.withColumnRenamed(value, "_new"), keys, "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "updated")
    return joined.select(*keys, F.col("_old").alias("old"), F.col("_new").alias("new"), kind.alias("kind")).where("kind IS NOT NULL")


def compare_panels(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per field: rows in both, equal ones, largest and median absolute difference, and rows on one side only."""
    x = a.select(*keys, *(F.col(f).cast("double").alias(f"a_{f}") for f in fields), F.lit(1).alias("_a"))
    y = b.select(*keys, *(F.col(f).cast("double").alias(f"b_{f}") for f in fields), F.lit(1).alias("_b"))
    both = x.join(y, keys, "full_outer")
    made = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("u"), F.col(f"b_{f}").alias("v")) for f in fields))
    rows = both.select("_a", "_b", F.explode(made).alias("c")).select("_a", "_b", "c.*")
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    gap = F.when(paired, F.abs(F.col("u") - F.col("v")))
    return rows.groupBy("field").agg(
        F.count_if(paired).alias("n_both"), F.count_if(paired & (F.col("u") == F.col("v"))).alias("n_exact"), F.max(gap).alias("max_diff"),
        F.percentile(gap, F.lit(0.5)).alias("median_diff"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
    )


def pair_reviews(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both reviewers' labels by candidate; ``status`` tells candidates that one of them has not seen."""
    joined = a.select("candidate_id", F.col("label").alias("label_a")).join(b.select("candidate_id", F.col("label").alias("label_b")), "candidate_id", "full_outer")
    status = F.when(F.col("label_a").isNull(), "missing_a").when(F.col("label_b").isNull(), "missing_b")
    return joined.withColumn("status", status.when(F.col("label_a") == F.col("label_b"), "agree").otherwise("conflict"))


def valid_vote(df: DataFrame) -> DataFrame:
    """Adds ``valid``: a signal has confidence, its absence a reason and none; at most one vote per function and input."""
    signal = F.col("impact").isNotNull() | F.col("event_type").isNotNull()
    once = F.count("*").over(Window.partitionBy("input_id", "function_id")) == 1
    rule = F.when(signal, (F.col("confidence") > 0) & F.col("reason").isNull()).otherwise((F.col("confidence") == 0) & F.col("reason").isNotNull())
    return df.withColumn("valid", rule & once)


def aggregate_votes(votes: DataFrame, weights: DataFrame, min_sources: int = 2, min_margin: float = 0.2) -> DataFrame:
    """Per input: the impact with the largest weight x confidence, its margin over the next, agreement and normalised
    entropy. Too few sources abstain; a small margin is AMBIGUOUS."""
    rows = votes.join(F.broadcast(weights), "function_id").withColumn("score", F.col("weight") * F.col("confidence"))
    totals = rows.groupBy("input_id").agg(F.count("*").alias("n_votes"), F.count("impact").alias("n_signals"))
    sums = rows.where("impact IS NOT NULL").groupBy("input_id", "impact").agg(F.sum("score").alias("score"), F.count("*").alias("c"))
    per = sums.groupBy("input_id").agg(F.sort_array(F.collect_list(F.struct("score", "impact", "c")), False).alias("s"))
    scores = F.transform("s", lambda x: x["score"])
    whole = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    out = totals.join(per, "input_id", "left").withColumns({
        "top": F.col("s")[0]["score"] / whole, "next": F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0)) / whole,
        "agreement": F.get("s", F.lit(0))["c"] / F.col("n_signals"), "entropy": T.norm_entropy(scores),
    })
    few = F.coalesce(F.col("n_signals") < min_sources, F.lit(True))
    split = F.col("top") - F.col("next") < min_margin
    label = F.when(few, None).when(split, "AMBIGUOUS").otherwise(F.col("s")[0]["impact"])
    reason = F.when(few, "INSUFFICIENT_INDEPENDENT_SOURCES").when(split, "VOTE_CONFLICT")
    return out.select("input_id", "n_votes", "n_signals", label.alias("label"), reason.alias("reason"), "agreement", "entropy",
                      (F.col("n_signals") / F.col("n_votes")).alias("coverage"))


def pending_pairs(links: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return links.join(results.select(*keys), keys, "left_anti")


@dataclass(frozen=True)
class LexiconScorer:
    """The lexicon of ``functions.text.lexicon_sentiment`` as a batch scorer: calling it makes the function on lists of texts."""

    positive: tuple[str, ...] = T.POSITIVE_TERMS
    negative: tuple[str, ...] = T.NEGATIVE_TERMS
    negations: tuple[str, ...] = T.NEGATIONS
    version: str = "lexicon-1"
    prefixes: tuple[str, ...] = ()

    def __call__(self):
        def weight(text: str, terms: tuple[str, ...]) -> int:
            total = 0
            for t in terms:
                at = text.find(t)
                while at >= 0:
                    total += -1 if text.endswith(self.negations, 0, at) else 1
                    at = text.find(t, at + len(t))
            return total

        def one(text: str) -> tuple[float, float, float]:
            up, down = weight(text, self.positive), weight(text, self.negative)
            middle = up + 1 if up == down else 0
            top = max(up, middle, down)
            parts = [math.exp(v - top) for v in (up, middle, down)]
            return tuple(v / sum(parts) for v in parts)

        return lambda texts: [one(t) for t in texts]


SCORED_AT_ONCE = 256


def score_texts(df: DataFrame, scorer, column: str = "text") -> DataFrame:
    """``df`` with ``model_version, pos, neu, neg`` of a batch scorer: a callable that makes a function from a list of texts
    to a list of triples, made once per Python worker. A scorer may name its ``version`` and the language ``prefixes``
    that it reads (rows of other languages go). It gets a few hundred texts at a time, so a worker holds no more of them
    as Python strings. Null texts are scored as empty ones. There must be one triple a text, its
    parts finite, not negative and with sum one."""
    prefixes, version = getattr(scorer, "prefixes", ()), getattr(scorer, "version", None)
    rows = df.where(T.supports_language(F.col("lang"), prefixes)) if prefixes else df
    rows = rows.withColumn("model_version", F.lit(version).cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "pos double", "neu double", "neg double"])

    def read(batches):
        predict = scorer()
        for whole in batches:
            for first in range(0, len(whole), SCORED_AT_ONCE):
                batch = whole.slice(first, SCORED_AT_ONCE)
                found = predict([t if isinstance(t, str) else "" for t in batch.column(column).to_pylist()])
                if len(found) != len(batch):
                    raise ValueError("a scorer must give one triple for each text")
                if any(not all(math.isfinite(v) and v >= 0 for v in x) or abs(sum(x) - 1) > 1e-6 for x in found):
                    raise ValueError("probabilities must be finite and sum to one")
                parts = [pa.array([float(x[i]) for x in found], pa.float64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *parts], names=[*batch.schema.names, "pos", "neu", "neg"])

    return rows.mapInArrow(read, schema)


def score_once(articles: DataFrame, links: DataFrame, done: DataFrame, prefixes: tuple[str, ...], score: Column) -> DataFrame:
    """Pending (article, ticker) pairs with the score of their article; each article is scored once."""
    pending = pending_pairs(links, done, ["article_id", "ticker"])
    wanted = articles.join(pending.select("article_id").distinct(), "article_id", "left_semi").where(T.supports_language(F.col("lang"), prefixes))
    return pending.join(wanted.select("article_id", score.alias("s")), "article_id").select("article_id", "ticker", "s.*")


def text_audit(df: DataFrame) -> DataFrame:
    """Per split: rows, texts without words, rows whose text another split has, and length statistics."""
    key = F.sha2(T.norm_line(F.coalesce("text", F.lit(""))), 256)
    rows = df.withColumns({"_k": key, "_n": F.length(F.coalesce("text", F.lit("")))})
    spread = rows.groupBy("_k").agg(F.count_distinct("split").alias("_s"), F.count("*").alias("_c"))
    joined = rows.join(spread, "_k")
    return joined.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("_n") == 0).alias("empty"), F.count_if(F.col("_s") > 1).alias("cross_split"),
        F.count_if(F.col("_c") > 1).alias("repeated"), F.min("_n").alias("min_length"), F.percentile("_n", F.lit(0.5)).alias("median_length"),
        F.max("_n").alias("max_length"), F.avg("_n").alias("mean_length"),
    )


def feed_coverage(df: DataFrame) -> DataFrame:
    """Per source: rows, languages, repeated titles, and the 10th and 90th length by rounded rank."""
    upto = F.sum("c").over(Window.partitionBy("source").orderBy("size"))
    sizes = df.groupBy("source", F.length("text").alias("size")).agg(F.count("*").alias("c"))
    sizes = sizes.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy("source"))})
    at = lambda q: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * q), F.col("size")))
    spread = sizes.groupBy("source").agg(F.first("n").alias("n"), at(0.1).alias("p10"), at(0.9).alias("p90"))
    titles = df.groupBy("source", "title").agg(F.count("*").alias("c")).groupBy("source").agg(
        F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("repeated_titles"))
    languages = df.groupBy("source").agg(F.count_distinct("lang").alias("languages"))
    return spread.join(titles, "source").join(languages, "source").select("source", "n", "languages", "repeated_titles", "p10", "p90")


def record_audit(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: missing values, repeated ones, and values that several sources share."""
    made = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))
    rows = df.select("source", F.explode(made).alias("c")).select("source", "c.*")
    counted = rows.groupBy("field", "v").agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"))
    missing = F.col("v").isNull() | (F.trim("v") == "")
    return counted.groupBy("field").agg(
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("missing"), F.count_if(~missing & (F.col("n") > 1)).alias("repeated_values"),
        F.coalesce(F.sum(F.when(~missing & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("extra_rows"),
        F.count_if(~missing & (F.col("s") > 1)).alias("cross_source"),
    )


def recent(df: DataFrame, n: int) -> DataFrame:
    """The latest n items of every source."""
    last = Window.partitionBy("source").orderBy(F.desc("published_at"), F.desc("id"))
    return df.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by the hash of their key."""
    return df.withColumn("h", F.sha2(F.col(key).cast("string"), 256)).orderBy("h", key).limit(n)
