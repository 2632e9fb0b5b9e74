"""Exact Jaccard join of word-shingle sets in the metric space (sets, 1 - Jaccard), for thresholds like 0.8.

Copies of one set are one point. Then:

1. **Voronoi regions.** A region is made by a pivot: for each of a point's first few shingles in hash order, some
   points that hold this shingle are its pivots. Each point is compared with the pivots it is near to; points within
   the threshold of a pivot join its region. This finds nearly all links at a linear number of comparisons.
2. **Windows.** A partner of a point may lie in another region. By the triangle inequality (for the distance of
   symmetric differences, to the empty set and to each single shingle) it must have a size in a window and share one
   of the point's ``n - o + 1`` first shingles, so each point is replicated to those boundary regions and no others.
   Widely held shingles come last in the order, so that boundaries avoid crowded regions.
3. **Recursion.** Crowded regions are divided again: partners share several boundary shingles, so each point leaves its
   most crowded ones and still meets every partner in a rarer one. What stays larger than ``BLOCK`` points is cut into
   blocks that meet in pairs, each in its own task. Regions of one component are done; in the others
   all pairs of different components that pass exact bounds are verified on the whole sets.

Document pivots alone do not divide such data: almost every pair of unrelated texts is at distance 1, so all points
lie on every boundary. Hence the single shingles as pivots of step 2.

Defined cases: null and empty texts have the empty set, which links with nothing; a text of fewer than ``k`` words is
one shingle; rows that repeat a doc_id are one point with all their sets; a null doc_id is its own document; an
empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm import textkit
from panelspark.llm.components import connected_components
from panelspark.llm.decontaminate import broadcast_if_small
from panelspark.llm.store import materialise

NULL_ID = -(1 << 63)
LOCAL_SEEN = 8
HOT_DOCS = 64
MOST_HOT = 1 << 21
MOST_IDS = 1_000_000  # so many ids are broadcast at most, 8 MB; beyond, Spark shuffles the texts instead
SKETCH = 16
SLICES = 64
BLOCK = 8192  # points of one region that meet in one task; larger regions are cut into blocks, of which each pair is a task's


def document_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text of a string column."""
    for part in textkit.chunks(column, fold=True):
        wins = part.windows(k)
        for d in range(part.n_docs):
            first, n = int(part.upto[d]), int(part.count[d])
            if n >= k:
                yield np.unique(wins[first : first + n - k + 1])
            elif n:
                mixed = textkit.mix(np.cumsum(part.hash[first : first + n] * np.uint64(0x9E3779B97F4A7C15))[-1:])
                yield mixed + np.uint64(n)
            else:
                yield np.zeros(0, dtype=np.uint64)


def overlap_needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """Shared shingles that a longer boundary must hold: lets most false candidates fail an exact count."""
    return 2 + n // 20


def boundary(shingles: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, bool, int, bytes]:
    """The first shingles of a set, widely held ones last, of which partners share ``extra`` at least; whether all that
    are not widely held are among them, how many those are, and how many widely held ones lie in each slice of the
    hash range: distances to ``SLICES`` further pivots, which bound what two sets can share."""
    n = len(shingles)
    need, plain, slices = overlap_needed(n, percent), n, np.zeros(SLICES, np.int64)
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        common = hot[at] == shingles
        slices = np.bincount((shingles[common] >> np.uint64(58)).astype(np.int64), minlength=SLICES)
        shingles, plain = np.concatenate([shingles[~common], shingles[common]]), n - int(common.sum())
    out = shingles[: min(n, n - need + min(extra(n), need))]
    return out, plain <= len(out), plain, slices.astype(np.int32).tobytes()


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _offsets(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    upto = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    return pa.array(upto), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64))


def survey(documents: DataFrame, k: int) -> DataFrame:
    """Per document ``doc_id, n, s1, s2`` (a 128-bit digest of the set), and besides rows ``token, seen`` for
    shingles that a batch holds in ``LOCAL_SEEN`` documents or more. ``kind`` tells them apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = list(document_sets(batch.column(1), k))
            n = np.array([len(x) for x in sets], dtype=np.int64)
            s1 = np.array([x.sum(dtype=np.uint64) for x in sets], dtype=np.uint64).view(np.int64)
            s2 = np.array([textkit.mix(x + textkit.STEP).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
            zero = np.zeros(len(n), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (zero, _ids(batch.column(0)), n, s1, s2)], names=["kind", "doc_id", "n", "s1", "s2"]
            )
            flat = np.sort(np.concatenate(sets))
            edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]])) if len(flat) else np.zeros(1, int)
            seen = np.diff(edge)
            many = seen >= LOCAL_SEEN
            token, seen = flat[edge[:-1][many]].view(np.int64), seen[many].astype(np.int64)
            zero = np.zeros(len(token), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (zero + 1, token, seen, zero, zero)], names=["kind", "doc_id", "n", "s1", "s2"]
            )

    return documents.select("doc_id", "text").mapInArrow(read, "kind long, doc_id long, n long, s1 long, s2 long")


def widely_held(seen: DataFrame, total: int) -> np.ndarray:
    """Shingles to put last. At most ``MOST_HOT``: no more can be held by ``total / MOST_HOT`` documents each. The list
    only sets an order; results do not depend on it."""
    least = max(HOT_DOCS, total // MOST_HOT)
    rows = seen.groupBy(F.col("doc_id").alias("token")).agg(F.sum("n").alias("seen")).where(F.col("seen") >= least)
    return np.sort(rows.select("token").toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))


def boundaries(documents: DataFrame, hot: np.ndarray, k: int, percent: int) -> DataFrame:
    """``doc_id, n, first`` (the ``SKETCH`` smallest shingles) and ``bound`` and ``full`` (the boundary, in order)."""
    held = documents.sparkSession.sparkContext.broadcast(hot)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = list(document_sets(batch.column(1), k))
            bounds = [boundary(x, held.value, percent) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_ids(batch.column(0))),
                    pa.array(np.array([len(x) for x in sets], dtype=np.int64)),
                    pa.ListArray.from_arrays(*_offsets([x[:SKETCH] for x in sets])),
                    pa.ListArray.from_arrays(*_offsets([x[0] for x in bounds])),
                    pa.array([x[1] for x in bounds], pa.bool_()),
                    pa.array([x[2] for x in bounds], pa.int64()),
                    pa.array([x[3] for x in bounds], pa.binary()),
                ],
                names=["doc_id", "n", "first", "bound", "full", "plain", "slices"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        read, "doc_id long, n long, first array<bigint>, bound array<bigint>, full boolean, plain long, slices binary"
    )


def whole_sets(documents: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``doc_id, shingles`` of the documents in ``ids`` only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(document_sets(batch.column(1), k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ids(batch.column(0))), pa.ListArray.from_arrays(*_offsets(sets))], names=["doc_id", "shingles"]
            )

    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    wanted = docs.join(broadcast_if_small(ids, MOST_IDS), docs["doc_id"] == ids["id"], "left_semi")
    return wanted.mapInArrow(read, "doc_id long, shingles array<bigint>").dropDuplicates(["doc_id", "shingles"])


def verified(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are near enough."""
    pairs = materialise(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialise(whole_sets(documents, ids, k), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("t"))
    return sized.where((F.col("i") > 0) & (F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("t") - F.col("i")))).select(
        "a", "b"
    ).distinct()


def pivot_pairs(points: DataFrame, tokens: int, pivots: int) -> DataFrame:
    """Pairs (point, pivot): the pivots of a shingle, among the points that have it among their first ``tokens``, are
    the one with the fewest shingles of its own (the middle of a group of copies), the smallest, and the first ones in
    some hash orders. Pairs whose sketches agree in less than half are left to the boundaries."""
    held = points.select("doc_id", "plain", F.explode(F.slice("first", 1, tokens)).alias("token"))
    ranks = [F.col("plain"), F.col("doc_id"), *(F.xxhash64(F.lit(i), "doc_id") for i in range(2, pivots))]
    orders = [F.min(F.struct(rank.alias("rank"), "doc_id")).alias(f"p{i}") for i, rank in enumerate(ranks)]
    by_token = held.groupBy("token").agg(F.count("*").alias("held"), *orders).where("held > 1")
    by_token = by_token.select("token", F.array_distinct(F.array(*(F.col(f"p{i}.doc_id") for i in range(pivots)))).alias("ps"))
    pairs = held.join(by_token, "token").select("doc_id", F.explode("ps").alias("p")).where("doc_id <> p")
    pairs = pairs.select(F.greatest("doc_id", "p").alias("a"), F.least("doc_id", "p").alias("b")).distinct()
    x = points.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("first").alias("x"))
    y = points.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("first").alias("y"))
    near = pairs.join(x, "a").join(y, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    shared = F.size(F.array_intersect("x", "y"))
    return near.where(F.lit(2) * shared >= F.least(F.size("x"), F.size("y"))).select("a", "b")


def _meet(percent: int):
    """Over rows (token, doc_id, part, n, rest, full, plain, slices, side) sorted by token: pairs of one token from different
    components, and from different sides unless that is -1, that can reach the threshold by their sizes and by what of
    each the other can hold at all."""

    def pairs_of(ids, parts, ns, rest, full, plain, slices, side) -> tuple[np.ndarray, np.ndarray]:
        own, table = rest - (ns - plain), None  # own: shingles that are not widely held and may be shared
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(ids), 512):
            for j in range(0, i + 1, 512):
                a, b = slice(i, i + 512), slice(j, j + 512)
                both = full[a][:, None] & full[b][None, :]
                most = np.where(both, np.minimum(rest[a][:, None], rest[b][None, :]), np.minimum(ns[a][:, None], ns[b][None, :]))
                ok = (parts[a][:, None] != parts[b][None, :]) & (ids[a][:, None] != ids[b][None, :])
                ok &= (side[a][:, None] != side[b][None, :]) | (side[a][:, None] < 0)
                ok &= (100 + percent) * most >= percent * (ns[a][:, None] + ns[b][None, :])
                if i == j:
                    ok &= np.tri(len(ids[a]), k=-1, dtype=bool)
                p, q = np.nonzero(ok)
                p, q = p + i, q + j
                if len(p):
                    if table is None:
                        table = np.frombuffer(b"".join(slices.tolist()), dtype=np.int32).reshape(-1, SLICES)
                    wide = np.minimum(table[p], table[q]).sum(axis=1)
                    few = np.where(full[p] & full[q], np.minimum(own[p], own[q]), np.minimum(plain[p], plain[q]))
                    near = (100 + percent) * (wide + few) >= percent * (ns[p] + ns[q])
                    p, q = p[near], q[near]
                one, two = ids[p], ids[q]
                out_a.append(np.maximum(one, two))
                out_b.append(np.minimum(one, two))
        return np.concatenate(out_a), np.concatenate(out_b)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)]
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
            cols = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if not len(cols[0]):
                continue
            starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            yield runs(cols, starts[:-1], starts[1:])
            kept = [x[starts[-1] :] for x in cols]
        if len(kept[0]):
            yield runs(kept, np.array([0]), np.array([len(kept[0])]))

    def runs(cols: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        several = ends - starts > 1
        found = [pairs_of(*(x[s:e] for x in cols[1:])) for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True)]
        a, b = (np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)]), axis=1) if found
                else np.zeros((2, 0), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return read


def fewest(n: Column, percent: int) -> Column:
    """What boundaries of partners share at least, if the smaller set has ``n`` shingles."""
    return F.least(F.lit(2) + F.floor(n / 20), F.floor((F.lit(percent) * n + 99) / 100))


def boundary_pairs(points: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can be partners at all.

    The boundary shingles that several points hold are ordered by how many do. Partners share ``fewest`` of them at
    least, so each point may leave out that many less one, its most crowded ones, and still meets every partner in
    another: this is a second, exact division of the crowded regions by their rarer shingles. A boundary that reaches
    the widely held shingles is ``full``: it has all others of its set, so what of those no other boundary has, no full
    partner can hold, and ``rest`` bounds the overlap. A widely held one may lie beyond the partner's boundary, so it
    always counts as shared here."""
    placed = points.join(parts, points["doc_id"] == parts["id"], "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("part"), "bound", "plain"
    )
    rows = placed.select("doc_id", "part", "plain", F.posexplode("bound").alias("at", "token"))
    rows = rows.select("doc_id", "part", "token", (F.col("at") < F.col("plain")).alias("rare"))
    region = Window.partitionBy("token")
    rows = rows.withColumns({
        "crowd": F.count("*").over(region), "mixed": F.min("part").over(region) != F.max("part").over(region)
    })
    shared = materialise(rows.where("crowd > 1"), "shared")
    sizes = points.select(F.col("doc_id").alias("id"), "n", "full", "plain", "slices")
    held = shared.groupBy("doc_id").agg(F.count_if("rare").alias("m"))
    known = held.join(sizes, held["doc_id"] == sizes["id"]).select(
        "id", "n", "full", "plain", "slices", (F.col("n") - F.when(F.col("full"), F.col("plain") - F.col("m")).otherwise(0)).alias("rest")
    )
    able = known.where(F.lit(100) * F.col("rest") >= F.lit(percent) * F.col("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("crowd"), F.desc("token"))
    ranked = shared.withColumn("r", F.row_number().over(order)).where("mixed")
    ranked = ranked.join(able, ranked["doc_id"] == able["id"])
    least = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    ranked = ranked.where(F.col("r") > fewest(least, percent) - 1)
    blocks = F.ceil(F.col("crowd") / F.lit(BLOCK))
    mine = F.pmod(F.xxhash64("doc_id"), blocks)
    meets = F.when(blocks > 1, F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda c: F.struct(
        F.xxhash64("token", F.least(mine, c), F.greatest(mine, c)).alias("token"), F.when(mine == c, -1).otherwise(mine).alias("side"),
    ))).otherwise(F.array(F.struct(F.col("token").alias("token"), F.lit(-1).cast("long").alias("side"))))
    ranked = ranked.withColumn("meet", F.explode(meets)).select(
        F.col("meet.token").alias("token"), "doc_id", "part", "n", "rest", "full", "plain", "slices", F.col("meet.side").alias("side")
    )
    ranked = ranked.repartition("token").sortWithinPartitions("token", "doc_id")
    pairs = ranked.mapInArrow(_meet(percent), "a long, b long").distinct()
    x = points.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bound").alias("x"))
    y = points.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bound").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    return both.where(F.size(F.array_intersect("x", "y")) >= fewest(F.least("na", "nb"), percent)).select("a", "b").distinct()


def jaccard_components(
    documents: DataFrame, k: int = 5, percent: int = 80, pivots: int = 4
) -> DataFrame:
    """Per document row ``doc_id, n_shingles, component_id``: documents are linked when
    ``100 * intersection >= percent * union``; the component is the smallest doc_id that links reach."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialise(survey(docs, k), "survey", ("kind",))
    rows = seen.where("kind = 0").select("doc_id", "n", "s1", "s2")
    total = rows.agg(F.sum("n")).first()[0] or 0
    hot = widely_held(seen.where("kind = 1"), total)
    classes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("cls"))
    classes = materialise(classes, "classes")
    bounds = boundaries(docs, hot, k, percent)
    reps = broadcast_if_small(classes.select("cls").distinct(), MOST_IDS)
    points = materialise(bounds.where("n > 0").join(reps, bounds["doc_id"] == reps["cls"], "left_semi"), "points")
    near = materialise(verified(pivot_pairs(points, 4, pivots), docs, k, percent), "near")
    parts = connected_components(near)
    far = verified(boundary_pairs(points, parts, percent), docs, k, percent)
    links = parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(far)
    found = connected_components(links)
    member = rows.join(classes, ["n", "s1", "s2"], "left")
    out = member.join(found, member["cls"] == found["id"], "left")
    component = F.coalesce("component", "cls", "doc_id")
    return out.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif(component, F.lit(NULL_ID)).alias("component_id"),
    )


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one document of each component: the one with the smallest doc_id. Empty texts stay."""
    found = jaccard_components(documents, k, percent)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_drop_id")).distinct()
    drop = broadcast_if_small(materialise(drop, "copies"), MOST_IDS)
    return documents.join(drop, documents["doc_id"] == drop["_drop_id"], "left_anti")
