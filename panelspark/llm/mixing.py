"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, are cut into blocks of ``block`` units of size. Block j of a source with weight
w gets the release time ``floor(j / w)`` and the deadline ``ceil((j + 1) / w)``; earliest deadline first among the
released blocks fills one slot after the other. Every block then lies inside its window, so after any number of slots
each source is less than one block away from its share. Weights are held exactly, as whole numbers in the proportions
asked for, so releases and deadlines are exact too, and the order of slots repeats after as many slots as the weights'
sum; no more than one such cycle, or the slots up to a source's end where these are fewer, is worked out by the driver.
A block's slot follows by arithmetic. When a source ends, the others go on in their proportions: a new phase. Every
document is placed.

What the driver works out is at most one entry per block of the mixture, whatever the weights. Let ``block`` grow with
the corpus (64 MB rather than 64 kB at 100 TB); without weights the targets are whole parts of about ``parts``, so the
cycle is as short.

Defined cases: a null source is a source of its own; null and empty texts have size 0 and stay with the block they fall
into; repeated rows are placed side by side; a source without a positive weight gets no slot, so its documents go; if
weights are left out, they follow the square root of the source's size; columns of the input named like one of
``PLACED`` are replaced, any other name may be there; an empty table gives no rows.
"""

import heapq
import json
import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.decontaminate import broadcast_if_small

PLAN = "array<struct<source:string,first:bigint,last:bigint,share:bigint,start:bigint,cycle:bigint,places:array<bigint>>>"
NO_SOURCE = "\0"
PLACED = ("block", "release", "deadline", "slot", "place")  # these replace columns of the input with such names
MOST_BLOCKS = 1_000_000  # so many block rows are broadcast at most; beyond, Spark shuffles the join

Weight = int | float | Decimal | Fraction


def whole_weights(weights: dict[str, Weight]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of ``weights``; a float counts as the decimal fraction that it prints as."""
    exact = {s: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    return {s: w // math.gcd(*whole.values()) for s, w in whole.items()}


def usual_weights(sizes: dict[str, int], parts: int) -> dict[str, int]:
    """The targets if none are given: square roots of the sizes, in whole parts of which the largest source has ``parts``."""
    roots = {s: math.sqrt(max(1, n)) for s, n in sizes.items()}
    top = max(roots.values(), default=1.0)
    return {s: max(1, round(parts * x / top)) for s, x in roots.items()}


def pfair_slots(weights: dict[str, int], n: int) -> dict[str, list[int]]:
    """Each source's slots among the first ``n``: earliest deadline first among the released blocks."""
    total = sum(weights.values())
    released: list[tuple[int, str, int]] = []
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    places: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(j + 1) * total // weights[s]), s, j))
        _, s, j = heapq.heappop(released)
        places[s].append(slot)
        heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return places


def plan_phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Per phase and source: which of its blocks (``first`` to ``last``) have which share of the cycle, from which start
    slot on, and the slots of the first ``share`` blocks, or of all if they are fewer."""
    out: list[dict] = []
    done, start = dict.fromkeys(weights, 0), 0
    active = {s: w for s, w in weights.items() if blocks[s]}
    while active:
        shared = math.gcd(*active.values())
        parts = {s: w // shared for s, w in active.items()}
        cycle = sum(parts.values())
        left = {s: blocks[s] - done[s] for s in active}
        soonest = min(-(-left[s] * cycle // parts[s]) for s in active)  # some source ends by then
        places = pfair_slots(parts, min(cycle, soonest))

        def slot_of(s: str, j: int) -> int:
            turn, at = divmod(j, parts[s])
            return turn * cycle + places[s][at] if at < len(places[s]) else soonest

        end = min(slot_of(s, left[s] - 1) for s in active) + 1
        turns, rest = divmod(end, cycle)
        for s in active:
            n = turns * parts[s] + sum(p < rest for p in places[s])
            if n:
                out.append({"source": s, "first": done[s], "last": done[s] + n - 1, "share": parts[s], "start": start,
                            "cycle": cycle, "places": places[s][:n]})
            done[s] += n
        start += end
        active = {s: w for s, w in active.items() if done[s] < blocks[s]}
    return out


def block_table(documents: DataFrame, phases: list[dict]) -> DataFrame:
    """``of, block, release, deadline, slot``: one row per block of the mixture."""
    plan = documents.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(phases)), PLAN)).alias("p")).select("p.*")
    each = plan.select("*", F.explode(F.sequence("first", "last")).alias("block")).withColumn("j", F.col("block") - F.col("first"))
    at = F.element_at("places", (F.col("j") % F.col("share") + 1).cast("int"))
    return each.select(
        F.col("source").alias("of"), "block",
        (F.col("start") + F.expr("(j * cycle) div share")).alias("release"),
        (F.col("start") + F.expr("((j + 1) * cycle + share - 1) div share")).alias("deadline"),
        (F.col("start") + F.expr("j div share") * F.col("cycle") + at).alias("slot"),
    )


def mix_sources(
    documents: DataFrame, weights: dict[str, Weight] | None = None, size: Column | None = None, block: int = 65_536,
    parts: int = 1000, bucket_rows: int = 1024,
) -> DataFrame:
    """``documents`` with ``block, release, deadline, slot, place``; sorting by (slot, place) gives the mixture.

    A source's running size is summed in two levels, hash buckets of about ``bucket_rows`` of its rows and rows inside
    a bucket, so no task holds a whole source. The driver sees one size per source."""
    own = [c for c in documents.columns if c not in PLACED]
    rows = documents.select(
        F.struct(*own).alias("row"), F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("of"),
        F.coalesce((F.length("text") if size is None else size).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.xxhash64("doc_id").alias("hash"),
    )
    totals = rows.groupBy("of").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    sizes = {r["of"]: r["n"] for r in totals}
    blocks = {s: max(1, -(-n // block)) for s, n in sizes.items()}
    if weights is None:
        targets = usual_weights(sizes, parts)
    else:
        named = {NO_SOURCE if s is None else s: w for s, w in weights.items()}
        targets = whole_weights({s: named[s] for s in sizes if named.get(s, 0) > 0})
    told = json.dumps([{"of": r["of"], "buckets": -(-r["rows"] // bucket_rows), "most": blocks[r["of"]] - 1}
                       for r in totals if r["of"] in targets])
    sources = documents.sparkSession.range(1).select(
        F.explode(F.from_json(F.lit(told), "array<struct<of:string,buckets:bigint,most:bigint>>")).alias("s")
    ).select("s.*")
    rows = rows.join(broadcast_if_small(sources, MOST_BLOCKS), "of").withColumn("bucket", F.pmod("hash", "buckets").cast("int"))
    before = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("of", "bucket").agg(F.sum("size").alias("total"))
    bases = bases.select("of", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("of", "bucket").orderBy("hash", "row.doc_id", "size", F.xxhash64("row.text"))
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(bases, ["of", "bucket"]).select(
        "row", "of", "bucket", "most", F.row_number().over(inside).cast("long").alias("rank"),
        (F.col("base") + F.coalesce(F.sum("size").over(prior), F.lit(0))).alias("offset"),
    )
    number = F.least(F.expr(f"offset div {block}"), F.col("most"))  # an empty document at the very end
    table = block_table(documents, plan_phases(blocks, targets))
    out = placed.withColumn("block", number).join(broadcast_if_small(table, MOST_BLOCKS), ["of", "block"])
    return out.select("row.*", "block", "release", "deadline", "slot", F.struct("bucket", "rank").alias("place"))
