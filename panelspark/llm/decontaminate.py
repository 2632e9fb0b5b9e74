"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by the windows of the
training texts, with exact verification of every hit.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. A window is ``n`` consecutive
words of an item; a shorter item is one window. Any occurrence of an ``n``-word window in a document covers a
whole aligned chunk of ``(n + 1) // 2`` words, so the first scan probes only each document's aligned chunks; the
documents with a probable hit are then scanned window by window and compared by text.

Defined cases: null and empty texts have no words and are clean; several rows with one doc_id are told apart by their
text, and equal rows get equal results; null ids are kept; an empty benchmark or corpus gives clean rows or none.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.store import materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_CHARS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_norm(df: DataFrame, text: str = "text", out: str = "norm") -> DataFrame:
    """Adds the words of ``text``, each followed by one space ('' where there are none)."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SEPARATORS, " "))
    ascii_only = F.length("_flat") == F.octet_length("_flat")
    low = F.when(ascii_only, F.lower("_flat")).otherwise(F.translate("_flat", UPPER, LOWER))
    norm = F.when(F.col("_flat") == "", F.lit("")).otherwise(F.concat(low, F.lit(" ")))
    return df.withColumn("_flat", flat).withColumn(out, norm).drop("_flat")


def n_words(norm: Column) -> Column:
    return (F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))).cast("long")


def aligned_chunks(norm: Column, k: int) -> Column:
    return F.regexp_extract_all(norm, F.lit(rf"\G(?:[^ ]++ ){{{k}}}"), F.lit(0))


def sliding_windows(norm: Column, k: int) -> Column:
    return F.regexp_extract_all(norm, F.lit(rf"\G(?=((?:[^ ]++ ){{{k}}}))[^ ]++ "), F.lit(1))


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> tuple[DataFrame, list[int]]:
    """``(size, win, items)`` for each distinct window, and the window sizes that occur (at most ``n`` of them)."""
    items = with_norm(benchmark.select("item_id", "text")).withColumn("words", n_words(F.col("norm")))
    items = items.where("words > 0").withColumn("size", F.least("words", F.lit(n)).cast("int"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    whole = F.array(F.col("norm"))
    wins = items.select(
        "item_id", "size",
        F.explode(F.when(F.col("size") == n, sliding_windows(F.col("norm"), n)).otherwise(whole)).alias("win"),
    )
    wins = wins.groupBy("size", "win").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return wins, sizes


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """Broadcasts ``df`` only after counting that it has at most ``most`` rows; otherwise Spark shuffles the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def contamination(
    documents: DataFrame, benchmark: DataFrame, n: int = 13, most_broadcast: int = 1_000_000
) -> DataFrame:
    """Per document row: ``doc_id, text_key, n_words, n_hit, items, spans``; spans are merged [start, end) word ranges.

    The benchmark's windows are broadcast only below ``most_broadcast`` of them. The corpus is never broadcast."""
    wins, sizes = benchmark_windows(benchmark, n)
    docs = documents.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    norm = with_norm(docs)
    ks = sorted({(s + 1) // 2 for s in sizes})
    totals = norm.select("doc_id", "text_key", n_words(F.col("norm")).alias("n_words"))
    if not sizes:
        return totals.select(
            "*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<bigint>").alias("items"),
            F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        )
    wanted = wins.select(
        F.explode(
            F.concat(*(F.when(F.floor((F.col("size") + 1) / 2) == k, sliding_windows(F.col("win"), k))
                       .otherwise(F.array().cast("array<string>")) for k in ks))
        ).alias("chunk")
    ).select(F.xxhash64("chunk").alias("chunk")).distinct()
    chunks = norm.select(
        "doc_id", "text_key", F.explode(F.concat(*(aligned_chunks(F.col("norm"), k) for k in ks))).alias("chunk")
    )
    found = chunks.select("doc_id", "text_key", F.xxhash64("chunk").alias("chunk")).join(
        broadcast_if_small(wanted, most_broadcast * n), "chunk", "left_semi"
    )
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key")).distinct()
    suspects = docs.join(
        found, docs["doc_id"].eqNullSafe(found["f_id"]) & (docs["text_key"] == found["f_key"]), "left_semi"
    ).dropDuplicates(["doc_id", "text_key"])
    def placed(size: int) -> Column:
        wins = sliding_windows(F.col("norm"), size)
        return F.transform(wins, lambda w, i: F.struct(i.alias("pos"), F.lit(size).alias("size"), w.alias("win")))

    each = F.concat(*map(placed, sizes))
    seen = with_norm(suspects).select("doc_id", "text_key", F.explode(each).alias("w")).select(
        "doc_id", "text_key", "w.pos", "w.size", F.col("w.win").alias("win"), F.xxhash64("w.win").alias("h")
    )
    known = broadcast_if_small(wins.withColumn("h", F.xxhash64("win")), most_broadcast)
    hits = seen.join(known, ["h", "size", "win"])
    merged = F.aggregate(
        F.array_sort("ranges"),
        F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"),
                 F.array().cast("array<struct<start:int,end:int>>").alias("done")),
        lambda a, r: F.when(
            r["start"] <= a["end"],
            F.struct(a["start"].alias("start"), F.greatest(a["end"], r["end"]).alias("end"),
                     (a["n"] + F.greatest(r["end"] - a["end"], F.lit(0))).alias("n"), a["done"].alias("done")),
        ).otherwise(
            F.struct(r["start"].alias("start"), r["end"].alias("end"), (a["n"] + r["end"] - r["start"]).alias("n"),
                     F.when(a["end"] < 0, a["done"]).otherwise(
                         F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))
                     ).alias("done"))
        ),
        lambda a: F.struct(
            a["n"].alias("n"),
            F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))).alias("spans"),
        ),
    )
    per_doc = hits.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"))).alias("ranges"),
        F.flatten(F.collect_set("items")).alias("all_items"),
    ).select(
        F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), merged.alias("m"),
        F.array_sort(F.array_distinct("all_items")).alias("items"),
    )
    return totals.join(
        per_doc, totals["doc_id"].eqNullSafe(per_doc["h_id"]) & (totals["text_key"] == per_doc["h_key"]), "left"
    ).select(
        "doc_id", "text_key", "n_words",
        F.coalesce("m.n", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("m.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def is_contaminated(per_mille: int = 50) -> Column:
    """At least ``per_mille`` thousandths of the document's words lie inside benchmark windows."""
    return (F.col("n_hit") > 0) & (F.lit(1000) * F.col("n_hit") >= F.lit(per_mille) * F.col("n_words"))


def cut_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and the separators right after them."""
    words = F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")
    gaps = F.split(text, WORD_CHARS, -1)
    kept = F.transform(
        words,
        lambda w, i: F.when(
            F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])), F.lit("")
        ).otherwise(F.concat(w, F.element_at(gaps, i + 2))),
    )
    return F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, n: int = 13, per_mille: int = 50, remove: str = "documents",
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """``documents`` with its own columns, without contaminated documents (``remove="documents"``) or without
    the benchmark passages inside contaminated documents (``remove="spans"``)."""
    marks = contamination(documents, benchmark, n, most_broadcast).where(is_contaminated(per_mille))
    marks = marks.select(
        F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"), F.col("spans").alias("_hit_spans")
    ).dropDuplicates(["_hit_id", "_hit_key"])
    marks = broadcast_if_small(materialise(marks, "contaminated"), most_broadcast)
    same = documents["doc_id"].eqNullSafe(marks["_hit_id"]) & (F.xxhash64(documents["text"]) == marks["_hit_key"])
    if remove == "documents":
        return documents.join(marks, same, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    cleaned = F.when(F.col("_hit_id").isNull() & F.col("_hit_spans").isNull(), F.col("text")).otherwise(
        cut_spans(F.col("text"), F.col("_hit_spans"))
    )
    names = documents.columns
    joined = documents.join(marks, same, "left").withColumn("text", cleaned)
    return joined.select(*names)
