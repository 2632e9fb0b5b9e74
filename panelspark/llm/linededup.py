"""Reversible incremental line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of fewer than ``min_chars`` code
points are ignored. The state (``LineState``) is two tables:

* ``counts(k1, k2, n_docs, keeper)``: for each 128-bit key the number of documents that hold it and the largest of
  their ids. Exact; a deletion lowers the counts, so it undoes an insertion.
* ``filters(shard, bits)``: a cuckoo filter per shard over the keys that are to be dropped (held by ``min_docs``
  documents or more). A filter answers most lookups without touching the counts; every hit is verified against them.

``inserted`` and ``deleted`` give the state after a batch of documents: the counts of the batch's keys change, and the
keys that cross ``min_docs`` upwards are inserted into their shards' filters, those that cross it downwards deleted.
Other shards' filters stay as they are. A full filter gets another table of the same size beside it; lookups ask all of
its tables. Because the tables of a shard are of one size, two keys with one fingerprint and one pair of buckets in one
table have them in all, so whichever of equal fingerprints a deletion takes, those that stay answer for the keys that
stay. A whole corpus is one insertion into the empty state.

Keys held by a millionth of all (document, key) pairs or more are at most a million, whatever the corpus; they are joined
apart, so no shard's group grows with one hot line.

Defined cases: a null or empty text is one empty line; a null doc_id counts as one document, smaller than all others;
rows that repeat a doc_id belong to one document, which holds a key once; empty tables give no rows.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.decontaminate import broadcast_if_small
from panelspark.llm.store import materialise

BLANKS = b" \t\n\x0b\x0c\r"
NULL_ID = -(1 << 63)
SLOTS = 4
KICKS = 500
KEYS_A_SHARD = 1 << 15
LEAST_SHARDS = 64
LEAST_BUCKETS = 1 << 8


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(BLANKS)
    if len(key) < min_chars:
        return None
    key = key.lower()  # of bytes: A-Z only
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def document_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, k1, k2)``: the distinct keys of each row's text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                held = {line_key(x, min_chars) for x in text.as_buffer().to_pybytes().split(b"\n")}
                held.discard(None)
                found.extend(held)
                ids.extend([NULL_ID if doc_id is None else doc_id] * len(held))
            pairs = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "k1", "k2"]
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        keys, "doc_id long, k1 long, k2 long"
    )


class Cuckoo:
    """A partial-key cuckoo filter: four 16-bit fingerprints a bucket, two candidate buckets a key."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray) -> "Cuckoo":
        buckets = 1 << max(int(np.log2(LEAST_BUCKETS)), int(np.ceil(np.log2(max(1, len(k1)) / (SLOTS * 0.8)))))
        while True:
            filled = cls.empty(buckets)
            left = filled.insert_free(k1, k2)
            if all(map(filled.insert, k1[left].tolist(), k2[left].tolist())):
                return filled
            buckets *= 2

    @classmethod
    def empty(cls, buckets: int) -> "Cuckoo":
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    def insert_free(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Puts keys into free slots of their two buckets, all at once; which keys found none."""
        left = np.arange(len(k1))
        for second in (False, True):
            mark, bucket = self.mark(k2[left]), self.home(k1[left])
            bucket = self.other(bucket, mark) if second else bucket
            self.table = -np.sort(-self.table.astype(np.int32), axis=1)  # free slots last
            order = np.argsort(bucket, kind="stable")
            sorted_to = bucket[order]
            fresh = np.concatenate([[True], sorted_to[1:] != sorted_to[:-1]]) if len(order) else np.zeros(0, bool)
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            slot = (self.table[sorted_to] > 0).sum(axis=1) + rank
            fits = slot < SLOTS
            self.table[sorted_to[fits], slot[fits]] = mark[order][fits]
            self.table = self.table.astype(np.uint16)
            left = left[np.sort(order[~fits])]
        return left

    def mark(self, k2):
        return (k2 & 0x7FFF) + 1

    def home(self, k1):
        return (k1 >> 20) & (len(self.table) - 1)

    def other(self, bucket, mark):
        return bucket ^ ((mark * 0x5BD1E995) & (len(self.table) - 1))

    def insert(self, k1: int, k2: int) -> bool:
        mark, bucket = self.mark(k2), self.home(k1)
        for place in (bucket, self.other(bucket, mark)):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        for turn in range(KICKS):
            slot = (mark + turn) % SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = self.other(place, mark)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        return False

    def delete(self, k1: int, k2: int) -> bool:
        mark, bucket = self.mark(k2), self.home(k1)
        for place in (bucket, self.other(bucket, mark)):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    def __contains__(self, key: tuple[int, int]) -> bool:
        return bool(self.lookup(np.array([key[0]]), np.array([key[1]]))[0])

    def lookup(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, bucket = self.mark(k2), self.home(k1)
        both = np.concatenate([self.table[bucket], self.table[self.other(bucket, mark)]], axis=1)
        return (both == mark[:, None].astype(np.uint16)).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Cuckoo":
        return cls(np.frombuffer(raw, dtype=np.uint16).reshape(-1, SLOTS).copy())


def changed_tables(tables: list[Cuckoo], gone: np.ndarray, more: np.ndarray) -> list[Cuckoo]:
    """A shard's tables without the keys (rows of k1, k2) of ``gone``, which they hold, and with those of ``more``."""
    for k1, k2 in gone.tolist():
        any(x.delete(k1, k2) for x in tables)
    k1, k2 = more[:, 0], more[:, 1]
    if not tables and len(k1):
        return [Cuckoo.build(k1, k2)]
    for table in tables:
        left = table.insert_free(k1, k2)
        k1, k2 = k1[left], k2[left]
    while len(k1):
        tables = [*tables, Cuckoo.empty(len(tables[0].table))]
        left = tables[-1].insert_free(k1, k2)
        k1, k2 = k1[left], k2[left]
    return tables


def reference_counts(keys: DataFrame) -> DataFrame:
    """Exact counts of a batch's ``(doc_id, k1, k2)``; partial aggregation takes hot keys before the shuffle."""
    return keys.groupBy("k1", "k2").agg(
        F.count("*").alias("n_docs"),
        F.max("doc_id").alias("keeper"),
    )


@dataclass
class LineState:
    """``counts`` and ``filters`` of a corpus; ``n_shards`` stays while it grows."""

    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int


def empty_state(spark: SparkSession, expected_pairs: int, min_docs: int = 3) -> LineState:
    """A state for about ``expected_pairs`` pairs of a document and a key; more only make its shards larger."""
    return LineState(
        spark.createDataFrame([], "k1 long, k2 long, n_docs long, keeper long"),
        spark.createDataFrame([], "shard int, bits array<binary>"), max(LEAST_SHARDS, -(-expected_pairs // KEYS_A_SHARD)), min_docs,
    )


def _changed(state: LineState, counts: DataFrame, crossed: DataFrame) -> LineState:
    """``crossed``: ``k1, k2, added`` for the keys whose count crosses ``min_docs``."""
    n_shards = state.n_shards

    def change(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return held[["shard", "bits"]]
        tables = [Cuckoo.from_bytes(x) for x in held["bits"].iloc[0]] if len(held) else []
        keys, added = rows[["k1", "k2"]].to_numpy(), rows["added"].to_numpy(dtype=bool)
        tables = changed_tables(tables, keys[~added], keys[added])
        return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "bits": [[x.to_bytes() for x in tables]]})

    keyed = crossed.select("k1", "k2", "added", shard_of(n_shards).alias("shard"))
    filters = keyed.groupBy("shard").cogroup(state.filters.groupBy("shard")).applyInPandas(change, "shard int, bits array<binary>")
    return LineState(counts, materialise(filters, "filters"), n_shards, state.min_docs)


def inserted(state: LineState, keys: DataFrame) -> LineState:
    """After a batch of new documents; ``keys`` are its distinct ``(doc_id, k1, k2)``, of documents not in ``state`` yet."""
    new = reference_counts(keys).select("k1", "k2", F.lit(0).cast("long").alias("before"), "n_docs", "keeper")
    old = state.counts.select("k1", "k2", F.col("n_docs").alias("before"), "n_docs", "keeper")
    both = old.unionByName(new).groupBy("k1", "k2").agg(
        F.sum("before").alias("before"), F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")
    )
    both = materialise(both, "linecounts")
    crossed = both.where((F.col("before") < state.min_docs) & (F.col("n_docs") >= state.min_docs))
    return _changed(state, both.drop("before"), crossed.select("k1", "k2", F.lit(True).alias("added")))


def deleted(state: LineState, gone: DataFrame, remaining: DataFrame) -> LineState:
    """After documents go: ``gone`` and ``remaining`` are the ``(doc_id, k1, k2)`` of both sides.

    A key whose keeper goes gets the largest remaining holder; a key without holders leaves the table."""
    lost = gone.groupBy("k1", "k2").agg(F.count("*").alias("gone"), F.max("doc_id").alias("largest"))
    left = state.counts.join(lost, ["k1", "k2"], "left").select(
        "k1", "k2", F.col("n_docs").alias("before"), (F.col("n_docs") - F.coalesce("gone", F.lit(0))).alias("n_docs"), "keeper",
        F.coalesce(F.col("largest") == F.col("keeper"), F.lit(False)).alias("orphan"),
    )
    left = materialise(left, "linecounts")
    orphans = left.where("orphan AND n_docs > 0").select("k1", "k2")
    heirs = remaining.join(orphans, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc_id").alias("heir"))
    counts = left.where("n_docs > 0").join(heirs, ["k1", "k2"], "left").select(
        "k1", "k2", "n_docs", F.coalesce("heir", "keeper").alias("keeper")
    )
    crossed = left.where((F.col("before") >= state.min_docs) & (F.col("n_docs") < state.min_docs))
    return _changed(state, materialise(counts, "linecounts"), crossed.select("k1", "k2", F.lit(False).alias("added")))


def shard_of(n_shards: int):
    return F.pmod(F.col("k1"), F.lit(n_shards)).cast("int")


def probe(keys: DataFrame, state: LineState) -> DataFrame:
    """The rows of ``(doc_id, k1, k2)`` that their shard's filter lets through."""

    def through(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(rows), dtype=bool)
        for table in held["bits"].iloc[0] if len(held) else []:
            hit |= Cuckoo.from_bytes(table).lookup(rows["k1"].to_numpy(), rows["k2"].to_numpy())
        return rows.loc[hit, ["doc_id", "k1", "k2"]]

    keyed = keys.withColumn("shard", shard_of(state.n_shards))
    return keyed.groupBy("shard").cogroup(state.filters.groupBy("shard")).applyInPandas(through, "doc_id long, k1 long, k2 long")


def dropped_keys(keys: DataFrame, state: LineState) -> DataFrame:
    """``(doc_id, k1, k2)`` of the lines to drop: held by ``min_docs`` documents, and not in their keeper."""
    pairs = state.counts.agg(F.sum("n_docs").alias("pairs")).first()["pairs"] or 0
    frequent = state.counts.where(F.col("n_docs") >= state.min_docs)
    hot_from = max(1 << 12, pairs // 1_000_000)  # at most a million keys can be held that often
    hot = broadcast_if_small(frequent.where(F.col("n_docs") >= hot_from).select("k1", "k2", "keeper"), 1_000_000)
    rest = frequent.where(F.col("n_docs") < hot_from).select("k1", "k2", "keeper")
    cold = keys.join(hot, ["k1", "k2"], "left_anti")
    verified = probe(cold, state).join(rest, ["k1", "k2"])
    lines = keys.join(hot, ["k1", "k2"]).unionByName(verified)
    return lines.where(F.col("doc_id") != F.col("keeper")).select("doc_id", "k1", "k2")


def drop_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``documents`` with ``_kept_text`` (null text stays null unless changed), ``_n_lines`` and ``_n_dropped``."""
    keys = materialise(document_keys(documents, min_chars).distinct(), "linekeys")
    state = inserted(empty_state(documents.sparkSession, keys.count(), min_docs), keys)
    return rewrite(documents, dropped_keys(keys, state), min_chars)


def rewrite(documents: DataFrame, dropped: DataFrame, min_chars: int) -> DataFrame:
    """Drops the keys of ``(doc_id, k1, k2)`` from their documents' texts. Only a document's own keys are gathered."""
    per_doc = dropped.groupBy(F.col("doc_id").alias("_drop_id")).agg(
        F.collect_list("k1").alias("_drop_k1"), F.collect_list("k2").alias("_drop_k2")
    )
    mine = F.coalesce(documents["doc_id"].cast("long"), F.lit(NULL_ID))
    joined = documents.join(per_doc, mine == per_doc["_drop_id"], "left").drop("_drop_id")
    names = documents.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone = [], [], []
            for text, a, b in zip(batch.column(at), batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, kept = raw.count(b"\n") + 1, None
                if a.is_valid:
                    keys = np.stack([a.values.to_numpy(), b.values.to_numpy()], axis=1).astype("<i8")
                    drop = {row.tobytes() for row in keys}
                    kept = [x for x in raw.split(b"\n") if line_key(x, min_chars) not in drop]
                    raw = b"\n".join(kept)
                texts.append(raw.decode() if text.is_valid else None)
                lines.append(n)
                gone.append(0 if kept is None else n - len(kept))
            columns = list(batch.columns[: len(names)])
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                names=[*names, "_kept_text", "_n_lines", "_n_dropped"],
            )

    return joined.mapInArrow(cut, f"{kinds}, _kept_text string, _n_lines long, _n_dropped long")


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``documents`` with the same columns; each frequent line stays only in the largest doc_id that holds it."""
    kept = drop_lines(documents, min_chars, min_docs).withColumn("text", F.col("_kept_text"))
    return kept.select(*documents.columns)


def line_digest(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    kept = drop_lines(documents.select("doc_id", "text"), min_chars, min_docs)
    return kept.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("_kept_text", F.lit("")), 256).alias("kept_sha256"),
    )
