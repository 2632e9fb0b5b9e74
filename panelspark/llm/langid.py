"""Language identification by string kernels: blended-spectrum n-gram presence kernels, Nystroem landmarks, and
one-versus-rest kernel ridge regression.

For n = 1, 2, 3 bytes, ``K_n(x, z) = |G_n(x) & G_n(z)| / sqrt(|G_n(x)| |G_n(z)|)`` with the n-grams present in the
lower-cased texts, over the n-grams that at least two texts of the fitting sample hold, norms too; K is the mean of the
three. With landmarks L the
features are ``K(x, L) K_LL^(-1/2)``, and ridge regression on them gives a score per language. As K(x, L) is linear in
the presence rows of x, both matrices are multiplied into one weight per n-gram and language beforehand, and a batch
is scored as a matrix product of its presence rows with these weights.

The model is fitted on at most ``per_language`` labelled documents of each language, chosen by hash over all rows;
every document is scored on its whole text.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; documents without a label, or with
a null text, do not train; without any training rows all texts are ``und``; equal rows get equal answers; one
language alone is always predicted; empty tables give no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NS = (1, 2, 3)
UND = "und"
BATCH = 128


def gram_codes(text: str, n: int) -> np.ndarray:
    """The byte n-grams of a text as numbers, with repeats."""
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8).astype(np.int32)
    if len(raw) < n:
        return np.zeros(0, dtype=np.int32)
    codes = np.zeros(len(raw) - n + 1, dtype=np.int32)
    for j in range(n):
        codes = codes * 256 + raw[j : len(raw) - n + 1 + j]
    return codes


def sample_grams(rows: DataFrame) -> DataFrame:
    """``lang`` and the distinct n-grams of each whole text, for n = 1, 2, 3."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[np.unique(gram_codes(t, n)) for t in batch.column(2).to_pylist()] for n in NS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int32())) for x in found)],
                names=["lang", "h", "g1", "g2", "g3"],
            )

    return rows.select("lang", "h", "text").mapInArrow(
        read, "lang string, h long, g1 array<int>, g2 array<int>, g3 array<int>"
    )


def training_sample(labelled: DataFrame, per_language: int, slices: int = 16) -> DataFrame:
    """At most ``per_language`` rows of each language, the first in hash order of their slice. Slices keep a language
    that holds most rows from meeting in one task."""
    h = F.xxhash64("doc_id", F.lit("langid"))
    light = labelled.select("doc_id", "lang", h.alias("h")).withColumn("slice", F.pmod("h", F.lit(slices)))
    first = Window.partitionBy("lang", "slice").orderBy("h", "doc_id")
    chosen = light.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language // slices)
    chosen = chosen.select(F.col("doc_id").alias("c_id")).distinct()
    rows = labelled.withColumn("h", h)
    return rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["c_id"], "left_semi")


class Model:
    """Languages, and per n a table from n-gram code to row and the weights (n-gram x language)."""

    def __init__(self, languages: list[str], vocabularies: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.languages, self.vocabularies, self.weights = languages, vocabularies, weights

    @classmethod
    def fit(cls, langs: list[str], grams: list[list[np.ndarray]], landmarks: int, ridge: float) -> "Model":
        """``grams``: for each n the distinct n-gram codes of each training text."""
        languages = sorted(set(langs))
        own = np.array([languages.index(x) for x in langs])
        marks = np.unique(np.linspace(0, len(langs) - 1, min(landmarks, len(langs))).astype(int))
        vocabularies, rows = [], []
        for each in grams:
            codes, held = np.unique(np.concatenate(each), return_counts=True)
            codes = codes[held >= min(2, len(langs))]
            x = np.zeros((len(each), len(codes)), dtype=np.float32)
            for i, g in enumerate(each):
                at = np.minimum(np.searchsorted(codes, g), max(len(codes) - 1, 0))
                if len(codes):
                    x[i, at[codes[at] == g]] = 1
            x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            vocabularies.append(codes)
            rows.append(x)
        k = sum(x @ x[marks].T for x in rows).astype(np.float64) / len(NS)
        values, vectors = np.linalg.eigh(k[marks])
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        features = k @ root
        target = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
        balance = (1 / np.maximum(np.bincount(own, minlength=len(languages)), 1))[own][:, None]
        gram = features.T @ (features * balance) + ridge * np.eye(len(marks))
        solved = root @ np.linalg.solve(gram, features.T @ (target * balance))
        weights = [(x[marks].T @ solved / len(NS)).astype(np.float32) for x in rows]
        return cls(languages, vocabularies, weights)

    def tables(self) -> list[np.ndarray]:
        out = []
        for n, codes in zip(NS, self.vocabularies, strict=True):
            table = np.full(1 << (8 * n), len(codes), dtype=np.int32)  # the last column takes what is unknown
            table[codes] = np.arange(len(codes))
            out.append(table)
        return out

    def scores(self, texts: list[str], tables: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.languages)), dtype=np.float32)
        for n, table, weights in zip(NS, tables, self.weights, strict=True):
            present = np.zeros((len(texts), len(weights) + 1), dtype=np.float32)
            for i, text in enumerate(texts):
                present[i, table[gram_codes(text, n)]] = 1
            known = present[:, :-1]
            total += known @ weights / np.sqrt(np.maximum(known.sum(axis=1, keepdims=True), 1))
        return total


def fit_language_model(
    labelled: DataFrame, per_language: int = 320, landmarks: int = 256, ridge: float = 1e-3
) -> Model | None:
    """``labelled`` has ``doc_id, text, lang``. None where no row can train."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    found = sample_grams(training_sample(rows, per_language)).toPandas()
    if found.empty:
        return None
    found = found.sort_values(["h", "lang"], kind="stable")
    grams = [[np.asarray(x, dtype=np.int32) for x in found[f"g{n}"]] for n in NS]
    return Model.fit(found["lang"].tolist(), grams, landmarks, ridge)


def predict_language(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` without its text, with ``lang_pred`` and ``score``."""
    names = [c for c in documents.columns if c != "text"]
    at = documents.columns.index("text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text"]
    held = documents.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        tables = model.tables() if model else []
        for batch in batches:
            texts = batch.column(at).to_pylist()
            said, sure = [UND] * len(texts), np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if model and t is not None and any(map(str.isalpha, t))]
            for first in range(0, len(asked), BATCH):
                part = asked[first : first + BATCH]
                scores = model.scores([texts[i] for i in part], tables)
                best = scores.argmax(axis=1)
                for i, b, s in zip(part, best.tolist(), scores.max(axis=1).tolist(), strict=True):
                    said[i], sure[i] = model.languages[b], min(1.0, max(0.0, (s + 1) / 2))
            own = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(said, pa.string()), pa.array(np.round(sure, 6))], names=[*names, "lang_pred", "score"]
            )

    return documents.mapInArrow(read, ", ".join([*kinds, "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    """A third of the documents, by the checksum of their id, never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_digest(documents: DataFrame, per_language: int = 320) -> DataFrame:
    docs = documents.select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))), per_language)
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_language(asked, model)
