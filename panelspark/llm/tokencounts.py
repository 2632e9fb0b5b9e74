"""Exact token counts: documents are aggregated by encoded length into a histogram, and suffix sums over the lengths
answer, for every context limit, how many documents and tokens are above it and what truncation would leave.

Defined cases: null and empty texts have length 0; repeated rows count once each; an empty table gives no rows.
The vocabulary file's path is a parameter; every executor reads it from there.
"""

import base64
import re
from collections.abc import Iterator
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as the pattern has it, in runs so long that matching them by it could overflow the stack.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")
STRETCH = 1 << 16
_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def n_tokens(encoding, text: str) -> int:
    """The exact length of the encoded text. Of a run of white space the pattern makes one piece, without the last
    character if something follows; long runs are cut out as such pieces and merged without the pattern."""
    n, done = 0, 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[done : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        done = end
    return n + len(encoding.encode_ordinary(text[done:]))


def encoded_lengths(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``n_tokens`` of each row's whole text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path)
        for batch in batches:
            n = np.array([n_tokens(encoding, t) if t else 0 for t in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n)], names=["n_tokens"])

    return documents.select("text").mapInArrow(read, "n_tokens long")


def length_histogram(lengths: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Per length that occurs: ``n_tokens, n_docs``, the documents and tokens at this length or above (``docs_from``,
    ``tokens_from``), the ``share_below`` of all documents (``all_docs``), and ``kept_tokens`` if texts were cut at this
    length.

    Sums run in two levels, inside stretches of ``stretch`` lengths and over the stretches."""
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    counts = counts.withColumn("stretch", F.floor(F.col("n_tokens") / F.lit(stretch)))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = counts.groupBy("stretch").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    everything = Window.partitionBy(F.lit(0))
    later = later.select(
        "stretch", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_later"),
        F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"),
    )
    own = Window.partitionBy("stretch").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.join(later, "stretch").withColumns({
        "docs_from": F.sum("n_docs").over(own) + F.col("docs_later"),
        "tokens_from": F.sum("tokens").over(own) + F.col("tokens_later"),
    })
    kept = F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    below = F.round((F.col("all_docs") - F.col("docs_from")) / F.col("all_docs"), 9)
    return sums.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", below.alias("share_below"), kept.alias("kept_tokens"), "all_docs"
    )


def tokens_kept(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens that remain when each text is cut at ``limit``, any limit at all."""
    total = F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs"))
    return histogram.agg(F.coalesce(total, F.lit(0)).alias("kept_tokens"))


def length_quantile(histogram: DataFrame, q: float | Fraction) -> DataFrame:
    """One row: the least length that the share ``q`` of all documents does not exceed."""
    share = Fraction(repr(q)) if isinstance(q, float) else Fraction(q)
    up_to = (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")).cast("decimal(38,0)")
    reached = up_to * F.lit(share.denominator) >= F.col("all_docs").cast("decimal(38,0)") * F.lit(share.numerator)
    return histogram.where(reached).agg(F.min("n_tokens").alias("n_tokens"))
