"""Runs of repeated words, found by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q, of at least ``least`` words and ``times`` periods, that
no neighbouring word extends. For every power of two L, each completed block of L words of a text has a catcher: while
words are appended at a distance of L up to 2 L - 1 behind the block, the catcher compares the last L words with it. An
equal window at distance q is the beginning of a square of period q; suffix comparisons carry it back to where it begins
and forward with each appended word, and the squares of one stretch are one run. Any run of three periods or more with
L <= q < 2 L has a whole aligned block in its first two periods, so none is missed; runs of fewer are not looked for. All words of many texts advance together: at step p only the
block floor(p / L) - 1 can be at such a distance, so each level is one comparison per word.

Two prunings lose nothing. A stretch is begun at its first equal block only, and must have as many equal blocks behind
one another as a run of ``least`` words cannot lack. And a window inside a known run of period r <= L is skipped: it
has both periods, so r divides q, all of its stretch lies in that run, and q is not the smallest period.

Words are compared by hashes, and each run found is compared word by word; should hashes have lied, the text is worked
through again with numbers for its words.

Defined cases: a null text has no words, no runs and an empty ``collapsed``, as the empty text and one of white space
only; very long texts are worked through whole, repeated rows each; an empty table gives no rows; other columns are
kept (existing ``n_words``, ``runs``, ``collapsed`` are replaced)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.textkit import STEP, chunks, mix

RUNS = "array<struct<start:long,length:long,period:long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def reach_of_equal(word: np.ndarray, near: int, far: int, end: int) -> int:
    """How many words from ``near`` and ``far`` (< ``end``) on are equal one by one."""
    done, step = 0, 64
    while far + done < end:
        n = min(step, end - far - done)
        other = np.flatnonzero(word[near + done : near + done + n] != word[far + done : far + done + n])
        if len(other):
            return done + int(other[0])
        done, step = done + n, step * 2
    return done


def equal_before(word: np.ndarray, near: int, far: int, start: int) -> int:
    """How many words before ``near`` (back to ``start``) and before ``far`` are equal one by one."""
    n = 0
    while near - n > start and word[near - n - 1] == word[far - n - 1]:
        n += 1
    return n


class Catchers:
    """The catchers of all levels over texts in a row: ``word`` has a number per word, ``sizes`` the words per text."""

    def __init__(self, word: np.ndarray, sizes: np.ndarray, least: int, times: int) -> None:
        self.word, self.least, self.times = word, least, times
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(word)) - self.begin[self.text]
        self.covered = np.zeros(len(word), np.int64)  # end of the known runs that hold a word, 0 without one
        self.runs: list[dict[tuple[int, int], int]] = [{} for _ in sizes]

    def blocks_needed(self, level: int) -> int:
        """Equal blocks of ``level`` words behind one another that each run with such a period has."""
        periods = np.arange(level, 2 * level)
        equal = np.maximum(self.least - periods, (self.times - 1) * periods)
        return max(1, int(((equal - level + 1) // level).min()))

    def run(self) -> list[list[tuple[int, int, int]]]:
        """The runs of each text, sorted by start and period: (start, length, period)."""
        level, window = 1, self.word
        longest = int((self.end - self.begin).max(initial=0))
        while self.times * level <= longest:
            self.catch(level, window)
            window = mix(window[: max(len(window) - level, 0)] * STEP + window[level:])
            level *= 2
        runs = [[(s, n, q) for (s, n), q in found.items()] for found in self.runs]
        return [sorted(found, key=lambda r: (r[0], r[2])) for found in runs]

    def catch(self, level: int, window: np.ndarray) -> None:
        """One level; ``window`` has the hash of the ``level`` words from each word on."""
        p = np.arange(len(window))
        place, text = self.place[: len(window)], self.text[: len(window)]
        block = p - place + (place // level - 1) * level
        inside = (place >= level) & (p + level <= self.end[text])
        equal = inside & (window == window[np.where(inside, block, 0)])
        begins = equal.copy()
        begins[level:] &= ~(equal[:-level] & inside[level:] & (text[level:] == text[:-level]))
        needed = self.blocks_needed(level)
        for k in {needed - 1, needed // 2}:
            later = np.zeros(len(equal), bool)
            if k * level < len(equal):
                later[: len(equal) - k * level] = equal[k * level :]
            begins &= later
        found = np.flatnonzero(begins)
        found = found[self.covered[block[found]] < found + level]
        for far in found.tolist():
            self.follow(int(block[far]), far, level)

    def follow(self, near: int, far: int, level: int) -> None:
        t, q = int(self.text[far]), far - near
        begin, end = int(self.begin[t]), int(self.end[t])
        equal = reach_of_equal(self.word, near, far, end)
        if equal < level:
            return
        before = equal_before(self.word, near, far, begin)
        start, length = near - before, before + equal + q
        if length < max(self.least, self.times * q):
            return
        known = self.runs[t].setdefault((start - begin, length), q)
        if known == q:
            held = self.covered[start : start + length]
            np.maximum(held, start + length, out=held)


def runs_of(words: list[bytes], least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs of one text by numbers instead of hashes."""
    number: dict[bytes, int] = {}
    word = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    return Catchers(word, np.array([len(words)]), least, times).run()[0]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    dropped = np.zeros(len(words), bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~dropped).tolist()])


def with_runs(documents: DataFrame, least: int = 24, times: int = 3, column: str = "text") -> DataFrame:
    """All columns, ``n_words``, ``runs`` (start in words, length, smallest period; by start, then period), and
    ``collapsed``: the words, joined by a blank, without those that a run holds after its first period."""
    if times < 3:
        raise ValueError("times must be 3 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(column), fold=False):
                found = Catchers(part.hash, part.count, least, times).run()
                texts = []
                for k in range(part.n_docs):
                    words = part.bytes[part.offsets[k] : part.offsets[k + 1]].tobytes().split()
                    if any(words[s : s + n - q] != words[s + q : s + n] for s, n, q in found[k]):
                        found[k] = runs_of(words, least, times)
                    texts.append(collapsed(words, found[k]) if found[k] else b" ".join(words))
                rows = batch.slice(part.first, part.n_docs)
                names = [n for n in rows.schema.names if n not in ("n_words", "runs", "collapsed")]
                told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(n) for n in names), pa.array(part.count.astype(np.int64)), pa.array(told, RUN_TYPE),
                     pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "n_words", "runs", "collapsed"],
                )

    kept = documents.drop("n_words", "runs", "collapsed")
    out = kept.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.lit(None).cast(RUNS), "collapsed": F.lit("")})
    return kept.mapInArrow(run, out.schema)
