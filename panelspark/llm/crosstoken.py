"""Alignment of two tokenizers over the same bytes, as an associative composition of fragments.

Byte offsets where tokens of both end are cuts; tokens between two cuts are a group. A text is laid out in ranges of
``chunk`` bytes, and a token belongs to the range that its last byte lies in. Each range yields a fragment: tokens up
to its first cut (the open prefix), closed groups, tokens after its last cut (the open suffix). Composing neighbours
closes the group that the left suffix and the right prefix make, or, where one has no cut, lengthens an open end. That
is associative, so the fragments of very long documents are composed in a tree, two neighbours at a time, by as many
Spark tasks as there are pairs; documents of one range are whole at once.

Texts are encoded by units (mostly a word with the space before it), between which both tokenizers end a token whatever
stands there: the one starts a new match of its pattern at white space after something else and at punctuation after a
letter, and no piece of the other holds a space or line break after anything else, or (else the finer cut is left out)
punctuation beside a letter. Each unit's ids and groups are worked out once by a worker.

Every row is a document of its own, repeated ones too, under a row number. Defined cases: null and empty texts, and
texts that either tokenizer's bytes do not give back (those with U+2581), have no tokens and zeros; an empty table gives
no rows; other columns are left out, but for ``doc_id``, which may be null."""

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.pieces import Vocabulary, parts, spread
from panelspark.llm.pieces import vocabulary as piece_vocabulary
from panelspark.llm.store import materialise

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
# Units that a worker remembers, and the rows of pair counts up to which that table is broadcast.
MOST_UNITS = 1 << 18
# New units that are worked out at once, and words that are put together for the one tokenizer.
AT_ONCE = 1 << 14
WORDS = 256
BROADCAST_ROWS = 1_000_000
# Links of a group up to which its pairs are listed one by one; ids of larger groups are counted first.
PLAIN_LINKS = 4096
# A line break between words, a word with the space before it, or a run of white space with the word after it; and
# letters before punctuation. An apostrophe is none: the one tokenizer's pattern may join it with letters.
UNIT = r"\n(?=\S)| ?\S+|\s+\S*"
LETTERS = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha()]
PUNCTUATION = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]
FRAGMENT = (
    "uid long, doc_id {doc_id}, chunk long, n_chunks long, n_a long, n_b long, n_groups long, cut boolean, "
    "a_open array<int>, b_open array<int>, groups string, pairs map<long,long>, a_rest array<int>, b_rest array<int>"
)
_loaded: dict[tuple[str, str], "Aligner"] = {}


NONE = np.zeros(0, np.int64)
NOTHING = {
    "n_groups": 0, "cut": True, "groups": "", "keys": NONE, "many": NONE,
    "a_open": NONE, "b_open": NONE, "a_rest": NONE, "b_rest": NONE,
}


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in
    order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def key_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def counted_pairs(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ids that share a group, and how many occurrences each has, from ids with group numbers. Ids are
    counted inside their groups first, so a group of many equal ids makes one pair."""
    ga, na = np.unique(key_of(a_group, a), return_counts=True)
    gb, nb = np.unique(key_of(b_group, b), return_counts=True)
    first, size = np.searchsorted(gb >> 32, ga >> 32), np.bincount(gb >> 32, minlength=1)
    many = np.zeros(len(ga), np.int64)
    held = (ga >> 32) < len(size)
    many[held] = size[ga[held] >> 32]
    other = spread(first, many)
    key = ((ga & 0xFFFFFFFF).repeat(many) << 32) | (gb[other] & 0xFFFFFFFF)
    keys, place = np.unique(key, return_inverse=True)
    return keys, np.bincount(place, weights=na.repeat(many) * nb[other], minlength=len(keys)).astype(np.int64)


def rendered(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, groups: int) -> str:
    """``a1,a2|b1;a3|b2,b3`` of groups numbered from 0 on."""
    a_upto, b_upto = np.searchsorted(a_group, np.arange(groups + 1)), np.searchsorted(b_group, np.arange(groups + 1))
    a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
    return ";".join(
        ",".join(a_text[a_upto[g] : a_upto[g + 1]]) + "|" + ",".join(b_text[b_upto[g] : b_upto[g + 1]]) for g in range(groups)
    )


def fragment(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, first: bool) -> dict[str, object]:
    """The fragment of the tokens of one range; the start of a text is a cut before the ``first`` range."""
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    skip = 0 if first else 1
    n = max(len(cuts) - skip, 0)
    a_in, b_in = (a_group >= skip) & (a_group < len(cuts)), (b_group >= skip) & (b_group < len(cuts))
    keys, many = counted_pairs(a[a_in], b[b_in], a_group[a_in], b_group[b_in])
    cut = first or len(cuts) > 0
    a_open, b_open = (a_group < skip) & ~a_in, (b_group < skip) & ~b_in
    return {
        "n_groups": n, "cut": cut, "a_open": a[a_open], "b_open": b[b_open], "keys": keys, "many": many,
        "groups": rendered(a[a_in], b[b_in], a_group[a_in] - skip, b_group[b_in] - skip, n),
        "a_rest": a[~a_in & ~a_open], "b_rest": b[~b_in & ~b_open],
    }


class Aligner:
    """Both vocabularies and the table of units that a worker has met: ids, byte ends, groups and pairs of each."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte = byte_of_character()
        vocabulary = json.loads(Path(a_path).read_text())["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b: Vocabulary = piece_vocabulary(b_path)
        self.a_width = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        group = self.b.group
        self.unit = re.compile(UNIT)
        if not {group.get(c, c) for c in LETTERS} & {group.get(c, c) for c in PUNCTUATION}:
            self.unit = re.compile(f" ?[{''.join(LETTERS)}]+(?=[{re.escape(''.join(PUNCTUATION))}])|{UNIT}")
        self.decimal = np.array([str(i) for i in range(max(len(self.a_width), len(self.b.width)))], dtype=object)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.true = np.zeros(0, bool)
        self.pairs = self.sizes = NONE
        self.n_groups = self.a_ids = self.b_ids = self.many = np.zeros(0, np.int32)
        self.a_upto = self.b_upto = self.pairs_upto = np.zeros(1, np.int64)

    def learn(self, units: list[str]) -> None:
        """Adds units to the table: all at once by byte offsets, and those with large groups or foreign bytes singly."""
        plain = [len(u) > 1 and u[0] == " " and not u[1].isspace() for u in units]
        units = [u for u, p in zip(units, plain, strict=True) if p] + [u for u, p in zip(units, plain, strict=True) if not p]
        raw = [u.encode() for u in units]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        a, n_a = self.encode_a(units, size, sum(plain))
        b, n_b = self.b.encode_inner(units)
        b = b.astype(np.int64)
        a_upto, b_upto = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        alike = (np.bincount(unit_a, self.a_width[a], len(units)) == size) & (np.bincount(unit_b, self.b.width[b], len(units)) == size)
        if not alike.all() or b"".join([self.a_bytes[i] for i in a.tolist()]) != (whole := b"".join(raw)) or (
            b"".join([self.b.surface[i] for i in b.tolist()]) != whole
        ):
            for k in np.flatnonzero(alike).tolist():
                own = [self.a_bytes[i] for i in a[a_upto[k] : a_upto[k + 1]].tolist()]
                other = [self.b.surface[i] for i in b[b_upto[k] : b_upto[k + 1]].tolist()]
                alike[k] = b"".join(own) == raw[k] and b"".join(other) == raw[k]
        good_a, good_b = alike[unit_a], alike[unit_b]
        kept = np.flatnonzero(alike)
        said, n_groups, keys, many, n_pairs = self.grouped(a[good_a], b[good_b], n_a[kept], n_b[kept], size[kept])
        texts, groups, counts = [""] * len(units), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        for k, text in zip(kept.tolist(), said, strict=True):
            texts[k] = text
        groups[kept], counts[kept] = n_groups, n_pairs
        first = len(self.groups)
        self.index.update(zip(units, range(first, first + len(units)), strict=True))
        self.groups += texts
        join, small = np.concatenate, np.int32
        self.true, self.sizes = join([self.true, alike]), join([self.sizes, size])
        self.n_groups = join([self.n_groups, groups.astype(small)])
        self.a_ids, self.b_ids = join([self.a_ids, a.astype(small)]), join([self.b_ids, b.astype(small)])
        self.a_upto, self.b_upto = join([self.a_upto, self.a_upto[-1] + a_upto[1:]]), join([self.b_upto, self.b_upto[-1] + b_upto[1:]])
        self.pairs, self.many = join([self.pairs, keys]), join([self.many, many.astype(small)])
        self.pairs_upto = join([self.pairs_upto, self.pairs_upto[-1] + np.cumsum(counts)])

    def encode_a(self, units: list[str], size: np.ndarray, plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number per unit. The first ``plain`` units are words after a space: these are put
        together into longer texts, where tokens end between them, and told apart by their bytes."""
        first = range(0, plain, WORDS)
        texts = ["".join(units[k : min(k + WORDS, plain)]) for k in first] + units[plain:]
        ids = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        a = np.fromiter((i for x in ids for i in x), np.int64)
        joined = sum(map(len, ids[: len(first)]))
        last = np.searchsorted(np.cumsum(self.a_width[a[:joined]]), np.cumsum(size[:plain]), side="right")
        return a, np.concatenate([np.diff(last, prepend=0), np.array([len(x) for x in ids[len(first) :]], dtype=np.int64)]).astype(np.int64)

    def grouped(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size: np.ndarray):
        """Of units in a row, each with equal bytes on both sides: their groups as text, numbers of groups, pairs with
        their links, and numbers of pairs."""
        n = len(size)
        if not n:
            return [], NONE, NONE, NONE, NONE
        a_end, b_end = np.cumsum(self.a_width[a]), np.cumsum(self.b.width[b])
        in_a, in_b = np.zeros(a_end[-1] + 1, bool), np.zeros(a_end[-1] + 1, bool)
        in_a[a_end] = in_b[b_end] = True
        cut = in_a & in_b
        before = np.cumsum(cut) - cut
        a_group, b_group = before[a_end], before[b_end]
        total = int(cut.sum())
        of_a, of_b = np.bincount(a_group, minlength=total), np.bincount(b_group, minlength=total)
        unit_of = np.searchsorted(np.cumsum(size), np.flatnonzero(cut))
        n_groups = np.bincount(unit_of, minlength=n)
        # Texts: the tokens of a group in order, first the one side's, then the other's, each with the sign after it.
        a_from, b_from = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        a_place, b_place = np.arange(len(a)) + b_from[a_group], np.arange(len(b)) + (a_from + of_a)[b_group]
        words = np.full(2 * (len(a) + len(b)), ",", dtype=object)
        words[2 * a_place], words[2 * b_place] = self.decimal[a], self.decimal[b]
        words[2 * a_place[a_from + of_a - 1] + 1] = "|"
        words[2 * b_place[b_from + of_b - 1] + 1] = np.where(np.diff(unit_of, append=n) > 0, "\n", ";")
        said = "".join(words.tolist()).split("\n")[:-1]
        # Pairs: each token with all of its group, or counted ids where that is much.
        plain = of_a * of_b <= PLAIN_LINKS
        links = np.where(plain, of_b, 0)[a_group]
        keys = key_of(np.repeat(a, links), b[spread(b_from[a_group], links)])
        many, unit = np.ones(len(keys), np.int64), np.repeat(unit_of[a_group], links)
        for g in np.flatnonzero(~plain).tolist():
            x, y = a[a_from[g] : a_from[g] + of_a[g]], b[b_from[g] : b_from[g] + of_b[g]]
            more, often = counted_pairs(x, y, np.zeros(len(x), np.int64), np.zeros(len(y), np.int64))
            place = int(np.searchsorted(unit, unit_of[g], side="right"))
            keys, many = np.insert(keys, place, more), np.insert(many, place, often)
            unit = np.insert(unit, place, np.full(len(more), unit_of[g]))
        return said, n_groups, keys, many, np.bincount(unit, minlength=n)

    def numbers(self, units: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        except KeyError:
            new = [u for u in dict.fromkeys(units) if u not in self.index]
            for first in range(0, len(new), AT_ONCE):
                self.learn(new[first : first + AT_ONCE])
            return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def fragments(self, texts: list[str | None], chunk: int) -> Iterator[dict[str, object]]:
        """The fragments of all texts, in order; ``row`` says whose."""
        if len(self.index) > MOST_UNITS:
            self.forget()
        cut = [self.unit.findall(" " + t) if t else [] for t in texts]
        number = self.numbers([u for units in cut for u in units])
        bounds = np.cumsum([0] + [len(units) for units in cut])
        a_size, b_size, first = np.diff(self.a_upto), np.diff(self.b_upto), self.pairs_upto
        for row in range(len(texts)):
            own = number[bounds[row] : bounds[row + 1]]
            if not len(own) or not self.true[own].all():
                yield {"row": row, "chunk": 0, "n_chunks": 1, "n_a": 0, "n_b": 0} | NOTHING
                continue
            counts = {"row": row, "n_a": int(a_size[own].sum()), "n_b": int(b_size[own].sum())}
            length = int(self.sizes[own].sum())
            if length > chunk:
                yield from (counts | f for f in self.ranges(own, length, chunk))
                continue
            entries = spread(first[own], first[own + 1] - first[own])
            keys, many = self.pairs[entries], self.many[entries]
            order = np.argsort(keys)
            keys, many = keys[order], many[order]
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield counts | NOTHING | {
                "chunk": 0, "n_chunks": 1, "n_groups": int(self.n_groups[own].sum()),
                "groups": ";".join([self.groups[i] for i in own.tolist()]),
                "keys": keys[begins], "many": np.add.reduceat(many.astype(np.int64), begins),
            }

    def ranges(self, own: np.ndarray, length: int, chunk: int) -> Iterator[dict[str, object]]:
        a = self.a_ids[spread(self.a_upto[own], self.a_upto[own + 1] - self.a_upto[own])]
        b = self.b_ids[spread(self.b_upto[own], self.b_upto[own + 1] - self.b_upto[own])]
        a_end, b_end = np.cumsum(self.a_width[a]), np.cumsum(self.b.width[b])
        n = -(-length // chunk)
        a_cut, b_cut = (np.searchsorted(e, np.arange(n + 1) * chunk, side="right") for e in (a_end, b_end))
        for k in range(n):
            i, j = slice(a_cut[k], a_cut[k + 1]), slice(b_cut[k], b_cut[k + 1])
            yield fragment(a[i], a_end[i], b[j], b_end[j], k == 0) | {"chunk": k, "n_chunks": n}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def fragments(
    documents: DataFrame, chunk: int = CHUNK, a_path: str = BYTE_VOCABULARY, b_path: str = PIECE_VOCABULARY
) -> DataFrame:
    """A row per document and byte range: ``uid`` (the row's number), ``doc_id``, ``chunk`` of ``n_chunks``, the whole
    document's ``n_a`` and ``n_b``, and the fragment: closed ``groups`` as text, their number and ``pairs`` (key
    ``a << 32 | b`` to links), whether there is a ``cut``, ids of the open prefix (``a_open``, ``b_open``) and suffix
    (``a_rest``, ``b_rest``)."""
    ids = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        for batch in batches:
            for part in parts(batch, "text"):
                found = list(known.fragments(part.column("text").to_pylist(), chunk))
                rows = pa.array([f["row"] for f in found], pa.int64())
                keyed = [f["keys"] for f in found]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keyed])]).astype(np.int32)
                keys = pa.array(np.concatenate([NONE, *keyed]))
                many = pa.array(np.concatenate([NONE, *(f["many"] for f in found)]))
                columns = {
                    "uid": part.column("uid").take(rows), "doc_id": part.column("doc_id").take(rows),
                    **{n: pa.array([f[n] for f in found], pa.int64()) for n in ("chunk", "n_chunks", "n_a", "n_b", "n_groups")},
                    "cut": pa.array([f["cut"] for f in found], pa.bool_()),
                    **{n: pa.array([f[n] for f in found], ids) for n in ("a_open", "b_open")},
                    "groups": pa.array([f["groups"] for f in found], pa.string()),
                    "pairs": pa.MapArray.from_arrays(pa.array(offsets), keys, many),
                    **{n: pa.array([f[n] for f in found], ids) for n in ("a_rest", "b_rest")},
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return rows.mapInArrow(run, FRAGMENT.format(doc_id=documents.schema["doc_id"].dataType.simpleString()))


def closed_pairs(a: Column, b: Column) -> Column:
    """Entries (key, links) of the group of these ids; equal ids are counted first."""
    def count(ids: Column, x: Column) -> Column:
        return F.size(F.filter(ids, lambda z: z == x)).cast("long")

    key = lambda x, y: F.shiftleft(x.cast("long"), 32).bitwiseOR(y.cast("long"))
    return F.flatten(F.transform(F.array_distinct(a), lambda x: F.transform(
        F.array_distinct(b), lambda y: F.struct(key(x, y).alias("key"), (count(a, x) * count(b, y)).alias("value"))
    )))


def composed(left: Column, right: Column) -> Column:
    """The fragment of two neighbours."""
    a, b = F.concat(left["a_rest"], right["a_open"]), F.concat(left["b_rest"], right["b_open"])
    between = F.concat(F.array_join(a, ","), F.lit("|"), F.array_join(b, ","))
    both = left["cut"] & right["cut"]
    parts_ = F.filter(F.array(left["groups"], F.when(both, between), right["groups"]), lambda g: F.coalesce(g, F.lit("")) != "")
    closed = F.when(both, closed_pairs(a, b)).otherwise(F.array().cast("array<struct<key:bigint,value:bigint>>"))
    return F.struct(
        (left["n_groups"] + right["n_groups"] + both.cast("long")).alias("n_groups"),
        (left["cut"] | right["cut"]).alias("cut"),
        F.when(left["cut"], left["a_open"]).otherwise(F.concat(left["a_open"], right["a_open"])).alias("a_open"),
        F.when(left["cut"], left["b_open"]).otherwise(F.concat(left["b_open"], right["b_open"])).alias("b_open"),
        F.array_join(parts_, ";").alias("groups"),
        F.concat(left["pairs"], closed, right["pairs"]).alias("pairs"),
        F.when(right["cut"], right["a_rest"]).when(left["cut"], a).otherwise(F.array().cast("array<int>")).alias("a_rest"),
        F.when(right["cut"], right["b_rest"]).when(left["cut"], b).otherwise(F.array().cast("array<int>")).alias("b_rest"),
    )


def composed_documents(ranges: DataFrame) -> DataFrame:
    """Documents of several ranges: two neighbours become one in each round, until one fragment is left."""
    names = ["n_groups", "cut", "a_open", "b_open", "groups", "pairs", "a_rest", "b_rest"]
    most = ranges.agg(F.max("n_chunks")).first()[0] or 1
    level = ranges.withColumn("pairs", F.map_entries("pairs")).select(
        "uid", "doc_id", "n_a", "n_b", "chunk", F.struct(*names).alias("part")
    )
    for _ in range((most - 1).bit_length()):
        pair = F.array_sort(F.collect_list(F.struct("chunk", "part")))
        level = level.groupBy("uid", "doc_id", "n_a", "n_b", F.shiftright("chunk", 1).alias("next")).agg(pair.alias("two"))
        one = F.col("two")[0]["part"]
        level = level.select(
            "uid", "doc_id", "n_a", "n_b", F.col("next").alias("chunk"),
            F.when(F.size("two") == 1, one).otherwise(composed(one, F.try_element_at("two", F.lit(2))["part"])).alias("part"),
        )
    entries = level.select("uid", F.explode("part.pairs").alias("e"))
    summed = entries.groupBy("uid", F.col("e.key").alias("key")).agg(F.sum("e.value").alias("value"))
    pairs = summed.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("pairs"))
    whole = level.select("uid", "doc_id", "n_a", "n_b", "part.n_groups", "part.groups")
    return whole.join(pairs, "uid")


def alignments(
    documents: DataFrame, chunk: int = CHUNK, a_path: str = BYTE_VOCABULARY, b_path: str = PIECE_VOCABULARY,
    told: Callable[[Column], Column] = lambda groups: groups,
) -> DataFrame:
    """One stored row per document: ``uid``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``groups`` and ``pairs`` (each
    linked pair ``a << 32 | b`` with its links). ``told`` may shorten the text of the groups before it is stored."""
    shown = F.when(F.col("n_chunks") == 1, told(F.col("groups"))).otherwise(F.col("groups"))
    stored = materialise(fragments(documents, chunk, a_path, b_path).withColumn("groups", shown), "fragments")
    kept = ["uid", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"]
    several = composed_documents(stored.where("n_chunks > 1")).withColumn("groups", told(F.col("groups")))
    return stored.where("n_chunks = 1").select(*kept).unionByName(several.select(*kept))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked pair ``key``: ``n_docs`` that hold it, and whether that is the most of any pair of its first id
    (``best``)."""
    counts = aligned.select(F.explode("pairs").alias("key", "links")).groupBy("key").agg(F.count("*").alias("n_docs"))
    counts = materialise(counts, "paircounts")
    most = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", F.shiftright("key", 32)).join(most, "a").select(
        "key", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")
    )


def scored_links(aligned: DataFrame) -> DataFrame:
    """Per document ``n_links``, ``n_best`` (links whose pair is the most frequent one of its first id) and
    ``count_sum`` (documents of the pair, summed over links), beside the alignment's counts and groups."""
    counts = materialise(pair_counts(aligned), "pairscores")
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    own = ["uid", "doc_id", "n_a", "n_b", "n_groups", "groups"]
    links = aligned.select(*own, F.explode_outer("pairs").alias("key", "links")).join(counts, "key", "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return links.groupBy(*own).agg(
        total(F.col("links")).alias("n_links"), total(F.when(F.col("best"), F.col("links"))).alias("n_best"),
        total(F.col("links") * F.col("n_docs")).alias("count_sum"),
    )
