"""Exact SentencePiece encoding of merge-type (BPE) vocabularies, and decoding.

A text is encoded left to right. At each place the longest piece found there by an Aho-Corasick automaton is tried
first. A piece may follow its left neighbour only if the two are compatible: merging the characters of both by the
vocabulary's scores must give exactly these two pieces back. If no piece fits, the place is marked as failed in a
bitfield, the last piece is taken back and its next shorter prefix is tried, so every place fails at most once. A
sequence whose neighbours are all compatible is the one that the merges of the whole text make, because the order of
merges (score, then place) inside two neighbours does not depend on the rest of the text.

No merge spans two neighbouring characters that no piece holds side by side. Characters that pieces hold side by side
are grouped (connected components, without the space), and texts are cut between characters of different groups and
before spaces into units: mostly words with the space before them, and punctuation. A unit that a worker has met before
is looked up. Groups come from the vocabulary; where pieces have inner spaces, a text is one unit.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 in a text encodes like a space and
decodes to one, as the library does it; characters without a piece become their UTF-8 bytes; repeated rows are encoded
each; other columns are kept (an existing ``ids`` or ``decoded`` is replaced); an empty table gives no rows. Only the
vocabulary (pieces, scores, kinds) is read through the library. Models of another kind, with a normaliser that changes
texts, or without byte pieces are refused.
"""

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Bounds of what a worker remembers: units with their ids, and compatible pairs.
MOST_UNITS = 1 << 19
MOST_PAIRS = 1 << 19
# Text per output batch.
PART = 1 << 21
# A text that only an identity normaliser and byte pieces give back.
PROBE = " Å  ﬁ\n\t́a \U0001f9ff "
_loaded: dict[str, "Vocabulary"] = {}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, ..., start + size - 1`` of all stretches in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Vocabulary:
    """Pieces with a space for U+2581, their scores, and which of them merging can make at all."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.decode(model.encode(PROBE)) != PROBE:
            raise ValueError(f"{path}: only models that keep every text as it is can be read")
        size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.pieces = [model.id_to_piece(i).replace(SPACE, " ") for i in range(size)]
        self.score = {p: model.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        surface = [b"" if model.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        surface[model.unk_id()] = " ⁇ ".encode()
        for value, i in self.byte.items():
            surface[i] = bytes([value])
        self.surface = surface
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        self.is_control = np.array([model.is_control(i) for i in range(size)])
        self.is_normal = ~np.array(special)
        self.width = np.array([len(s) for s in surface], dtype=np.int64)
        self.at = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(surface), dtype=np.uint8)

        made = {p for p in self.id if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in made:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.prefixes = {p: (p, *(p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in made)) for p in made}
        self.units = self.unit_pattern()
        self.fit: dict[str, dict[str, bool]] = {}
        self.n_fit = 0
        self.forget()

    def unit_pattern(self) -> re.Pattern[str]:
        """Finds units: spaces and characters of one group after them, or a character of no group."""
        long = [p for p in self.id if len(p) > 1]
        self.group: dict[str, str] = {}
        if any(" " in p.lstrip(" ") for p in long):
            return re.compile(".+", re.DOTALL)
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                group[c] = c = group[group[c]]
            return c

        for p in long:
            for c in p.lstrip(" "):
                group[root(c)] = root(p[-1])
        members: dict[str, list[str]] = {}
        for c in sorted(group):
            members.setdefault(root(c), []).append(c)
        self.group = {c: root(c) for c in group}
        sets = sorted((m for r, m in members.items() if r != " "), key=len, reverse=True)
        return re.compile("|".join([*(f" *[{re.escape(''.join(m))}]+" for m in sets), " +", "."]), re.DOTALL)

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q")

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for short texts: of the neighbours that make a piece those of the best score, the
        leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, place = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, place = s, i
            if place < 0:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the merges leave these neighbours as they are."""
        if self.n_fit >= MOST_PAIRS:
            self.fit.clear()
            self.n_fit = 0
        self.n_fit += 1
        known = self.fit.setdefault(left, {})[right] = self.merged(left + right) == [left, right]
        return known

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit. A character that is no piece stands for itself."""
        n = len(unit)
        longest = list(unit)
        for end, piece in self.automaton.iter(unit):
            longest[end - len(piece) + 1] = piece
        longest.append("")
        failed, prefixes, none = bytearray(n + 1), self.prefixes, {}
        out: list[str] = []
        place, piece = 0, longest[0]
        while place < n:
            last = out[-1] if out else None
            near = self.fit.get(last, none)
            for shorter in prefixes.get(piece) or (piece,):
                known = near.get(shorter) if out else True
                if (known or (known is None and self.fits(last, shorter))) and not failed[place + len(shorter)]:
                    out.append(shorter)
                    place += len(shorter)
                    piece = longest[place]
                    break
            else:
                failed[place] = 1
                if not out:
                    raise ValueError("no encoding: the vocabulary's merges contradict each other")
                piece = out.pop()
                place -= len(piece)
        return out

    def encode_unit(self, unit: str) -> list[int]:
        found = self.split(unit)
        try:
            return [self.id[p] for p in found]
        except KeyError:
            return [i for p in found for i in ([self.id[p]] if p in self.id else [self.byte[b] for b in p.encode()])]

    def units_of(self, text: str) -> list[str]:
        """The units of a text, with the space that the library puts before it."""
        return self.units.findall(" " + text.replace(SPACE, " ")) if text else []

    def numbers(self, units: list[str]) -> np.ndarray:
        """Each unit's number in the table of units met so far."""
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, units), np.int64, len(units))
        except KeyError:
            for u in units:
                if u not in index:
                    self.flat.extend(self.encode_unit(u))
                    index[u] = len(self.ends)
                    self.ends.append(len(self.flat))
            return np.fromiter(map(index.__getitem__, units), np.int64, len(units))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and the number of ids of each text."""
        return self.encode_cut([self.units_of(t or "") for t in texts])

    def encode_inner(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for stretches inside a text, without a space before each, and without remembering units."""
        split = [[self.encode_unit(u) for u in self.units.findall(t.replace(SPACE, " "))] for t in texts]
        ids = np.fromiter((i for units in split for unit in units for i in unit), np.int32)
        return ids, np.array([sum(map(len, units)) for units in split], dtype=np.int64)

    def encode_cut(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > MOST_UNITS:
            self.forget()
        number = self.numbers([u for units in cut for u in units])
        ends = np.array(self.ends, dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sizes = (ends - starts)[number] if len(ends) else np.zeros(0, np.int64)
        ids = np.array(self.flat, dtype=np.int32)[spread(starts[number], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.cumsum([0] + [len(units) for units in cut])
        return ids, np.diff(upto[bounds])

    def decode(self, ids: np.ndarray) -> str:
        """One text, as the library's ``decode`` gives it for ids of the vocabulary: control ids say nothing, but end
        a row of byte pieces; the first piece that says anything loses one leading space."""
        silent = self.is_control[ids]
        if silent.any():
            first = int(np.argmin(silent))
            runs = np.split(ids[first:], np.flatnonzero(silent[first:])) if not silent[first] else []
            return "".join(self.surfaces(run, k == 0) for k, run in enumerate(runs))
        return self.surfaces(ids, True)

    def surfaces(self, ids: np.ndarray, first: bool) -> str:
        raw = self.bytes[spread(self.at[ids], self.width[ids])].tobytes()
        if first and len(ids) and self.is_normal[ids[0]] and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return lenient(raw)


def lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that begins no character."""
    out, place = [], 0
    while place < len(raw):
        try:
            out.append(raw[place:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[place : place + e.start].decode() + "�")
            place += e.start + 1
    return "".join(out)


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about ``PART`` bytes of ``column`` each."""
    rows = max(1, int(len(batch) * PART / max(batch.column(column).nbytes, 1)))
    for first in range(0, len(batch), rows):
        yield batch.slice(first, rows)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], names=[*names, name])


def encode(documents: DataFrame, path: str = VOCABULARY, column: str = "text") -> DataFrame:
    """All columns and ``ids`` (array of int): the whole text's ids, without begin or end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part in parts(batch, column):
                ids, counts = known.encode(part.column(column).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield with_column(part, "ids", pa.ListArray.from_arrays(offsets, pa.array(ids)))

    kept = documents.drop("ids")
    return kept.mapInArrow(run, kept.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, column: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the text of the ids. Null ids have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part in parts(batch, column):
                lists = part.column(column)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = [known.decode(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []
                yield with_column(part, "decoded", pa.array(texts, pa.string()))

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit(None).cast("string")).schema)
