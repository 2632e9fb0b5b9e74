"""Cross-tokenizer alignment, exact SentencePiece encoding and periodic runs against brute force and the library."""

import hashlib
import json
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import crosstoken, periodic, pieces, queries

SIGNS = ["a", "b", " ", "  ", "e", "\n", "▁", "é", "th", "in", ".", ",", "'s", "1", "😀", "中文", "\t", "\x00", "<0x41>", "<s>",
         "ment", "-", "$$$", " ", "<|endoftext|>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mixed(rng, most):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randrange(most)))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    texts = [None, "", " ", "\n", "▁", " a", "a ", "x" * 30_000, " " * 5_000 + "a", "the " * 9_000, "=" * 3_000]
    texts += [mixed(rng, 60) for _ in range(300)] + ["the and", "the and"]
    rows = [(i if i != 7 else None, t, "mine", 1) for i, t in enumerate(texts)]
    rows += rows[20:25]
    return spark.createDataFrame(rows, "doc_id long, text string, decoded string, uid long")


# ---- 12 SentencePiece

def test_encoding_and_decoding_equal_the_library(spark, odd, library):
    out = pieces.decode(pieces.encode(odd)).collect()
    assert len(out) == odd.count()
    for row in out:
        want = library.encode(row.text or "")
        assert row.ids == want and row.decoded == library.decode(want) and row.uid == 1
    assert pieces.decode(pieces.encode(odd.where("false"))).count() == 0


def test_decoding_of_any_ids_equals_the_library(library):
    known, rng = pieces.Vocabulary(pieces.VOCABULARY), random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, 13, rng.randrange(3, 259), rng.randrange(32_000), 259]) for _ in range(rng.randrange(7))]
        assert known.decode(np.array(ids, dtype=np.int64)) == library.decode(ids), ids


def test_whole_texts_as_one_unit_give_the_same_ids(library):
    known, rng = pieces.Vocabulary(pieces.VOCABULARY), random.Random(3)
    known.units = re.compile(".+", re.DOTALL)
    texts = [mixed(rng, 80) for _ in range(500)] + ["ab" * 4000, "tttthhhheeee" * 300]
    for text in texts:
        assert known.encode([text])[0].tolist() == library.encode(text)


def test_a_full_table_of_units_is_forgotten(library, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_UNITS", 3)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 2)
    known = pieces.Vocabulary(pieces.VOCABULARY)
    for text in ["stretching words over units", "other words there", "and more again"]:
        assert known.encode([text])[0].tolist() == library.encode(text)


def test_op12_on_all_documents(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in queries.op12_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[row.doc_id] or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == sha(",".join(map(str, ids)))
        assert row.decoded_sha256 == sha(library.decode(ids))


# ---- 11 cross-tokenizer alignment

class ByHand:
    def __init__(self, library):
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(crosstoken.BYTE_VOCABULARY), library
        self.a.encode_special_tokens = True
        byte = crosstoken.byte_of_character()
        vocabulary = json.loads(Path(crosstoken.BYTE_VOCABULARY).read_text())["model"]["vocab"]
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if all(c in byte for c in t)}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def align(self, text):
        if not text:
            return None
        raw, a, b = (" " + text).encode(), self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            return None
        ends = [np.cumsum([len(t) for t in z]).tolist() for z in (x, y)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [defaultdict(list), defaultdict(list)]
        for side, ids in enumerate((a, b)):
            for i, end in zip(ids, ends[side], strict=True):
                groups[side][bisect_left(cuts, end)].append(i)
        links = Counter((p, q) for g in groups[0] for p in groups[0][g] for q in groups[1][g])
        said = ";".join(",".join(map(str, groups[0][g])) + "|" + ",".join(map(str, groups[1][g])) for g in range(len(cuts)))
        return len(a), len(b), len(cuts), said, links

    def corpus(self, texts):
        found = [self.align(t) for t in texts]
        held = Counter(pair for f in found if f for pair in f[4])
        most = defaultdict(int)
        for (p, _), n in held.items():
            most[p] = max(most[p], n)
        return [(0, 0, 0, "", 0, 0, 0) if not f else (
            *f[:4], sum(f[4].values()), sum(m for k, m in f[4].items() if held[k] == most[k[0]]),
            sum(m * held[k] for k, m in f[4].items()),
        ) for f in found]


@pytest.mark.parametrize("chunk", [1 << 16, 37])
def test_alignments_equal_brute_force_for_any_range_size(spark, odd, library, chunk):
    short = odd.where("text is null or length(text) < 6000")
    rows = short.collect()
    scored = crosstoken.scored_links(crosstoken.alignments(short, chunk=chunk)).collect()
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups, r.n_links, r.n_best, r.count_sum) for r in scored)
    want = ByHand(library).corpus([r.text for r in rows])
    assert got == Counter((r.doc_id, *w) for r, w in zip(rows, want, strict=True))


def test_fragments_compose_in_any_order(spark, odd):
    """Composition is associative: three neighbours, bracketed either way."""
    from pyspark.sql import Window

    names = ["n_groups", "cut", "a_open", "b_open", "groups", "pairs", "a_rest", "b_rest"]
    parts = crosstoken.fragments(odd, chunk=5).withColumn("pairs", F.map_entries("pairs"))
    near = Window.partitionBy("uid").orderBy("chunk")
    three = parts.withColumn("x", F.struct(*names)).withColumns({"y": F.lead("x").over(near), "z": F.lead("x", 2).over(near)})
    c = crosstoken.composed
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    both = three.where("z is not null").select(c(c(x, y), z).alias("left"), c(x, c(y, z)).alias("right"))
    assert both.count() > 100 and both.where("left <> right").count() == 0


def test_pairs_of_a_large_group_are_counted():
    a, b = np.array([5] * 300 + [6]), np.array([9] * 200)
    keys, many = crosstoken.counted_pairs(a, b, np.zeros(301, np.int64), np.zeros(200, np.int64))
    assert dict(zip(keys.tolist(), many.tolist(), strict=True)) == {5 << 32 | 9: 60_000, 6 << 32 | 9: 200}


def test_shuffled_and_broadcast_pair_counts_agree(spark, odd, monkeypatch):
    aligned = crosstoken.alignments(odd)
    one = crosstoken.scored_links(aligned).orderBy("uid").collect()
    monkeypatch.setattr(crosstoken, "BROADCAST_ROWS", 1)
    assert one == crosstoken.scored_links(aligned).orderBy("uid").collect()
    assert crosstoken.scored_links(crosstoken.alignments(odd.where("false"))).count() == 0


def test_op11_on_all_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], ByHand(library).corpus([r.text for r in docs]), strict=True))
    for r in queries.op11_cross_tokenizer(spark, "/root/testdata/sf0.001").collect():
        a, b, n, said, links, best, total = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (a, b, n, links, best, total)
        assert r.groups_sha256 == (sha(said) if said else "")


# ---- 13 periodic runs

def runs_by_hand(words, least, times):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if (length := i - start + q) >= max(least, times * q):
                out.setdefault((start, length), q)
            i += 1
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    words = []
    for _ in range(rng.randrange(5)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, rng.choice([3, 6, 20])))]
        words += (unit * rng.choice([0, 1, 2, 3, 4, 8]) + unit[: rng.randrange(len(unit))]) * rng.choice([1, 1, 2, 4])
        words += [rng.randrange(100) for _ in range(rng.randrange(10))]
    return words


def test_runs_equal_brute_force():
    rng, found = random.Random(7), 0
    for _ in range(1500):
        texts = [periodic_words(rng) for _ in range(rng.randrange(1, 4))]
        least, times = rng.choice([(24, 3), (6, 3), (1, 3), (10, 4)])
        word = np.array([w for t in texts for w in t], dtype=np.uint64)
        got = periodic.Catchers(word, np.array([len(t) for t in texts]), least, times).run()
        want = [runs_by_hand(t, least, times) for t in texts]
        assert got == want
        found += sum(map(len, want))
    assert found > 2000


def test_runs_of_long_words_of_few_letters():
    for unit, n in (([0], 1), ([1, 2, 3, 4, 5], 5)):
        word = np.array(unit * (200_000 // n), dtype=np.uint64)
        assert periodic.Catchers(word, np.array([len(word)]), 24, 3).run() == [[(0, len(word), n)]]
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic.Catchers(np.array(b, dtype=np.uint64), np.array([len(b)]), 24, 3).run()[0] == runs_by_hand(b, 24, 3)


def test_equal_hashes_of_other_words_are_found_out(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)] + ["a", "b"] * 20
    assert periodic.runs_of([w.encode() for w in words], 24, 3) == [(40, 40, 2)]


def test_awkward_texts_have_runs(spark):
    line = "\n".join(["one line of six words here"] * 9)
    texts = [None, "", " \n\t", "a b c", line, line, "x " * 50_000]
    df = spark.createDataFrame([(i if i != 3 else None, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    out = [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.with_runs(df).collect()]
    assert out[:3] == [(0, [], "")] * 3 and out[3] == (3, [], "a b c")
    assert out[4] == out[5] == (54, [(0, 54, 6)], "one line of six words here")
    assert out[6] == (50_000, [(0, 50_000, 1)], "x")
    assert periodic.with_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="times"):
        periodic.with_runs(df, times=2)


def test_op13_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    with_one = 0
    for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(words, 24, 3)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
        with_one += bool(runs)
    assert with_one > 10


# ---- 5: which texts have a letter

def test_signs_that_are_no_letters_have_no_language(spark):
    from panelspark.llm.langid import language_digest

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "½ ² Ⅷ 12", "en"), (-2, "_ 3", "en"), (-3, None, "en"), (-4, "½ the", "en")], "doc_id long, text string, lang string")
    said = {r.doc_id: r.lang_pred for r in language_digest(docs.unionByName(odd)).where("doc_id < 0").collect()}
    assert said[-1] == said[-2] == said[-3] == "und" and said[-4] != "und"
