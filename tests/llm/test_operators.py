"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm import (
    chat, decontaminate, jaccard, langid, licenses, linededup, mixing, quality, substring, tokencounts,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = ["of", "the", "tion", "erhe", "inand", "ou", "nt", "ÉA", "re", "Stand", "x1", "lyre", "ther", "shon", "ble", "hati"]


def docs_of(spark, texts, lang="en", source="s", first=0):
    rows = [(first + i, t, lang, source, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))


def awkward(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and a column that clashes with results."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [(1, None, None, None), (None, "a b c", "en", None), (2, "", "en", "s"), (3, long, "en", "s"), (3, long, "en", "s"),
            (4, "one line of text that is long enough\n" * 3, None, "t"), (4, "one line of text that is long enough\n" * 3, None, "t"),
            (5, "x" * 70_000, "fr", "t"), (6, "\n\n \t", "fr", "t"), (7, "12 34 ++", "fr", "u"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("slot", F.lit("mine")).withColumn("kept", F.lit(1))


# ---- 1 decontamination

def words13(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated_by_hand(docs, bench):
    wins = {}
    for item, t in bench:
        w = words13(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for d, t in docs:
        w, hit, items = words13(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    items |= wins[x]
        out[d] = (len(w), len(hit), sorted(items))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    bench = [(i, prose(rng, n)) for i, n in enumerate([30, 13, 12, 5, 2, 40])] + [(9, None), (10, ""), (11, "?!")]
    texts = [prose(rng, 60) for _ in range(20)] + [None, "", "é!", bench[3][1].upper(), "  " + bench[4][1] + "\n"]
    for i in range(12):
        item = words13(bench[rng.choice([0, 1, 2, 3, 5])][1])
        cut = rng.randrange(0, max(1, len(item) - 13))
        texts.append(prose(rng, 15) + ", " + "  ".join(item[cut : cut + rng.choice([12, 13, 20])]).upper() + "; " + prose(rng, 9))
    docs = docs_of(spark, texts)
    bench_df = spark.createDataFrame(bench, "item_id long, text string")
    for most in (1_000_000, 0):  # broadcast, and shuffled
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in
               decontaminate.contamination(docs, bench_df, most_broadcast=most).collect()}
        assert got == contaminated_by_hand(list(enumerate(texts)), bench)


def test_decontamination_removes_documents_or_spans(spark):
    rng = random.Random(2)
    item = prose(rng, 14)
    docs = docs_of(spark, [f"Before this. {item}! After it", prose(rng, 30)])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [1]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert spans[0] == "Before this. After it" and len(spans) == 2
    none = decontaminate.decontaminate(awkward(spark), bench.limit(0))
    assert none.count() == 11 and none.columns == awkward(spark).columns


# ---- 2 mixing

@pytest.mark.parametrize("weights", [
    {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 1, "b": 2}, {"a": 1 / 3, "b": 2 / 3}, {"a": 1e-5, "b": 1 - 1e-5},
    {"a": 2**0.5, "b": 3**0.5, "c": 0.01, "d": Fraction(1, 7)}, {"a": 899, **{f"s{i}": 1 for i in range(899)}},
])
def test_pfair_windows_and_deviation(weights):
    """Against the targets as given, not against rounded ones."""
    whole = mixing.whole_weights(weights)
    total, n = sum(whole.values()), 300_000 if len(weights) < 10 else 5_000
    exact = {s: Fraction(w) for s, w in weights.items()}
    assert all(abs(Fraction(whole[s], total) - exact[s] / sum(exact.values())) < Fraction(1, 10**14) for s in weights)
    slots = mixing.pfair_slots(whole, n)
    assert sorted(sum(slots.values(), [])) == list(range(n))
    for s, at in slots.items():
        w = exact[s] / sum(exact.values())
        for j, slot in enumerate(at):  # deviation is largest right before and right after a block
            assert j * total // whole[s] <= slot < -(-(j + 1) * total // whole[s])
            assert j - slot * w > -1 and j + 1 - (slot + 1) * w < 1
        assert len(at) - n * w > -1


def test_phases_by_arithmetic_equal_the_schedule_slot_by_slot():
    rng = random.Random(21)
    for _ in range(30):
        weights = {s: rng.choice([1, 2, 3, 7, 50, 997]) for s in "abcd"[: rng.randrange(1, 5)]}
        blocks = {s: rng.randrange(1, 90) for s in weights}
        got, start = {}, 0
        for p in mixing.plan_phases(blocks, weights):
            for b in range(p["first"], p["last"] + 1):
                j = b - p["first"]
                got[(p["source"], b)] = p["start"] + j // p["share"] * p["cycle"] + p["places"][j % p["share"]]
        want, left = {}, dict(blocks)
        while active := {s: weights[s] for s in weights if left[s]}:  # plain: one phase after the other, slot by slot
            slots = mixing.pfair_slots(active, sum(left.values()))
            end = min(slots[s][left[s] - 1] for s in active if left[s] <= len(slots[s])) + 1
            for s in active:
                for x in [x for x in slots[s] if x < end]:
                    want[(s, blocks[s] - left[s])] = start + x
                    left[s] -= 1
            start += end
        assert got == want and sorted(got.values()) == list(range(sum(blocks.values())))


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1, "c": 1}])
def test_mixing_places_every_document_in_its_window(spark, weights):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(0, 60), "en", rng.choice("aaaaabbc"), 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(docs, weights, block=100, parts=40, bucket_rows=32).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(600))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    blocks = {(r["source"], r["block"]): r["slot"] for r in out}
    assert len(set(blocks.values())) == len(blocks)  # one block a slot
    size = defaultdict(int)
    for r in out:
        size[(r["source"], r["block"])] += len(r["text"])
    assert max(size.values()) < 100 + 60
    if weights:  # until the first source ends, each is less than a block from its share
        ends = min(max(s for (x, _), s in blocks.items() if x == y) for y in "abc")
        for t in range(1, ends):
            for s, w in zip("abc", (0.6, 0.2, 0.2), strict=True):
                assert abs(sum(1 for (x, _), slot in blocks.items() if x == s and slot < t) - w * t) < 1 + 1e-9


def test_mixing_keeps_columns_with_clashing_names(spark):
    names = ["_source", "_hash", "_bucket", "of", "row", "hash", "size", "rank", "base", "offset", "most", "bucket"]
    docs = docs_of(spark, ["x" * 50] * 20).withColumns({c: F.lit("mine") for c in names})
    out = mixing.mix_sources(docs, block=100)
    assert out.columns == [*docs.columns, *mixing.PLACED]
    assert all(r[c] == "mine" for r in out.collect() for c in names)


def test_mixing_many_sources(spark):
    rows = [(i, "x" * 40, "en", f"s{i % 400}", 0) for i in range(1200)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS), {f"s{i}": 1 + i for i in range(400)}, block=40).collect()
    assert sorted(r["slot"] for r in out) == list(range(1200)) and all(r["release"] <= r["slot"] < r["deadline"] for r in out)


# ---- 3 quality

def base_by_hand(text):
    text = text or ""
    words = WS.findall(text)
    lines = [x for x in text.split("\n") if WS.search(x)]
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "one", "a\n\na\n \nb\r\na", "\x0b\x0c x\ty\r\n", "é #b| c"]
    for _ in range(40):
        piece = prose(rng, rng.choice([5, 8, 9, 30]))
        texts.append(rng.choice(["\n", " ", "\n\n"]).join([piece, prose(rng, 12), piece, rng.choice(["## **", "é|é", ""])]))
    texts.append(" ".join(rng.choice("ab") for _ in range(5000)))
    got = {r["doc_id"]: tuple(r[c] for c in quality.COUNTS) for r in quality.judge(docs_of(spark, texts)).collect()}
    assert got == {i: base_by_hand(t) for i, t in enumerate(texts)}


def test_quality_rejects_planted_outliers_only(spark):
    rng = random.Random(6)
    good = [prose(rng, rng.randrange(25, 400)) + ". " for _ in range(300)]
    junk = [" ".join(w.upper() + "### $$" for w in prose(rng, 80).split()) for _ in range(30)]
    out = quality.judge(docs_of(spark, good + junk), min_group=50).collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["doc_id"]) if not r["kept"]] == list(range(300, 330))
    again = quality.judge(docs_of(spark, good + junk).repartition(7), min_group=50).collect()
    assert {(r["doc_id"], r["kept"]) for r in out} == {(r["doc_id"], r["kept"]) for r in again}


def test_quality_survives_junk_near_half(spark):
    """Junk of 44 percent in one group does not become what is usual."""
    rng = random.Random(25)
    good = [prose(rng, rng.randrange(25, 400)) + ". " for _ in range(300)]
    junk = [" ".join(w.upper() + "### $$" for w in prose(rng, rng.randrange(60, 90)).split()) for _ in range(240)]
    out = quality.judge(docs_of(spark, good + junk), min_group=50).collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == set(range(300, 540))


def test_least_determinant_against_brute_force(spark):
    """As small a determinant as the best of many random subsets, each concentrated to its end over all rows."""
    rng = np.random.default_rng(26)
    rows, points = [], {}
    for g, bad in enumerate((0.0, 0.2, 0.4)):
        n = 90
        x = rng.normal(size=(n, quality.P)) @ np.tril(rng.normal(size=(quality.P, quality.P)))
        x[: int(bad * n)] += rng.normal(size=quality.P) * 6
        points[f"g{g}"] = x
        rows += [(g * n + i, f"g{g}", *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, _group string, " + ", ".join(f"{c} double" for c in quality.VECTOR))
    got = {r["_group"]: r for r in quality.estimates(df, 0.5, 6).collect()}
    for g, x in points.items():
        best = math.inf
        for _ in range(300):
            few = x[rng.choice(len(x), quality.P + 1, replace=False)]
            mu, prec, now = quality._solved(few.mean(axis=0), few.T @ few / len(few))
            for _ in range(20):
                mu, prec, now = quality.concentrated(x, mu, prec, 0.5)
            best = min(best, now)
        assert abs(got[g]["_logdet"] - best) < 0.15  # halves are taken to a bin, a row or two more


def test_quality_tail():
    assert abs(quality.chi2_beyond(0.05, 6) - 12.591587) < 1e-5
    assert abs(quality.chi2_beyond(0.5, 6) - 5.348121) < 1e-5


# ---- 4 chat

def test_chat_round_trip(spark):
    rng = random.Random(7)
    bits = ["<|im_end|>", "<|im_sep|>", "\\", "<", "|", "<|", "\n", "é", "a", "<\\|", "<|im_nl|>", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "a\nb<|", None]), text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df).withColumn("read", chat.read_turns(F.col("formatted")))
    out = out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want[c].append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(x) for x in r["read"]] for r in out} == want
    assert {r["conv_id"]: r["loss"] for r in out} == {c: "".join(x for r, x in ts if r == "assistant") for c, ts in want.items()}
    for r in out:
        runs = [x for i, x in enumerate(want[r["conv_id"]]) if i == 0 or want[r["conv_id"]][i - 1][0] != x[0]]
        assert r["n_blocks"] == len(runs) == r["formatted"].count("<|im_start|>")


# ---- 5 language

def test_language_held_out_accuracy_and_awkward_texts(spark):
    rng = random.Random(8)
    kinds = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["schl", "ung", "eich", "ü"], "cc": ["tion", "que", "é", "eau"]}
    rows = []
    for i in range(450):
        lang = "abc"[i % 3] * 2
        text = " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(rng.randrange(3, 60)))
        rows.append((i, text, lang if i % 7 else None))
    rows += [(900, None, "aa"), (901, "12 %", "aa"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language_digest(df, 64).collect()}
    sure = [got[i] for i in range(450) if got[i]["held_out"]]
    assert len(sure) > 100 and np.mean([r["lang_pred"] == "abc"[r["doc_id"] % 3] * 2 for r in sure]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert {r["lang_pred"] for r in langid.language_digest(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 6 lines

def lines_by_hand(docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    drop = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if drop.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def line_texts(rng, n):
    pool = [prose(rng, k) for k in (1, 2, 3, 4, 5, 6, 7, 8)] + ["É" * 19, "É" * 20, "a" * 19, "B" * 20]
    case = [str.upper, str.lower, str, lambda x: f" \t{x}\r"]
    return ["\n".join(rng.choice(case)(rng.choice(pool)) if rng.random() < 0.7 else prose(rng, 4) for _ in range(rng.randrange(0, 9)))
            for _ in range(n)] + [None, ""]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    texts = line_texts(rng, 60)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.line_digest(docs_of(spark, texts)).collect()}
    assert got == lines_by_hand(list(enumerate(texts)))


def test_line_state_is_reversible(spark, monkeypatch):
    """Counts, filters and what they drop after insertions and deletions are those of the documents that remain."""
    monkeypatch.setattr(linededup, "LEAST_SHARDS", 3)
    rng = random.Random(10)
    texts = line_texts(rng, 60)
    keys = linededup.document_keys(docs_of(spark, texts), 20).distinct().cache()
    one, two, three = (keys.where(c) for c in ("doc_id < 20", "doc_id BETWEEN 20 AND 39", "doc_id >= 40"))
    none = linededup.empty_state(spark, 0)
    first = linededup.inserted(none, one)
    both = linededup.inserted(first, two)
    whole = linededup.inserted(both, three)
    rows = lambda df: sorted(tuple(r) for r in df.collect())

    def held(state):  # how many fingerprints each shard's tables hold
        return {r["shard"]: n for r in state.filters.collect() if (n := sum(int((linededup.Cuckoo.from_bytes(b).table > 0).sum()) for b in r["bits"]))}

    cases = [(first, one), (both, one.unionByName(two)), (whole, keys), (linededup.deleted(whole, three, one.unionByName(two)), one.unionByName(two)),
             (linededup.deleted(both, two, one), one), (linededup.deleted(whole, one, two.unionByName(three)), two.unionByName(three))]
    for state, remain in cases:
        want = linededup.inserted(none, remain)
        assert rows(state.counts.select("k1", "k2", "n_docs", "keeper")) == rows(want.counts.select("k1", "k2", "n_docs", "keeper"))
        assert held(state) == held(want)
        assert rows(linededup.dropped_keys(remain, state)) == rows(linededup.dropped_keys(remain, want))
        frequent = state.counts.where("n_docs >= 3").select(F.lit(1).cast("long").alias("doc_id"), "k1", "k2")
        assert linededup.probe(frequent, state).count() == frequent.count()


def test_numbers_of_words_agree_with_their_lower_cased_bytes():
    """On both sides of a batch, also of a part of it; only A-Z are folded."""
    one = [["Ab", "aB", "ÄB", "äb", ""], [], ["K", "\u212a", "k", "x"]]
    two = [["ab", "Äb", "y"], ["X", "\u0130", "i"], []]
    arrays = [pa.array([["skipped"], *side], pa.list_(pa.string())).slice(1) for side in (one, two)]
    got = substring.numbered(*arrays)
    assert [[len(row) for row in side] for side in got] == [[len(row) for row in side] for side in (one, two)]
    pairs = {(w.encode().lower(), n) for side, own in zip((one, two), got) for row, held in zip(side, own) for w, n in zip(row, held)}
    assert len({w for w, _ in pairs}) == len({n for _, n in pairs}) == len(pairs)
    assert substring.numbered(*(a.slice(0, 0) for a in arrays)) == [[], []]


def test_cuckoo_filter_inserts_finds_and_deletes():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    held = linededup.Cuckoo.from_bytes(linededup.Cuckoo.build(k1, k2).to_bytes())
    assert held.lookup(k1, k2).all()
    assert held.lookup(*rng.integers(-(1 << 62), 1 << 62, (2, 20_000))).mean() < 0.005
    assert all(held.delete(int(a), int(b)) for a, b in zip(k1[:2500], k2[:2500], strict=True))
    assert held.lookup(k1[2500:], k2[2500:]).all() and held.lookup(k1[:2500], k2[:2500]).mean() < 0.01


# ---- 7 passages

def test_repeated_passages(spark):
    rng = random.Random(11)
    wide = lambda n: " ".join(f"{rng.choice(VOCAB)}{rng.randrange(3000)}" for _ in range(n))
    passage, fuzzy = wide(55), wide(90).split()
    changed = [("changed" if i % 15 == 7 else w) for i, w in enumerate(fuzzy)]
    texts = [wide(80) + " " + passage + " " + wide(30), wide(20) + "\n" + passage.upper() + " " + wide(9), passage,
             wide(40) + " " + " ".join(fuzzy) + " " + wide(7), " ".join(changed) + " " + wide(60), wide(300), wide(30) + wide(20),
             wide(12) + " " + " ".join(passage.split()[:30]) + " " + wide(60)]
    got = substring.repeated_passages(docs_of(spark, texts)).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    assert {x for p in pairs for x in p} == {0, 1, 2, 3, 4} and (4, 3) in pairs
    for r in got:
        if r["doc_id"] < 3:
            assert r["end"] - r["start"] == 55 and r["edits"] == 0
    fuzzy_row = next(r for r in got if r["doc_id"] == 4)
    assert 70 <= fuzzy_row["end"] - fuzzy_row["start"] <= 92 and 3 <= fuzzy_row["edits"] <= 6


@pytest.mark.parametrize("local_seen", [8, 1])
def test_interleaved_partial_holders_hide_no_passage(spark, monkeypatch, local_seen):
    """Full holders of a passage between holders of its halves: each seed's first and previous holder is a partial one."""
    monkeypatch.setattr(substring, "LOCAL_SEEN", local_seen)
    rng = random.Random(17)
    own = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    passage = own(60)
    parts = [passage[:42], passage[18:], passage[9:51], passage[:49], passage[11:]]
    texts = []
    for i in range(90):
        middle = passage if i % 6 == 5 else parts[i % 6]
        texts.append(own(20) + middle + own(20) + (middle if i < 12 else []) + own(9))
    texts = [" ".join(x) for x in texts]
    got = substring.repeated_passages(docs_of(spark, texts).repartition(3)).collect()
    covered = defaultdict(set)
    for r in got:
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
        covered[r["other_id"]].update(range(r["other_start"], r["other_end"]))
        assert r["end"] - r["start"] >= 50 and r["edits"] == 0
    windows, want = defaultdict(set), defaultdict(set)
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add((d, i))
    for at in windows.values():
        if len({d for d, _ in at}) > 1:
            for d, i in at:
                want[d].update(range(i, i + 50))
    assert len(want) == 15 and covered == want


def test_passages_do_not_depend_on_the_layout(spark, monkeypatch):
    """One answer for any partitioning, whether seeds are shuffled by salt or not; pairs of full holders between holders
    of halves; copies are told once."""
    rng = random.Random(22)
    own = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    texts = {}
    for g in range(10):
        first, second = own(30), own(30)
        for d, middle in {1: first, 7: first, 2: second, 8: second, 5: first + second, 9: first + second}.items():
            texts[100 * g + d] = " ".join(own(12) + middle + own(12))
    common = own(60)
    texts |= {2000 + i: " ".join(own(9) + common + own(9)) for i in range(120)}
    texts |= {3000: texts[5], 3001: texts[5], 3002: texts[1][:60]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [sorted(map(tuple, substring.repeated_passages(docs.repartition(n)).collect())) for n in (1, 40)]
    monkeypatch.setattr(substring, "CROWDED", 16)
    rows.append(sorted(map(tuple, substring.repeated_passages(docs.repartition(3)).collect())))
    monkeypatch.setattr(substring, "LOCAL_SEEN", 1)
    rows.append(sorted(map(tuple, substring.repeated_passages(docs.repartition(3)).collect())))
    assert rows[0] == rows[1] == rows[2] == rows[3]
    pairs = {(r[0], r[3]) for r in rows[0]}
    assert pairs >= {(100 * g + 9, 100 * g + 5) for g in range(10)} | {(3000, 5), (3001, 5)}
    assert {d for p in pairs for d in p if 2000 <= d < 2120} == set(range(2000, 2120)) and len(pairs) < 600


def test_fuzzy_passages_against_brute_force(spark):
    """Passages of 100 words with every tenth word changed, dropped or doubled at random, quoted in part elsewhere too."""
    rng = random.Random(23)
    own = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    texts, want = {}, set()
    for g in range(40):
        base = own(100)
        for i in range(4):
            words = []
            for w in base:
                hit = rng.random()
                words += own(1) if hit < 0.06 else [] if hit < 0.08 else [w, w] if hit < 0.10 else [w]
            texts[10 * g + i] = own(20) + words + own(20)
        texts[10 * g + 4] = own(20) + base[:40] + own(20)
        for i in range(4):
            for j in range(i):
                a, b = texts[10 * g + i][20:-20], texts[10 * g + j][20:-20]
                if substring.edit_distance(a, b, 200) * 5 <= max(len(a), len(b)):
                    want.add((10 * g + i, 10 * g + j))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    got = substring.repeated_passages(docs).collect()
    for r in got:  # every row is what it says
        a, b = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
        assert min(len(a), len(b)) >= 50 and substring.edit_distance(a, b, 200) <= r["edits"] <= max(len(a), len(b)) // 5
    found = {x for r in got for x in (r["doc_id"], r["other_id"])}
    assert len(found & {d for p in want for d in p}) >= 0.9 * len({d for p in want for d in p})


def test_fuzzy_passages_by_pairs(spark):
    """Every two of the holders of a fuzzy passage have a row of their own, groups of four and of twelve."""
    rng = random.Random(29)
    own = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    texts, want = {}, set()
    for g in range(50):
        base, held = own(100), []
        for i in range(12 if g < 3 else 4):
            words = []
            for w in base:
                hit = rng.random()
                words += own(1) if hit < 0.06 else [] if hit < 0.08 else [w, w] if hit < 0.10 else [w]
            held.append(words)
            texts[100 * g + i] = own(20) + words + own(20)
            want |= {(100 * g + i, 100 * g + j) for j in range(i)
                     if substring.edit_distance(words, held[j], 200) * 5 <= max(len(words), len(held[j]))}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    found = {(r["doc_id"], r["other_id"]) for r in substring.repeated_passages(docs).collect()}
    print("pairs found", len(found & want) / len(want))
    assert len(found & want) >= 0.9 * len(want)


@pytest.mark.parametrize("crowded", [1 << 16, 8])
def test_holders_of_a_passage_of_frequent_seeds_by_pairs(spark, monkeypatch, crowded):
    """Halves of a passage that many documents quote hide no pair of the documents that hold all of it; nor does a word
    that is repeated all over."""
    monkeypatch.setattr(substring, "CROWDED", crowded)
    rng = random.Random(31)
    own = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    first, second = own(30), own(30)
    texts = {i: own(12) + (first + second if i < 10 else first if i < 65 else second) + own(12) for i in range(120)}
    texts |= {200 + i: own(12) + ["the"] * (60 + 9 * i) + own(5) for i in range(8)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    got = substring.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(i, j) for ids in (range(10), range(200, 208)) for i in ids for j in ids if j < i}
    assert all(r["edits"] == 0 and r["end"] - r["start"] >= 50 for r in got)
    assert all((r["start"], r["end"]) == (12, 72) for r in got if r["doc_id"] < 10)


def test_small_seeds_are_matched_whole(monkeypatch):
    """All pairs of documents of the small seeds, each shared row marked once, in portions of any size."""
    monkeypatch.setattr(substring, "PAIRS", 6)
    rng = random.Random(30)
    rows = sorted((s, d % 3, d, rng.randrange(90)) for s in range(60) for d in rng.choices(range(4), k=rng.randrange(1, 11)))
    want, large = set(), [r for r in rows if sum(x[0] == r[0] for x in rows) > 6]
    for i, a in enumerate(rows):
        want |= {(a[0], a[2], a[3], b[2], b[3]) for b in rows[:i] if b[0] == a[0] and b[2] != a[2] and a not in large}
    for step in (1, 3, 7, 1000):
        few, links, rest = substring.Small(), [], []
        for at in [*range(0, len(rows), step), None]:
            part = rows[at : at + step] if at is not None else []
            cols = [np.array([r[c] for r in part], dtype=np.int64) for c in range(4)]
            found, more = few.feed(cols, end=at is None)
            links += list(zip(*(x.tolist() for x in found)))
            rest += list(zip(*(x.tolist() for x in more)))
        assert {x[:5] for x in links} == want and rest == large
        marked = [x[:3] for x in links if x[5] & 1] + [(x[0], *x[3:5]) for x in links if x[5] & 2]
        assert set(marked) == {(s, *x) for s, *y in want for x in (tuple(y[:2]), tuple(y[2:]))}


def test_banded_edit_distance():
    rng = random.Random(24)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *_next(row, x, b, i)]
        return row[-1]

    def _next(row, x, b, i):
        out, left = [], i
        for j, y in enumerate(b, 1):
            left = min(row[j - 1] + (x != y), row[j] + 1, left + 1)
            out.append(left)
        return out

    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        for limit in (0, 1, 2, 4, 20):
            assert substring.edit_distance(a, b, limit) == min(plain(a, b), limit + 1)


def test_chaining_against_brute_force():
    rng = random.Random(12)
    for _ in range(200):
        segs = sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(8, 20)) for _ in range(rng.randrange(2, 9))})
        best = substring.best_chains(segs, 8)
        assert sorted(s for c in best for s in c) == segs
        score = {}
        for i, (p, o, n) in enumerate(segs):
            score[i] = n + max([0, *(
                score[j] - substring.GAP_COST * ((p - segs[j][0] - max(segs[j][2] - 8, 1)) + (o - segs[j][1] - max(segs[j][2] - 8, 1))) / 2
                for j in range(i) if segs[j][0] + max(segs[j][2] - 8, 1) <= p and segs[j][1] + max(segs[j][2] - 8, 1) <= o)])
        chain, total = best[0], 0
        for i, (p, o, n) in enumerate(chain):
            total += n
            if i:
                q, u, m = chain[i - 1]
                total -= substring.GAP_COST * ((p - q - max(m - 8, 1)) + (o - u - max(m - 8, 1))) / 2
        assert abs(total - max(score.values())) < 1e-9


# ---- 8 token counts

def test_length_histogram_and_round_trip(spark):
    rng = random.Random(13)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(80)] + [None, "", "x"]
    encode = tokencounts.encoder(tokencounts.VOCABULARY)
    assert all(encode.decode(encode.encode_ordinary(t)) == t for t in texts if t)
    want = [len(encode.encode_ordinary(t)) if t else 0 for t in texts]
    lengths = tokencounts.encoded_lengths(docs_of(spark, texts))
    for stretch in (1 << 16, 16):
        hist = tokencounts.length_histogram(lengths, stretch)
        for r in hist.collect():
            n = r["n_tokens"]
            assert r["n_docs"] == want.count(n) and r["docs_from"] == sum(x >= n for x in want)
            assert r["tokens_from"] == sum(x for x in want if x >= n) and r["kept_tokens"] == sum(min(x, n) for x in want)
    assert tokencounts.tokens_kept(hist, 33).first()[0] == sum(min(x, 33) for x in want)
    many = spark.createDataFrame([(1, 3 * 10**9 - 1), (2, 1), (3, 1)], "n_tokens long, n_docs long")
    many = many.withColumns({"all_docs": F.lit(3 * 10**9 + 1), "docs_from": F.sum("n_docs").over(
        Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0))})
    exact = Fraction(3 * 10**9, 3 * 10**9 + 1)
    assert [tokencounts.length_quantile(many, q).first()[0] for q in (0.5, exact, 1.0)] == [1, 2, 3]
    assert tokencounts.length_quantile(hist, 0.5).first()[0] == sorted(want)[(len(want) + 1) // 2 - 1]
    assert tokencounts.length_histogram(tokencounts.encoded_lengths(docs_of(spark, []))).count() == 0


def test_very_long_runs_of_white_space(spark):
    encoding = tokencounts.encoder(tokencounts.VOCABULARY)
    for n in (4095, 4096, 4097, 9000):
        for run in (" " * n, "\n" * n, " \u3000\t" * (n // 3 + 1), " " * n + "\n"):
            for text in (run, "a" + run, run + "b", "a" + run + "b c", run + "'s" + run + "7", "x\x1c" + run + "\x1c"):
                assert tokencounts.n_tokens(encoding, text) == len(encoding.encode_ordinary(text))
    long = " " * 3_000_000
    got = tokencounts.encoded_lengths(docs_of(spark, ["word" + long + "word", "word" + long, "word"])).collect()
    assert min(r["n_tokens"] for r in got) >= 1 and sum(r["n_tokens"] > 10_000 for r in got) == 2


# ---- 9 Jaccard

def jaccard_by_hand(texts):
    def shingles(t):
        w = WS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("hot_docs", [64, 2])
def test_jaccard_join_against_brute_force(spark, monkeypatch, hot_docs):
    monkeypatch.setattr(jaccard, "HOT_DOCS", hot_docs)
    rng = random.Random(14)
    texts = [None, "", "one", "one", "two words", "TWO words", "a b c d e", "a b c d e f g h i j k"]
    for _ in range(12):
        base = prose(rng, rng.randrange(6, 90)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 30 + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            texts.append(" ".join(copy[rng.randrange(0, 2) :]))
    shared = prose(rng, 25)
    texts += [shared + " " + prose(rng, rng.randrange(2, 40)) for _ in range(25)]
    rng.shuffle(texts)
    out = jaccard.jaccard_components(docs_of(spark, texts).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == jaccard_by_hand(texts)


def test_jaccard_far_pairs_alone(spark):
    """With no pivots' help, the boundaries alone find every link."""
    rng = random.Random(15)
    texts = []
    for _ in range(20):
        base = prose(rng, 60).split()
        texts += [" ".join(base), " ".join([*base[:-2], "other", "end"])]
    docs = docs_of(spark, texts)
    bounds = jaccard.boundaries(docs, np.zeros(0, np.uint64), 5, 80)
    none = spark.createDataFrame([], "id long, component long")
    held = sorted({x for r in bounds.collect() for x in r["bound"]})
    for hot in (np.zeros(0, np.uint64), np.sort(np.array(held[::3], np.int64).view(np.uint64))):
        bounds = jaccard.boundaries(docs, hot, 5, 80)
        pairs = jaccard.verified(jaccard.boundary_pairs(bounds, none, 80), docs, 5, 80)
        assert {(r["b"], r["a"]) for r in pairs.collect()} == {(i, i + 1) for i in range(0, 40, 2)}


def test_jaccard_far_pairs_of_widely_held_sets(spark):
    """Sets of widely held shingles only, and the same sets with new shingles: those lie on the boundary, the others beyond."""
    rng = random.Random(18)
    own = lambda n: " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(n))
    bases = [own(84) for _ in range(8, 21)]
    texts = [t for d, base in zip(range(8, 21), bases, strict=True) for t in (base, base + " " + own(d))]
    docs = docs_of(spark, texts)
    hot = np.unique(np.concatenate(list(jaccard.document_sets(pa.array(bases), 5))))
    bounds = jaccard.boundaries(docs, hot, 5, 80)
    none = spark.createDataFrame([], "id long, component long")
    pairs = jaccard.verified(jaccard.boundary_pairs(bounds, none, 80), docs, 5, 80)
    assert {(r["b"], r["a"]) for r in pairs.collect()} == {(i, i + 1) for i in range(0, 26, 2)}


@pytest.mark.parametrize("block", [8192, 24])
def test_jaccard_boundaries_find_every_link_of_random_sets(spark, monkeypatch, block):
    """No pivots: widely held passages, unequal sizes, supersets and decoys, against all pairs."""
    for name, value in {"HOT_DOCS": 4, "LOCAL_SEEN": 1, "BLOCK": block}.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(19)
    own = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    pool = [own(rng.choice([12, 30, 60, 90])) for _ in range(25)]
    texts = [own(rng.randrange(1, 60)) + p + own(rng.randrange(0, 60)) for p in pool for _ in range(6)]  # who hold them widely
    for _ in range(130):
        base = [w for p in rng.sample(pool, rng.choice([0, 1, 1, 2])) for w in p] + own(rng.choice([5, 10, 30, 80]))
        texts.append(base)
        for _ in range(rng.randrange(1, 4)):
            copy, n = list(base), max(1, len(base) // rng.choice([4, 6, 9, 14]))
            kind = rng.randrange(4)
            if kind == 0:
                copy += own(n)
            elif kind == 1:
                copy = own(n) + copy
            elif kind == 2:
                copy += rng.choice(pool)[:n]
            else:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(copy)
    texts += [[w] * 5 for p in pool for w in p[:4]]
    texts = sorted({" ".join(t) for t in texts}, key=lambda t: hashlib.md5(t.encode()).digest())
    docs = docs_of(spark, texts)
    seen = jaccard.survey(docs, 5)
    hot = jaccard.widely_held(seen.where("kind = 1"), 0)
    assert len(hot) > 500
    bounds = jaccard.boundaries(docs, hot, 5, 80)
    none = spark.createDataFrame([], "id long, component long")
    pairs = jaccard.verified(jaccard.boundary_pairs(bounds, none, 80), docs, 5, 80)
    sets = list(jaccard.document_sets(pa.array(texts), 5))
    sets = [set(x.tolist()) for x in sets]
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(x & y) >= 80 * len(x | y)}
    assert len(want) > 100 and {(r["a"], r["b"]) for r in pairs.collect()} == want


# ---- 10 licences

def test_license_scan_inherits_from_the_nearest_directory(spark):
    mit, gpl = licenses.TEMPLATES[12][1], licenses.TEMPLATES[9][1]
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x", "some code\nmore code"), (3, "a/b/COPYING", gpl), (4, "a/y", "text"),
            (5, "z/w", "nothing"), (6, "a/b/q", "long text here\n" + mit.upper() + "\nand many other words of code " * 9),
            (7, None, None), (8, "top", ""), (9, "a/b/c/x", "some code\nmore code")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "file_id long, path string, text string"))
    got = {r["file_id"]: (r["license"], r["origin"], r["from_dir"]) for r in out.collect()}
    assert got == {1: ("MIT", "file", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "file", None),
                   4: ("MIT", "inherited", "a"), 5: (None, "none", None), 6: ("MIT", "header", None),
                   7: (None, "none", None), 8: (None, "none", None), 9: ("GPL-3.0", "inherited", "a/b")}


def test_license_at_the_root_of_relative_paths(spark):
    rows = [(1, "LICENSE", licenses.TEMPLATES[12][1]), (2, "src/a/x", "code"), (3, "y", "code"), (4, None, "code")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "file_id long, path string, text string"))
    assert {r["file_id"]: r["license"] for r in out.collect()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: None}


def test_license_files_with_whole_texts(spark):
    """Real licence files, with and without a heading, wrapped in lines; prose on licences is none."""
    texts = dict(licenses.LICENSE_TEXTS)
    wrap = lambda x: "\n".join(" ".join(x.split()[i : i + 11]) for i in range(0, len(x.split()), 11))
    rows = [(1, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrap(texts["MIT"])), (2, "a/x", "code"),
            (3, "b/LICENSE", wrap(texts["MIT"])), (4, "b/c/x", "code"), (5, "c/COPYING", "Copyright 2019 A\n" + wrap(texts["BSD-3-Clause"])),
            (6, "c/x", "code"), (7, "d/LICENSE", wrap(texts["BSD-2-Clause"])), (8, "d/x", "code"), (9, "e/COPYING", wrap(texts["ISC"])),
            (10, "e/x", "code"), (11, "f/NOTICE", "Copyright 2018 B\n\n" + wrap(texts["Apache-2.0"])), (12, "f/x", "code"),
            (13, "g/x", "permission to use the software may be granted by any person who has the rights to it, and so on"), (14, "g/y", "code")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "file_id long, path string, text string"))
    want = ["MIT", "MIT", "MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", "BSD-2-Clause", "BSD-2-Clause", "ISC", "ISC", "Apache-2.0", "Apache-2.0"]
    assert {r["file_id"]: r["license"] for r in out.collect()} == dict(enumerate([*want, None, None], 1))


def test_anchors_lose_nothing():
    rng = random.Random(16)
    vectors = []
    for _ in range(20):
        v = {w: rng.random() ** 3 for w in rng.sample(VOCAB, 6)}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({w: x / norm for w, x in v.items()})
    marks = set(licenses.anchors(vectors, 0.6))
    for v in vectors:
        assert sum(x * x for w, x in v.items() if w not in marks) ** 0.5 < 0.6


# ---- awkward and empty input for all of them

def every_operator():
    bench = lambda df: df.select(F.col("doc_id").alias("item_id"), "text").limit(0)
    return {
        "decontaminate": lambda df: decontaminate.contamination(df, bench(df)),
        "mix": lambda df: mixing.mix_sources(df, block=100),
        "quality": quality.quality_digest, "keep_good": quality.keep_good,
        "language": langid.language_digest, "lines": linededup.line_digest, "dedup_lines": linededup.dedup_lines,
        "passages": substring.repeated_passages, "tokens": lambda df: tokencounts.length_histogram(tokencounts.encoded_lengths(df)),
        "jaccard": jaccard.jaccard_components, "keep_one": jaccard.keep_one, "licences": licenses.license_digest,
    }


@pytest.mark.parametrize("name", list(every_operator()))
def test_awkward_and_empty_tables(spark, name):
    operator, df = every_operator()[name], awkward(spark)
    rows = operator(df).collect()
    if name not in ("passages", "tokens", "keep_good", "keep_one"):
        assert len(rows) == 11
    if name == "mix":
        assert {c for c in operator(df).columns} >= {"slot", "kept"} and all(isinstance(r["slot"], int) for r in rows)
    if name in ("dedup_lines", "keep_good", "keep_one"):
        assert operator(df).columns == df.columns
    assert operator(df.limit(0)).count() == 0
