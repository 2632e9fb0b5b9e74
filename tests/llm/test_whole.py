"""The pipeline against a brute-force version and on awkward rows, kernels by hand, and awkward conversations."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from test_operators import awkward, contaminated_by_hand

import corpus_pipeline
from panelspark.llm import chat, langid

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def without_repeated_lines(texts):
    held = defaultdict(set)
    for d, t in texts.items():
        for line in t.split("\n"):
            held[low(line.strip(" \t\n\x0b\x0c\r"))].add(d)
    last = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    return {
        d: "\n".join(x for x in t.split("\n") if last.get(low(x.strip(" \t\n\x0b\x0c\r")), d) == d) for d, t in texts.items()
    }


def one_of_each_class(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: t for d, t in texts.items() if root(d) == d}


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF).select("doc_id", "text").collect()
    texts = one_of_each_class(without_repeated_lines({r["doc_id"]: r["text"] for r in good}))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    marks = contaminated_by_hand(list(texts.items()), bench)
    want = {d: t for d, t in texts.items() if not (marks[d][1] and 20 * marks[d][1] >= marks[d][0])}
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "text").collect()
    assert len(rows) == len(want) and {r["doc_id"]: r["text"] for r in rows} == want


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    n, texts = docs.count(), {r["text"] for r in docs.select("text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and all(r["slot"] == "mine" and r["kept"] == 1 for r in rows), name
        if name == "quality rules":
            assert {r["doc_id"] for r in rows} == {3}
        elif name == "n-gram Jaccard join":
            assert {r["text"] for r in rows} == texts
        else:
            assert len(rows) == n, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == n


def test_language_scores_against_kernels_by_hand():
    rng = random.Random(3)
    kinds = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["schl", "ung", "eich", "ü"], "cc": ["tion", "que", "é", "eau"]}

    def text(lang):
        return " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(rng.randrange(1, 20)))

    def grams(t, n):
        raw = t.lower().encode()
        return {raw[i : i + n] for i in range(len(raw) - n + 1)}

    langs = ["aa", "bb", "cc"] * 8 + ["aa"] * 6
    train = [text(x) for x in langs]
    asked = [text(x) for x in ("aa", "bb", "cc", "aa")] + ["KA mo", "ü", "Zebra 12", "x", train[0]]
    model = langid.Model.fit(langs, [[np.unique(langid.gram_codes(t, n)) for t in train] for n in langid.NS], 12, 0.1)
    got = model.scores(asked, model.tables())

    held = {n: Counter(g for t in train for g in grams(t, n)) for n in (1, 2, 3)}
    known = {n: {g for g, c in held[n].items() if c >= 2} for n in held}

    def kernel(x, z):
        pairs = [(grams(x, n) & known[n], grams(z, n) & known[n]) for n in known]
        return sum(len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1)) for a, b in pairs) / 3

    marks = [train[i] for i in np.unique(np.linspace(0, len(train) - 1, 12).astype(int))]
    values, vectors = np.linalg.eigh(np.array([[kernel(x, z) for z in marks] for x in marks]))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = {t: np.array([kernel(t, z) for z in marks]) @ root for t in train + asked}
    weight = np.sqrt([1 / langs.count(x) for x in langs])
    rows = np.vstack([np.array([features[t] for t in train]) * weight[:, None], math.sqrt(0.1) * np.eye(len(marks))])
    assert model.languages == sorted(set(langs))
    for j, lang in enumerate(model.languages):
        target = np.concatenate([np.where(np.array(langs) == lang, 1, -1) * weight, np.zeros(len(marks))])
        solved = np.linalg.lstsq(rows, target, rcond=None)[0]
        assert np.allclose([features[t] @ solved for t in asked], got[:, j], atol=2e-3)


def test_chat_long_texts_null_conversation_and_empty_table(spark):
    long = "<|im_end|>\\ ü\n" * 20_000
    rows = [(None, 0, "user", long), (None, 1, "assistant", long), (None, 1, "assistant", long), (1, None, "assistant", None),
            (1, 3, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    made = chat.format_chat(df).withColumn("read", chat.read_turns(F.col("formatted")))
    out = {r["conv_id"]: r for r in made.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(x) for x in out[None]["read"]] == [("user", long), ("assistant", long), ("assistant", long)]
    assert out[None]["loss"] == long * 2
    assert [tuple(x) for x in out[1]["read"]] == [("assistant", ""), ("", "")] and out[1]["loss"] == ""
    assert chat.chat_digest(chat.format_chat(df.limit(0))).count() == 0


def test_chat_of_many_turns_has_its_spans_in_place(spark):
    rows = [("c", i, ("user", "assistant", "assistant")[i % 3], f"<|t{i}|>" * (i % 5)) for i in range(1700)]
    made = chat.format_chat(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(5)).first()
    want = [chat_text for _, _, role, chat_text in rows if role == "assistant"]
    got = [made["formatted"][s["start"] : s["start"] + s["length"]].replace("<\\|", "<|") for s in made["loss_spans"]]
    assert got == want and made["n_blocks"] == 1134
    sizes = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 511, 512, 513, 1500)], "v array<bigint>")
    for r in sizes.select("v", chat.starts_of(F.col("v")).alias("s")).collect():
        assert r["s"] == [sum(r["v"][:i]) for i in range(len(r["v"]))]
