import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import chunking, packing, pairs, quality, ranking, tokenize
from auditloom.llm.textnp import Words

DOCS = "doc_id bigint, text string, lang string, source string"


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_words_against_regex():
    texts = ["Ab-c d_e 1½ É​x", "", "  ", "日本 語a1", "x" * 5000]
    w = Words(texts)
    for i, t in enumerate(texts):
        assert w.first[i + 1] - w.first[i] == len(words(t))
    runs, doc = w.runs(2)
    assert np.bincount(doc, minlength=5).tolist() == [max(0, len(words(t)) - 1) for t in texts]
    assert Words(["a b", "c a b"]).runs(2)[0][0] == Words(["a b", "c a b"]).runs(2)[0][2]


# ---- problem 1


@pytest.mark.parametrize(
    "text, defect",
    [
        ("What is it?", "empty_answer"),
        ("What is it?\nAssistant: -", "empty_answer"),
        ("What does the image depict?\nQ: What does the image depict?", "copied_question"),
        ("Describe the picture.\n\"describe the picture.\"", "copied_question"),
        ("What is it?\nI'm sorry, but I can't help with that.", "refusal"),
        ("What is it?\nUnfortunately, pictures of this kind are off limits for me! Is there anything else?", "refusal"),
        ("What is it?\nI can't make out the label, yet a red bus stands near the wall and two men are waiting.", None),
        ("What can be seen in this picture?\nEin Kind steht neben dem Haus, während ein Mann auf der Wiese liegt.", "other_language"),
        ('What can be seen in this picture?\nThe sign says "Der Bäcker und die Frau sind nicht hier" and it is red.', None),
        ("Is there a dog?\nNo.", None),
        ("What is it?\nJe refuse de répondre.", "refusal"),
        ("What is it?\nSorry, no.", "refusal"),
        ("What is it?\nNo. I prefer not to describe people.", "refusal"),
        ("What is it?\nHmm, describing it would go against my rules!", "refusal"),
        ("What is it?\n" + "I'm sorry, but I can't help with that. " * 40, "refusal"),
        ("What colour is the bus on the left?\nWhat color is the bus on the left?", "copied_question"),
        ("What colour is the bus?\nThe colour of the bus is red.", None),
        ("Is there a dog in the picture?\nYes, there is a dog in the picture.", None),
        ("How many dogs are there?\n3", "open"),
    ],
)
def test_plain_defects(text, defect):
    assert pairs.plain_defect(text) == defect


def test_truncated_answers(spark):
    nouns, colours = "bus dog kettle fence chair tent boat ladder".split(), "red blue green white".split()
    rng = random.Random(1)
    full = lambda: f"The {rng.choice(nouns)} near the {rng.choice(nouns)} is {rng.choice(colours)}. A {rng.choice(nouns)} stands beside the {rng.choice(nouns)}."
    rows = [(f"f{i}", "What is it?\n" + full()) for i in range(200)]
    rows += [("cut", "What is it?\nThe bus near the tent is"), ("word", "What is it?\nThe bus near the tent is red. A dog stands beside the ket"), ("nostop", "What is it?\nThe bus near the tent is red. A dog stands beside the kettle"), ("null", None)]
    rows += [("none", "Is there a dog?\nNone"), ("three", "How many?\n3"), ("red", "Which?\nred"), ("asks", "Which?\nThe"), ("name", "Who?\nThe dog near the bus is Zephyrine"), ("page", "What is it?\n" + full() + " Page 1 of 1")]
    got = {r["id"]: r["defect"] for r in pairs.find_defects(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"cut": "truncated_answer", "word": "truncated_answer", "asks": "truncated_answer"}
    assert pairs.find_defects(spark.createDataFrame([], "id string, text string")).count() == 0


# ---- problem 3


def brute_boundary(t, limit):
    for name, sep in (("paragraph", r"\n[ \t\r]*\n"), ("line", r"\n"), ("sentence", r"(?<=[.!?])[ \t\r\n]+"), ("word", r"[ \t\r\n]+")):
        if max(len(u.strip(" \t\r\n")) for u in re.split(sep, t)) <= limit:
            return name
    return "none"


def test_splitting(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["abc", "d" * 12, "é", "😀", " ", ". ", "\n", "\r\n\r\n", "? "]) for _ in range(60)) for _ in range(60)] + ["x" * 400, "", None, "short", " " * 150]
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, piece int")
    rows = chunking.split_documents(d, limit=100, overlap=20).collect()
    long = {i for i, t in enumerate(texts) if t and len(t) > 100}
    assert {r["doc_id"] for r in rows} == long
    for i in long:
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        end = 0
        for r in own:
            assert 0 < len(r["piece_text"]) <= 100 and texts[i][r["start_pos"] :].startswith(r["piece_text"])
            assert r["start_pos"] <= end and end - r["start_pos"] <= 20
            end = r["start_pos"] + len(r["piece_text"])
        assert end == len(texts[i]) and own[0]["boundary"] == brute_boundary(texts[i], 100)


# ---- problem 6


def test_net_flows_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(f"i{k}", float(rng.integers(0, 9)), float(rng.normal()), "x") for k in range(50)] + [("n", None, 1.0, "x"), ("m", float("nan"), 1.0, "x"), ("e", float("inf"), 1.0, "x")]
    d = spark.createDataFrame(rows, "id string, a double, b double, flow string")
    for per_range in (500_000, 7):
        got = {r["id"]: r for r in ranking.net_flows(d, "id", {"a": -1, "b": 1}, per_range).collect()}
        assert len(got) == 50
        for c, sign in (("a", -1), ("b", 1)):
            v = np.array([sign * r[1 if c == "a" else 2] for r in rows[:50]])
            u = np.array([((v < x).sum() + ((v == x).sum() - 1) / 2) / 49 for x in v])
            for k in range(50):
                want = (np.maximum(u[k] - u, 0) - np.maximum(u - u[k], 0)).sum() / 49
                assert abs(got[f"i{k}"][f"flow_{c}"] - want) < 1e-9
    assert ranking.net_flows(d.limit(0), "id", {"a": -1, "b": 1}).count() == 0
    assert ranking.top_share(ranking.net_flows(d, "id", {"a": -1, "b": 1}), "id").count() == 2


def test_thresholds_and_weights_of_preference(spark):
    rng = random.Random(4)
    rows = [(f"k{i:02}", rng.choice([1.0, 2.0, rng.random()]), rng.random() * 9) for i in range(60)]
    d = spark.createDataFrame(rows, "id string, a double, b double")
    q, p, weights = 0.1, 0.4, {"a": 3.0, "b": 1.0}
    prefer = lambda x: 0.0 if x <= q else min(1.0, (x - q) / (p - q))

    def flow(values):
        u = [(sum(y < x for y in values) + (sum(y == x for y in values) - 1) / 2) / 59 for x in values]
        return [sum(prefer(x - y) - prefer(y - x) for y in u) / 59 for x in u]

    a, b = flow([r[1] for r in rows]), flow([r[2] for r in rows])
    got = {r["id"]: r["flow"] for r in ranking.net_flows(d, "id", {"a": 1, "b": 1}, rows_per_range=20, indifference=q, preference=p, weights=weights).collect()}
    assert all(abs(got[r[0]] - (3 * x + y) / 4) < 1e-9 for r, x, y in zip(rows, a, b))
    plain = {r["id"]: r["flow"] for r in ranking.net_flows(d, "id", {"a": 1, "b": 1}).collect()}
    assert sorted(plain, key=plain.get) != sorted(got, key=got.get)
    flows = ranking.net_flows(d, "id", {"a": 1, "b": 1})
    best = sorted(plain, key=lambda k: (-round(plain[k], 12), k))[:20]
    assert {r["id"] for r in ranking.top_share(flows, "id", 3, ordered=5).collect()} == set(best)
    assert [r["id"] for r in ranking.top_share(flows, "id", 3).collect()] == best


def test_hot_values(spark):
    d = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("a"))
    got = ranking.net_flows(d, "id", {"a": 1}).collect()
    assert len(got) == 3000 and len({r["flow"] for r in got if int(r["id"]) % 3 == 0}) == 1 and all(r["flow"] is not None for r in got)


# ---- problem 7


def test_kinds(spark):
    prose = "The patient was seen on the ward and had no pain. It was agreed that she would go home in the morning."
    rows = [(i, prose + f" Visit {i}.", "en", None) for i in range(60)]
    rows += [
        (100, "\n".join(f"* milk {k}" for k in range(9)), "en", None),
        (101, "\n".join(f"a{k}\t{k}\t{k * 2}" for k in range(9)), "en", None),
        (102, "x9Q" * 200, "en", None),
        (103, "qwrt plk zxcv bnm " * 12, None, None),
        (104, "", "en", None),
        (105, None, "en", None),
        (106, " \n\t ", "EN", None),
        (107, "Notes\n\nAge: 4\n\n" + prose, "en", None),
    ]
    common = spark.createDataFrame([("en", w) for w in "the was on and had no it that she in would".split()], "lang string, word string")
    got = {r["doc_id"]: r for r in quality.document_quality(spark.createDataFrame(rows, DOCS), common).collect()}
    assert len(got) == len(rows)
    assert [got[k]["kind"] for k in range(100, 108)] == ["list", "table", "junk", "junk", "empty", "empty", "empty", "prose"]
    assert all(got[i]["kind"] == "prose" for i in range(60)) and got[105]["n_words"] == 0 and got[0]["n_words"] == len(words(rows[0][1]))


# ---- problems 8 and 9

HAVE_VOCABULARY = os.path.exists(os.path.join(tokenize.TOKENIZERS, tokenize.VOCABULARY))


@pytest.mark.skipif(not HAVE_VOCABULARY, reason="vocabulary")
def test_encoding_against_library(spark):
    import base64

    import tiktoken

    with open(os.path.join(tokenize.TOKENIZERS, tokenize.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    parts = ["'s", "'re", "'", " ", "  ", "\n", "\t", "a", "Hello", "é", "日本", "½", "12", "_", "!?", "<|endoftext|>", "　", "x" * 30, "\0"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(300)] + ["", None, "word " * 40000]
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids bigint")
    encoder = tokenize.Encoder()
    for r in tokenize.encode_documents(d, offsets=True).collect():
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == own.encode_ordinary(t) and encoder.decode(r["ids"]) == t and len(r["offsets"]) == len(r["ids"])
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenize.token_counts(d).collect()}
    assert counts[len(texts) - 1] == 40001 and counts[len(texts) - 2] == 0


def test_packing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 300))) for i in range(3000)] + [(9001, 2500), (9002, 1024), (9003, None), (9004, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    for bucket in (50_000, 700):
        got = packing.pack_documents(d, bucket_items=bucket).toPandas()
        assert got.groupby("doc_id").n_tokens.sum().to_dict() == {k: n for k, n in rows if n}
        assert set(got[got.groupby("doc_id").doc_id.transform("size") > 1].doc_id) == {9001}
        fill = got.groupby("seq_id").n_tokens.sum()
        assert fill.max() <= 1024 and got.n_tokens.sum() / (1024 * len(fill)) > 0.97
        ordered = got.sort_values(["seq_id", "seq_start"])
        assert ((ordered.groupby("seq_id").n_tokens.cumsum() - ordered.n_tokens) == ordered.seq_start).all()
    assert packing.pack_documents(d.limit(0)).count() == 0
