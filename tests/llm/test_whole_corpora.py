"""Cases in which an operator once did less than its whole job."""

import random

from pyspark.sql import functions as F

from auditloom.llm import neardup, overlap, pairs, quality

VOCABULARY = [f"w{i}" for i in range(900)]


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def substituted(text, places, mark):
    """text with other words at the places."""
    w = text.split()
    for p in places:
        w[p] = f"x{mark}x{p}"
    return " ".join(w)


def test_edited_evaluation_copies_of_one_text(spark):
    rng = random.Random(11)
    base = " ".join(rng.sample(VOCABULARY, 100))
    texts = {"t": base} | {f"e{k}": substituted(base, rng.sample(range(5, 95), 4 + k % 5), k) for k in range(50)}
    d = spark.createDataFrame([(i, t, "train" if i == "t" else "test") for i, t in texts.items()], "id string, text string, split string").withColumn("loaded_at", F.timestamp_seconds(F.lit(1)))
    want = {(i, "t") for i, t in texts.items() if i != "t" and jaccard(shingles(t), shingles(base)) >= 0.6}
    got = {(r["eval_id"], r["train_id"]) for r in overlap.text_overlaps(d, "id", "text", "split", "loaded_at", 30).collect()}
    assert got == want and len(want) >= 40


def test_kind_does_not_depend_on_the_other_rows(spark):
    prose = "The patient was seen in the clinic today and was well. There was no pain and the wound was clean and dry. "
    table = "name\tvalue\tunit\n" + "\n".join(f"item {i}\t{i * 7}\tmg" for i in range(12))
    rows = [(i, prose * (2 + i % 3), "en") for i in range(60)] + [(100 + i, table, "en") for i in range(30)] + [(200, table, "xx"), (201, prose, "xx"), (202, table, "xx")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    words = spark.createDataFrame([("en", w) for w in sorted(set(prose.lower().replace(".", "").split()))], "lang string, word string")
    kinds = {r["doc_id"]: r["kind"] for r in quality.document_quality(d, words).collect()}
    assert kinds == {i: "table" if t == table else "prose" for i, t, _ in rows}


def test_hot_band_keeps_pairs_that_share_no_other(spark):
    d = spark.createDataFrame([(i, [7, 1000 + i]) for i in range(200)], "h1 bigint, bands array<bigint>")
    got = [(r["a"], r["b"]) for r in neardup.candidates(d, "h1").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for j in range(200) for i in range(j)}


def test_large_cluster_near_the_threshold(spark):
    rng = random.Random(12)
    base = " ".join(rng.sample(VOCABULARY, 120))
    texts = [substituted(base, rng.sample(range(120), 5), k) for k in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [shingles(t) for t in texts]
    want = {(i, j) for j in range(300) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.6}
    got = {(r["a"], r["b"]) for r in neardup.similar_pairs(d).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_all_copies_count_as_pairs(spark):
    rng = random.Random(13)
    base, other = (" ".join(rng.sample(VOCABULARY, 60)) for _ in range(2))
    near = substituted(base, [30], 0)
    rows = [(f"e{i}", base, "test") for i in range(65)] + [(f"t{i}", base, "train") for i in range(64)] + [("n", near, "train"), ("o", other, "train")]
    d = spark.createDataFrame(rows, "id string, text string, split string").withColumn("loaded_at", F.timestamp_seconds(F.lit(1)))
    links, members = overlap.text_links(d, "id", "text", "split", "loaded_at", 30)
    assert {(r["id"], r["pairs"]) for r in overlap.partners(links, members).collect()} == {(f"e{i}", 65) for i in range(65)}
    found = {r["id"]: (r["class_id"], r["covered"]) for r in overlap.membership(links, members).collect()}
    assert found == {f"e{i}": ("e0", 1.0) for i in range(65)} | {f"t{i}": ("t0", None) for i in range(64)} | {"n": ("n", None)}
    assert {tuple(r) for r in overlap.class_links(links, members).collect()} == {("e0", "t0"), ("e0", "n")}
    one = links.join(members.where("id = 'n'").selectExpr("h as t"), "t").first()
    assert abs(one["covered"] - 59 / 60) < 1e-9


def test_long_refusals():
    many = "I am sorry, but I cannot help with this picture. " * 20
    long = "I cannot help with this request because " + "the rules that I was given on private and medical matters apply here " * 4 + "in full."
    assert len(many) > 600 and pairs.refuses(many) and pairs.refuses(long)
    assert not pairs.refuses(many + "A grey cat lies on the red sofa beside the window.")
