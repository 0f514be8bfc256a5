import random
import re
import struct


import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import abuse, neardup, overlap, pii
from auditloom.llm.textnp import Words, code_points, word_table

VOCABULARY = [f"w{i}" for i in range(900)]


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def edited(text, rng, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split())


def corpus(n, rng):
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randrange(25, 120))) for _ in range(n)]
    return texts + [edited(rng.choice(texts), rng, rng.choice([0, 0.03, 0.06, 0.1, 0.2])) for _ in range(n)]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = corpus(120, rng) + [None, "", "few words"]
    d = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id bigint, text string, a string")
    sets = [shingles(t or "") for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.6}
    got = [(r["b"], r["a"]) for r in neardup.similar_pairs(d).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.97 * len(want)
    found = {r["doc_id"]: r["class_id"] for r in neardup.groups(d).collect()}
    assert all(found[i] == found[j] for i, j in got)


def test_hot_group_of_copies(spark):
    rng = random.Random(4)
    one = " ".join(rng.choices(VOCABULARY, k=50))
    texts = [one] * 150 + [edited(one, rng, 0.02)] + [" ".join(rng.choices(VOCABULARY, k=50)) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["a"], r["b"]) for r in neardup.similar_pairs(d, expand=10).collect()}
    assert {(0, i) for i in range(1, 151)} == got
    assert neardup.groups(d).count() == 151
    assert neardup.similar_pairs(d.limit(0)).count() == 0


def test_hot_band_is_refined(spark):
    rng = random.Random(5)
    one = " ".join(rng.choices(VOCABULARY, k=80))
    texts = [edited(one, rng, 0.02) for _ in range(100)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [shingles(t) for t in texts]
    want = {(j, i) for i in range(100) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.6}
    got = {(r["a"], r["b"]) for r in neardup.similar_pairs(d).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_weighted_signature_estimates_similarity():
    a, b = "x y z " * 6 + "p q r s t u v " * 3, "x y z " * 3 + "p q r s t u v " * 3
    runs, doc = Words([a, b]).runs(1)
    s = neardup.signatures(*neardup.bag(runs, doc, True), 2, 256)
    weights = [{w: t.split().count(w) for w in set(t.split())} for t in (a, b)]
    every = set(weights[0]) | set(weights[1])
    want = sum(min(weights[0].get(w, 0), weights[1].get(w, 0)) for w in every) / sum(max(weights[0].get(w, 0), weights[1].get(w, 0)) for w in every)
    assert abs((s[0] == s[1]).mean() - want) < 0.13


def test_repeated_runs_count_if_weighted(spark):
    rng = random.Random(9)
    once = " ".join(rng.sample(VOCABULARY, 40))
    d = spark.createDataFrame([(1, once + " " + once + " " + once), (2, once), (3, once + " one more word"), (4, None), (5, "")], "doc_id bigint, text string")
    plain = {(r["a"], r["b"]) for r in neardup.similar_pairs(d).collect()}
    assert plain == {(1, 2), (1, 3), (2, 3)}  # of the runs, not of how often
    assert {(r["a"], r["b"]) for r in neardup.similar_pairs(d, weighted=True).collect()} == {(2, 3)}
    with pytest.raises(RuntimeError):
        neardup.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint"), rounds=1)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (101, 105)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 105: 100}


def test_text_overlaps_against_all_pairs(spark):
    rng = random.Random(6)
    texts = corpus(100, rng)
    rows = [(f"i{k}", t, ["train", "validation", "test", None][min(3, rng.randrange(13) // 4)], k) for k, t in enumerate(texts)] + [("i0", texts[0], "train", 900), (None, texts[1], "test", 1), ("z", None, "test", 1)]
    d = spark.createDataFrame(rows, "id string, text string, split string, loaded_at int").withColumn("loaded_at", F.timestamp_seconds("loaded_at"))
    split = {r[0]: r[2] for r in rows if r[0]}
    sets = {f"i{k}": shingles(t) for k, t in enumerate(texts)}
    want = {(e, t) for e in sets for t in sets if split[e] in ("validation", "test") and split[t] == "train" and jaccard(sets[e], sets[t]) >= 0.6}
    got = {(r["eval_id"], r["train_id"]) for r in overlap.text_overlaps(d, "id", "text", "split", "loaded_at", 30).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and want
    assert overlap.text_overlaps(d.limit(0), "id", "text", "split", "loaded_at", 30).count() == 0


def test_distinct_runs_and_word_table():
    rng = np.random.default_rng(3)
    runs, doc = rng.integers(0, 2**64, 500, dtype=np.uint64)[rng.integers(0, 500, 20000)], np.sort(rng.integers(0, 300, 20000))
    got, of = overlap.distinct_runs(runs, doc, 300)
    want = sorted({(int(d), int(r)) for d, r in zip(doc, runs)})
    assert [(d, r >> 32) for d, r in want] == list(zip(of.tolist(), (got >> np.uint64(32)).tolist()))
    assert (overlap.odd_sketches(got, of, 300) == overlap.odd_sketches(np.array([r for _, r in want], np.uint64), of, 300)).all()
    assert all(len(x) == 0 for x in overlap.distinct_runs(runs[:0], doc[:0], 0))
    assert all(bool(inside) == chr(c).isalnum() for c, inside in enumerate(word_table()))


def bmp(x):
    rows = b"".join(bytes(x[y, :, ::-1].reshape(-1)) for y in range(len(x) - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, x.shape[1], len(x), 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_picture_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    pictures = [rng.integers(0, 256, (24, 24, 3)) for _ in range(40)]
    for k in range(40):
        pictures.append(np.clip(pictures[k] + rng.normal(0, [0, 4, 9, 30][k % 4], (24, 24, 3)), 0, 255))
    pictures = [p.astype(np.uint8) for p in pictures]
    rows = [(f"p{k}", {"bytes": bytearray(bmp(np.kron(p, np.ones((2, 2, 1), np.uint8)) if k % 5 == 0 else p)), "path": None}, "train" if k < 40 else "test") for k, p in enumerate(pictures)]
    rows += [("n", None, "test"), ("c", {"bytes": bytearray(b"BM12"), "path": None}, "test")]
    d = spark.createDataFrame(rows, "id string, image struct<bytes: binary, path: string>, split string").selectExpr("*", "timestamp '2024-01-01' as loaded_at")
    want = {(f"p{i}", f"p{j}") for i in range(40, 80) for j in range(40) if np.abs(pictures[i].astype(float) - pictures[j]).mean() <= 10}
    assert {(r["eval_id"], r["train_id"]) for r in overlap.picture_overlaps(d, "id", "image", "split", "loaded_at").collect()} == want


# ---- problem 4


def test_redaction_keeps_all_else(spark):
    texts = ["Seen and signed by Dr Sorrel Hexworth. Phone: 07700 900384", "", None, "The blood pressure was 120/80 mmHg.", "word " * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = pii.find_personal(d).collect()
    out = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert len(out) == 5 and out[1] == "" and out[2] is None and out[4] == texts[4]
    for i in (0, 3):
        t = texts[i]
        for r in sorted((r for r in spans if r["doc_id"] == i), key=lambda r: -r["start_pos"]):
            t = t[: r["start_pos"]] + pii.PLACEHOLDERS[r["pii_type"]] + t[r["end_pos"] :]
        assert out[i] == t
    assert pii.find_personal(d.limit(0)).count() == 0


def test_long_stretches_equal_short_windows():
    own = pii.Tagger()
    t = "Contact: Sorrel Hexworth / 07700 900384 / sorrel@mail.example. " * 20
    doc, kind, start, end = own.spans([t])
    assert len(start) >= 40 and set(np.array(pii.TYPES)[kind]) >= {"name", "phone", "email"}


def test_every_position_is_tagged():
    own = pii.Tagger()
    plain = "The wound was clean and the temperature was normal. "
    for t, kind, span in (
        (plain + "He lives at 14 Baker Street, London. " + plain, "address", "14 Baker Street, London"),
        (plain + "Address: 12 Park Street", "address", "12 Park Street"),
        ("Signed: Hope Baker", "name", "Hope Baker"),
        (plain + "Write to " + "a" * 90 + "@example-hospital.org for details.", "email", "a" * 90 + "@example-hospital.org"),
    ):
        doc, k, start, end = own.spans([t])
        assert [(pii.TYPES[i], t[s:e]) for i, s, e in zip(k, start, end)] == [(kind, span)]


def test_path_equals_the_search_over_the_whole_text():
    own = pii.Tagger()
    texts = ["", "x", "Contact: Sorrel Hexworth / 07700 900384. " + "The wound was clean. " * 70 + "Home address is 12 Park Street, Vellora. " * 9, "Q7+/aZ09Lk" * 300]
    cps, at = code_points(texts)
    tags, scores = own.tag(cps, at[:-1], at[1:] - 1), own.scores(cps, at[:-1], at[1:] - 1)
    for s, e in zip(at[1:-1], at[2:] - 1):
        assert (scores[s:e] != 0).any(axis=1).all()
        assert (own.viterbi(scores[s:e, None], np.array([e - s]))[:, 0] == tags[s:e]).all()
    # a window's inner characters have the scores of a longer context but for what the LSTM forgets
    whole = own.emissions(pii.char_classes()[cps[at[2] : at[3] - 1]][:, None], np.array([at[3] - 1 - at[2]]))[:, 0]
    assert (whole.argmax(axis=1) == scores[at[2] : at[3] - 1].argmax(axis=1)).mean() > 0.99


def test_windows_side_by_side_equal_windows_alone():
    own = pii.Tagger()
    texts = ["Seen by Dr Sorrel Hexworth. " * k + "x" * (k % 7) for k in range(0, 90, 3)] + ["", "a"]
    cps, at = code_points(texts)
    scores = own.scores(cps, at[:-1], at[1:] - 1)
    for s, e in zip(at[:-1], at[1:] - 1):
        alone = own.scores(cps[s : e + 1], np.array([0]), np.array([e - s]))
        assert np.allclose(alone[: e - s], scores[s:e], atol=1e-3)


def test_columns_and_searches_have_little_padding():
    length = np.array([960] * 1500 + list(range(1, 960)) * 2)
    column, place, size = pii.columns_of(length, 448)
    assert len(size) * size.max() < 1.03 * length.sum() and (np.bincount(column, weights=length + 1) == size).all()
    for j in (0, 447):
        own = np.argsort(place[column == j])
        assert (np.diff(place[column == j][own]) == length[column == j][own][:-1] + 1).all()
    tagger, searched = pii.Tagger(), []
    viterbi = tagger.viterbi
    tagger.viterbi = lambda scores, n: searched.append((scores.shape[0] * scores.shape[1], int(n.sum()))) or viterbi(scores, n)
    tagger.spans(["Seen by Dr Sorrel Hexworth. The wound was clean and dry. " * 9] * 40 + ["Q7+/aZ09Lk" * 90] * 5)
    padded, real = np.sum(searched, axis=0)
    assert padded <= 1.6 * real


def test_steps_equal_a_plain_lstm():
    with np.load(pii.WEIGHTS) as f:
        p = {k: f[k].astype(np.float64) for k in f.files}

    def states(classes, d):
        h = c = np.zeros(24)
        for k in classes:
            z = p["embed"][k] @ p[f"wx{d}"] + p[f"b{d}"] + h @ p[f"wh{d}"]
            enter, keep, leave = pii.gate(z[:72]).reshape(3, 24)
            c = c * keep + pii.squash(z[72:]) * enter
            h = leave * pii.squash(c)
            yield h

    texts = ["Seen by Dr Sorrel Hexworth on Monday. ", "12 Park Street", "x"]
    a, b, c = (pii.char_classes()[code_points([t])[0][:-1]] for t in texts)
    windows = np.zeros((len(a) + len(b) + 1, 2), np.uint8)
    windows[:, 0] = np.concatenate([a, [0], b])
    windows[: len(c), 1] = c
    found = pii.Tagger().emissions(windows, np.array([len(windows), 1]))
    for part, at, column in ((a, 0, 0), (b, len(a) + 1, 0), (c, 0, 1)):
        both = np.hstack([list(states(part, 0)), list(states(part[::-1], 1))[::-1]])
        assert np.allclose(found[at : at + len(part), column], both @ p["out"] + p["out_bias"], atol=1e-3)


def test_steps_use_whole_cache_lines_and_small_products():
    own = pii.Tagger()
    assert all(pii.aligned(3, 24, 2, n).ctypes.data % 64 == 0 for n in (1, 7, 192, 224))
    # OpenBLAS copies the factors of a product of more than a million multiplications before it begins
    assert pii.COLUMNS * own.step.shape[1] * own.step.shape[2] <= 1_000_000 and pii.COLUMNS % 16 == 0


# ---- problem 10


@pytest.mark.parametrize("text, abusive", [("You are nothing but a worthless pig and everyone on the ward knows it.", True), ("Get lost, m o r o n, I hope you lose your job and your house.", True), ("Ferme ta gueule, espèce de connard inutile.", True), ("The breast examination and the vaginal examination were normal.", False), ("He was hit by a bus and bled from the scalp.", False), ("Sexual history was unremarkable.", False)])
def test_abuse(text, abusive):
    score, limit = abuse.Classifier().score_texts(["As agreed, the wound was clean. " + text])
    assert (score[0] >= limit[0]) == abusive


def test_abuse_rows(spark):
    d = spark.createDataFrame([(1, None, "s"), (2, "", None), (3, "Get lost, moron, I hope you lose your job.", "s"), (4, "fine " * 5000, "s")], "doc_id bigint, text string, source string")
    scored = abuse.score_documents(d)
    assert {r["doc_id"]: r["abusive"] for r in scored.collect()} == {1: False, 2: False, 3: True, 4: False}
    rates = {r["source"]: (r["documents"], r["abusive"]) for r in abuse.source_rates(scored).collect()}
    assert rates == {"s": (3, 1), None: (1, 0)}
