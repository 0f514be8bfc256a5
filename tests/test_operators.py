import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import evaluate, features, models, tokenstats, variants
from auditloom.operators.scoring import NGramScorer, PandasScorer
from auditloom.sources.images import decode, shrink
from auditloom.sources.tables import latest_delivery


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("range_rows", [500_000, 3])
def test_auc_against_pairs(spark, range_rows):
    rng = np.random.default_rng(1)
    rows = [("g", int(rng.random() < 0.4), float(rng.integers(0, 12))) for _ in range(80)]
    d = spark.createDataFrame([*rows, ("g", None, 3.0), ("g", 1, float("nan"))], "m string, y int, s double")
    got = evaluate.auc_and_tpr(evaluate.roc_points(d, "m", "s", "y", range_rows), "m").first()
    assert abs(got["auc"] - auc([r[1] for r in rows], [r[2] for r in rows])) < 1e-12


def test_auc_edge_cases(spark):
    d = spark.createDataFrame([("tie", 1, 1.0), ("tie", 0, 1.0), ("one", 1, 2.0), ("best", 1, 2.0), ("best", 0, 1.0)], "m string, y int, s double")
    got = {r["m"]: (r["auc"], r["tpr_at_fpr"]) for r in evaluate.auc_and_tpr(evaluate.roc_points(d, "m", "s", "y"), "m").collect()}
    assert got == {"tie": (0.5, 0.0), "one": (None, 1.0), "best": (1.0, 1.0)}
    assert evaluate.auc_and_tpr(evaluate.roc_points(d.limit(0), "m", "s", "y"), "m").count() == 0


def test_token_stats_by_hand(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (-1, -2, -3, -4, -10)] + [("b", -0.5)], "id string, lp double")
    got = {r["id"]: r for r in tokenstats.sequence_stats(d, ["id"], "lp").collect()}
    assert (got["a"]["loss"], got["a"]["min_k_prob"], got["a"]["min_k_loss"], got["a"]["max_token_loss"]) == (4, -10, 10, 10)
    assert abs(got["a"]["std_token_loss"] - 12.5**0.5) < 1e-12 and abs(got["a"]["std_token_loss_pop"] - 10**0.5) < 1e-12
    assert got["b"]["std_token_loss"] == 0 and got["b"]["num_tokens"] == 1


def test_token_drops(spark):
    d = spark.createDataFrame([("a", "one two three four"), ("b", "one two three four five"), ("c", " ".join(map(str, range(30))))], "id string, text string")
    rows = variants.token_drops(d).collect()
    assert len(rows) == 15
    for r in rows:
        n = len(r["text"].split())
        assert n == {"a": 4, "b": 4, "c": 27}[r["id"]]
        if r["id"] == "c":
            assert [int(x) for x in r["text"].split()] == sorted(int(x) for x in r["text"].split())
    assert {(r["id"], r["variant_no"], r["text"]) for r in rows} == {(r["id"], r["variant_no"], r["text"]) for r in variants.token_drops(d.repartition(3)).collect()}


def test_negatives_are_other_texts(spark):
    d = spark.createDataFrame([(str(i), f"text {i % 40}") for i in range(80)] + [("x", None)], "id string, text string")
    own = {r["id"]: r["text"] for r in d.collect()}
    rows = variants.caption_negatives(d).collect()
    assert rows and all(own[r["id"]] != r["text"] for r in rows)
    assert len({(r["id"], r["text"]) for r in rows}) == len(rows) and max(r["variant_no"] for r in rows) <= 2


def test_scorers(spark):
    d = spark.createDataFrame([("a", "x y x")], "id string, text string")
    base = spark.createDataFrame([("x z",)], "text string")
    got = NGramScorer(base, d, d).score(d, ["id"]).orderBy("pos").collect()
    assert abs(got[0]["logp_base1"] - np.log(1.1 / 2.3)) < 1e-12 and abs(got[0]["logp_ft1"] - np.log(3.1 / 5.3)) < 1e-12
    assert abs(got[1]["logp_base2"] - np.log(0.1 / (1 + 0.3))) < 1e-12

    def load():
        return lambda b: b.assign(pos=0, token=b["text"].str.split().str[0], logp=-1.0)[["id", "pos", "token", "logp"]]

    assert PandasScorer(load, "own").score(d, ["id"]).first()["logp_own"] == -1.0


def test_latest_delivery(spark):
    d = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", None, "none"), (None, 3, "x"), ("b", None, None)], "id string, loaded_at int, v string")
    assert {(r["id"], r["v"]) for r in latest_delivery(d).collect()} == {("a", "new"), ("b", None)}
    assert latest_delivery(d.limit(0)).count() == 0


def test_lira_and_three_layer(spark):
    d = spark.createDataFrame([(2.0, 0.0), (None, 3.0)], "base double, ft double")
    got = [r[0] for r in d.select(features.three_layer_ratio("base", "ft")).collect()]
    assert got == [2.0 / 1e-8, -3.0]


def test_scaler_and_models(spark):
    rng = np.random.default_rng(0)
    rows = [(int(x + rng.normal(0, 0.3) > 0), float(x), 7.0) for x in rng.normal(size=120)]
    d = spark.createDataFrame(rows, "y int, a double, b double")
    scaler = models.Scaler.fit(d, ["a", "b"])
    assert scaler.transform(d).agg(F.max(F.abs("b"))).first()[0] == 0
    model = models.fit_logistic(scaler.transform(d), ["a", "b"], "y", balanced=True)
    scored = models.probabilities(model, scaler.transform(d), ["a", "b"]).withColumn("m", F.lit("x"))
    assert evaluate.auc_and_tpr(evaluate.roc_points(scored, "m", "score", "y"), "m").first()["auc"] > 0.9


def png(pixels, filters):
    h, w, _ = pixels.shape
    raw, above = b"", np.zeros((w, 3), int)
    for y in range(h):
        line, f = pixels[y].astype(int), filters[y % len(filters)]
        left, corner = np.vstack([np.zeros((1, 3), int), line[:-1]]), np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][f]
        raw += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_round_trip():
    x = np.random.default_rng(3).integers(0, 256, (48, 48, 3)).astype(np.uint8)
    data = png(x, [0, 1, 2, 3, 4])
    assert (decode(data) == x).all() and (decode(base64.b64encode(data)) == x).all()
    rows = b"".join(bytes(x[y, :, ::-1].reshape(-1)) for y in range(47, -1, -1))
    assert (decode(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 48, 48, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows) == x).all()
    assert shrink(x).shape == (24, 24, 3) and shrink(x[:25]) is None
    for bad in (None, b"", data[: len(data) // 2], b"BM1", b"hello", data[:40]):
        assert decode(bad) is None


def test_picture_variants():
    x = np.random.default_rng(3).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    for k in range(5):
        y = variants.neighbour(x, k, 9)
        assert y.shape == x.shape and y.dtype == np.uint8 and (y == variants.neighbour(x, k, 9)).all() and (y != x).any()
    assert (variants.masked(x[:32, :32], np.random.default_rng(1)) == x[:32, :32]).all()
    assert variants.corrupted(x, np.random.default_rng(1)).std() < x.std()
