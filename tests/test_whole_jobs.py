"""Cases in which a query once did less than its whole job."""

import os
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest

from auditloom.functions import similarity
from auditloom.operators import models
from auditloom.plans import catalogue
from auditloom.sources import images
from tests.test_operators import png

DATA = "/root/testdata/sf0.001"


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_common_subsequence_of_long_texts():
    rng = random.Random(1)
    for n in (0, 1, 5, 70, 200):
        a, b = rng.choices("abcdef", k=n), rng.choices("abcdef", k=n + 3)
        assert similarity.lcs_length(a, b) == longest(a, b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data")
def test_answers_are_scored_whole(spark):
    rows = catalogue.reworded(spark, DATA).collect()
    assert max(len(r["ref"]) for r in rows) > 60
    scores = {r["id"]: r["rouge_l"] for r in catalogue.queries()["rouge_l"](spark, DATA).collect()}
    for r in rows:
        common = longest(r["ref"], r["hyp"])
        assert abs(scores[r["id"]] - (2 * common / (len(r["ref"]) + len(r["hyp"])) if common else 0)) < 1e-5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data")
@pytest.mark.parametrize("name", ["gbt_scores", "feature_importances"])
def test_boosted_trees_have_the_method_s_size(spark, monkeypatch, name):
    asked = []

    class Stop(Exception):
        pass

    def fit(train, features, label, method="combined", trees=None):
        asked.append(trees or models.BOOSTED[method][0])
        raise Stop

    monkeypatch.setattr(models, "fit_boosted", fit)
    with pytest.raises(Stop):
        catalogue.queries()[name](spark, DATA)
    assert asked == [300]


def most_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_of_pictures_is_resampled_one_by_one(spark, monkeypatch):
    class Taken:
        def mapInPandas(self, run, schema):
            self.run = run
            return self

        def distinct(self):
            return self

    monkeypatch.setattr(catalogue, "latest_pictures", lambda spark, folder: Taken())
    run = catalogue.queries()["image_model_input"](spark, "").run
    rng = np.random.default_rng(2)
    shown = [rng.integers(0, 256, (24, side, 3)).astype(np.uint8) for side in (24, 24, 48)]
    batch = pd.DataFrame({"id": [str(k) for k in range(400)], "b": [None, b"no", *[png(shown[k % 3], [0, 1, 2, 3, 4]) for k in range(398)]]})
    rows, mb = most_mb(lambda: pd.concat(run(iter([batch]))))
    assert len(rows) == 400 and mb < 40
    want = [np.full((364, 364, 3), 255, np.uint8)] * 2 + [images.bicubic(shown[k % 3]) for k in range(398)]
    assert rows["side"].eq(364).all() and list(rows["mean"]) == [round(float(x.mean()), 6) for x in want] and list(rows["spread"]) == [round(float(x.std()), 6) for x in want]


@pytest.mark.parametrize("shape", [(24, 24), (30, 48), (1, 1), (700, 500), (300, 1200), (1600, 1700)])
def test_resampled_by_strips(shape):
    x = np.random.default_rng(4).integers(0, 256, (*shape, 3)).astype(np.uint8)
    w = [images._cubic(((np.arange(n) - (np.arange(364)[:, None] + 0.5) * n / 364 + 0.5)) / max(1, n / 364)) for n in shape]
    down, across = (k / k.sum(axis=1, keepdims=True) for k in w)
    want = np.clip(np.einsum("hyc,wy->hwc", np.einsum("hy,yxc->hxc", down, x.astype(float), optimize=True), across, optimize=True), 0, 255)
    got = images.bicubic(x)
    assert got.dtype == np.uint8 and np.abs(got - want).max() < 0.5 + 1e-9


def test_a_large_picture_is_not_turned_into_numbers_whole():
    x = np.random.default_rng(5).integers(0, 256, (2000, 3000, 3)).astype(np.uint8)
    assert most_mb(lambda: images.bicubic(x))[1] < 100
    raw = np.zeros((2000, 9001), np.uint8)
    raw[:, 0], raw[1:, 1:], raw[0, 1:] = 2, np.diff(x.reshape(2000, -1), axis=0), x[0].reshape(-1)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", 3000, 2000, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(raw.tobytes(), 1)), (b"IEND", b"")]
    data = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + bytes(4) for k, d in parts)
    pixels, mb = most_mb(lambda: images.decode(data))
    assert (pixels == x).all() and mb < 120
