import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.config import checkpoint_dir, cut_lineage, release
from auditloom.functions.text import present
from auditloom.operators import models, scoring, sinks
from auditloom.sources import images, tables


def test_submissions_and_caches(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2)], "id string, score double, x int")
    sinks.write_submission(d, f"{tmp_path}/s")
    sinks.write_submission(d, f"{tmp_path}/m", name="is_member")
    sinks.write_features(d, f"{tmp_path}/f", "id", ["x"])
    rows = lambda t: sorted(tuple(r) for r in t.collect())
    assert rows(tables.read_csv_cache(spark, f"{tmp_path}/s", spark.createDataFrame([], "id string, score double").schema)) == [("a", 0.5), ("b", 0.25)]
    assert spark.read.option("header", True).csv(f"{tmp_path}/m").columns == ["id", "is_member"]
    assert rows(tables.read_csv_cache(spark, f"{tmp_path}/f", spark.createDataFrame([], "id string, x int").schema)) == [("a", 1), ("b", 2)]
    made = []
    make = lambda: made.append(1) or d
    assert [sinks.cached(spark, str(tmp_path), "c", {"k": k}, make).count() for k in (1, 1, 2)] == [2, 2, 2] and len(made) == 2
    (tmp_path / "j.json").write_text('[{"id": "a", "loss": 1.5}, {"id": "b", "loss": null}]')
    assert rows(tables.read_json_cache(spark, f"{tmp_path}/j.json", spark.createDataFrame([], "id string, loss double").schema)) == [("a", 1.5), ("b", None)]
    assert sinks.markdown(d.orderBy("id")).splitlines()[2] == "| a | 0.5 | 1 |"
    assert present(d, ["x", "y", "id"]) == ["x", "id"]


def test_tables_are_released(spark):
    t = cut_lineage(spark.range(3).toDF("k"))
    assert t.count() == 3 and checkpoint_dir(spark)
    path = t.inputFiles()[0].removeprefix("file://")
    release()
    with pytest.raises(FileNotFoundError):
        open(path, "rb")


def test_retries_and_missing_sides(spark):
    tried = []

    def make():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("not yet")
        return spark.range(2)

    assert tables.with_retries(make, wait=0).count() == 2 and len(tried) == 3
    with pytest.raises(OSError):
        tables.with_retries(lambda: (_ for _ in ()).throw(OSError()), attempts=2, wait=0)
    left = spark.createDataFrame([("a",), ("b",)], "id string")
    assert tables.join_if_present(left, None).count() == 2 and tables.join_if_present(left, left.limit(1)).count() == 1


def test_pictures_for_models():
    x = np.arange(24 * 24 * 3, dtype=np.uint8).reshape(24, 24, 3)
    assert (images.bicubic(x, 24, 24) == x).all()
    assert images.bicubic(np.full((7, 9, 3), 80, np.uint8)).shape == (364, 364, 3) and (images.bicubic(np.full((500, 400, 3), 80, np.uint8)) == 80).all()
    assert images.decode_or_blank(b"no").shape == (512, 512, 3)


def test_attached_models(spark):
    d = spark.createDataFrame([("a", "one two"), ("b", "")], "id string, t string")
    got = {(r["id"], r["no"]): r["text"] for r in scoring.PandasGenerator(lambda: lambda prompts, no: [f"{p}!{no}" for p in prompts], 2).generate(d, "id", "t").collect()}
    assert got == {("a", 0): "one two!0", ("a", 1): "one two!1", ("b", 0): "!0", ("b", 1): "!1"}
    vectors = {r["id"]: r["embedding"] for r in scoring.PandasEmbedder(lambda: lambda v: [[len(x), 0.0] for x in v]).embed(d, "id", "t").collect()}
    assert vectors == {"a": [1.0, 0.0], "b": [0.0, 0.0]}


def test_pictures_with_texts(spark):
    from tests.test_operators import png  # a small encoder

    flat = np.full((24, 24, 3), 100, np.uint8)
    d = spark.createDataFrame([("a", bytearray(png(flat, [0] * 24)), "four words"), ("c", bytearray(b"cut"), "x"), ("n", None, "x"), ("e", bytearray(png(flat, [0] * 24)), None)], "id string, b binary, t string")
    rows = scoring.VisualScorer(lambda: scoring.contrast_losses, ("ft", "base")).score(d, "id", "b", "t", 8).collect()
    assert {r["id"] for r in rows} == {"a"} and len(rows) == 14
    assert {round(r["loss"], 9) for r in rows if r["kind"] == "orig" and r["model"] == "ft"} == {4.5}
    assert next(r["loss"] for r in rows if r["kind"] == "image" and r["no"] == 0 and r["model"] == "ft") < 4.5  # noise adds contrast


def test_plain_perplexity_is_not_cut(spark):
    from auditloom.operators.tokenstats import sequence_stats

    row = sequence_stats(spark.createDataFrame([("a", -800.0)], "id string, logp double"), ["id"], "logp").first()
    assert row["perplexity"] == float("inf") and row["perplexity_clamped"] < float("inf")


def test_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), int(y), float(y + rng.normal(0, 0.5)), float(rng.normal())) for i, y in enumerate(rng.integers(0, 2, 200))]
    d = spark.createDataFrame(rows, "id string, y int, good double, noise double")
    folds = models.cross_validated(d, ["good"], "y", folds=3).collect()
    assert len(folds) == 3 and all(r["auc"] > 0.8 for r in folds)
    assert models.forward_selection(d.withColumn("same", F.lit(1.0)), ["noise", "good"], "y", most=1, folds=2)[0][0] == "good"
