import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.functions import embedding as E
from auditloom.functions import similarity as G
from auditloom.functions import text as P


def one(spark, columns, *exprs):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)).select(*exprs).first()


@pytest.mark.parametrize("text, empty, full", [("q\na\nb", "a\nb", "a\nb"), ("no newline", "", "no newline"), ("", "", ""), (None, None, None)])
def test_answers(spark, text, empty, full):
    assert tuple(one(spark, {"t": text}, P.answer_or_empty("t").alias("a"), P.answer_or_text("t").alias("b"))) == (empty, full)


def test_caption_drops_one_prefix_and_cuts(spark):
    row = one(spark, {"t": "q\n Assistant: A: x"}, P.caption("t"))
    assert row[0] == "A: x"
    assert len(one(spark, {"t": "q\n" + "w " * 301}, P.caption("t"))[0].split()) == 300


def test_words_of_blank_and_null(spark):
    assert tuple(one(spark, {"t": " \t "}, F.size(P.words("t")), P.unique_ratio("t"))) == (0, 0.0)
    assert one(spark, {"t": None}, P.unique_ratio("t"))[0] is None


def test_cleaned(spark):
    d = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (1.5,)], "x double")
    assert [r[0] for r in d.select(P.cleaned("x")).collect()] == [0, 0, 0, 0, 1.5]


def test_zlib(spark):
    import zlib

    d = spark.createDataFrame([("abcabc",), ("",), (None,)], "t string").select(P.zlib_length("t"))
    assert [r[0] for r in d.collect()] == [len(zlib.compress(b"abcabc")), len(zlib.compress(b"")), None]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=7), st.lists(st.sampled_from("abcd"), max_size=7)), min_size=1, max_size=8))
def test_lcs_against_table(spark, rows):
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(G.lcs("a", "b")).collect()
    assert [r[0] for r in got] == [lcs(a, b) for a, b in rows]


def test_similarities_of_equal_and_empty(spark):
    d = spark.createDataFrame([(["a", "b"], ["a", "b"]), ([], ["a"]), (["a", "b", "c"], ["b", "c", "d"])], "a array<string>, b array<string>")
    got = d.select(G.token_overlap(F.col("a"), F.col("b")), G.rouge_l("a", "b"), G.rouge_n(F.col("a"), F.col("b"), 1), G.bleu(F.col("a"), F.col("b"), 1)).collect()
    assert tuple(got[0]) == (1, 1, 1, 1) and tuple(got[1]) == (0, 0, 0, 0)
    assert got[2][0] == 0.5 and math.isclose(got[2][2], 2 / 3) and math.isclose(got[2][3], 2 / 3)


def test_bleu_2_by_hand(spark):
    d = spark.createDataFrame([("the cat sat on it".split(), "the cat on".split())], "a array<string>, b array<string>")
    assert math.isclose(d.select(G.bleu(F.col("a"), F.col("b"), 2)).first()[0], math.exp(1 - 5 / 3) * math.sqrt(1 * 0.5), rel_tol=1e-9)


def test_embeddings(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = d.select(E.norm("a"), E.cosine("a", "b"), E.normalised("a")).collect()
    assert got[0][0] == 5 and math.isclose(got[0][1], 24 / 25) and math.isclose(got[0][2][0], 0.6)
    assert got[1][1] is None and got[1][2] == [0, 0]
