"""The queries of the audits, each over its whole tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.config import DEFAULT
from auditloom.functions import embedding as E
from auditloom.functions import similarity as G
from auditloom.functions import text as P
from auditloom.operators import evaluate, features, models, scoring, sinks, tokenstats, variants
from auditloom.sources.images import decode, model_input
from auditloom.sources.tables import latest_delivery, read_table, spread
from auditloom.streaming.scores import windowed_losses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- shared parts of the SQL texts

WORDS = r"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"
NL = "chr(10)"
ANSWER = f"CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, strpos(text, {NL}) + 1) ELSE {{other}} END"
QUESTION = f"CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, 1, strpos(text, {NL}) - 1) ELSE text END"


def latest_sql(name: str, table: str, columns: str) -> str:
    return f"{name} AS (SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM {table} WHERE id IS NOT NULL) WHERE rn = 1)"


S = latest_sql("s", "text_samples", "id, text, is_member, split, source")
Q = latest_sql("q", "image_text_samples", "id, text, is_member, split, source, type")


def w(t: str) -> str:
    return WORDS.replace("{t}", t)


def kept_sql(words: str) -> str:
    x = f"(({SEED} + (i - 1) * {variants.STEP}) % {variants.PRIME})"
    ranked = f"list_sort(list_transform({words}, lambda x, i: {{'h': {x} * {x} % {variants.PRIME}, 'i': i, 'w': x}}))"
    left = f"list_slice({ranked}, greatest(1, len({words}) * 10 // 100) + 1, len({words}))"
    return f"array_to_string(list_transform(list_sort(list_transform({left}, lambda y: {{'i': y.i, 'w': y.w}})), lambda z: z.w), ' ')"


SEED = f"(('0x' || substr(md5(concat_ws('-', id, no)), 1, 8))::BIGINT % {variants.PRIME})"
DROPS = f"d AS (SELECT id, no, CASE WHEN len(ws) < 5 THEN text ELSE {kept_sql('ws')} END AS text FROM (SELECT id, text, {w('text')} AS ws, unnest(range(5)) AS no FROM s WHERE text IS NOT NULL))"
VARIANTS = "v AS (SELECT id, 'orig' AS kind, 0 AS no, text FROM s WHERE text IS NOT NULL UNION ALL SELECT id, 'lower', 0, lower(text) FROM s WHERE text IS NOT NULL UNION ALL SELECT id, 'drop', no, text FROM d)"


def token_sql(name: str, source: str, keys: str, most: int | None = 1024) -> str:
    ws = f"list_slice({w('text')}, 1, {most})" if most else w("text")
    return f"{name} AS (SELECT {keys}, unnest(ws) AS token, unnest(range(len(ws))) AS pos, unnest(list_concat(['<s>'], list_slice(ws, 1, len(ws) - 1))) AS prev FROM (SELECT {keys}, {ws} AS ws FROM {source}) WHERE len(ws) > 0)"


LM = (
    "c AS (SELECT 0 AS m, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 0, text FROM control_items WHERE text IS NOT NULL UNION ALL SELECT 1, text FROM s WHERE is_member = 1 AND text IS NOT NULL), "
    + token_sql("ct", "c", "m", None)
    + ", bg AS (SELECT prev, token, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS cb, count(*) AS cf FROM ct GROUP BY ALL)"
    + ", ug AS (SELECT token, sum(cb) AS ub, sum(cf) AS uf FROM bg GROUP BY ALL), pc AS (SELECT prev, sum(cb) AS pb, sum(cf) AS pf FROM bg GROUP BY ALL)"
    + ", tn AS (SELECT sum(ub) AS nb, sum(uf) AS nf FROM ug), "
    + token_sql("et", "s", "id", None)
    + ", vs AS (SELECT count(DISTINCT token) AS v FROM (SELECT token FROM et UNION ALL SELECT token FROM ct))"
)


def lp(c: str, n: str) -> str:
    return f"ln((coalesce({c}, 0) + 0.1::DOUBLE) / (coalesce({n}, 0) + 0.1::DOUBLE * v))"


SCORED = (
    token_sql("vt", "v", "id, kind, no")
    + f", sc AS (SELECT id, kind, no, pos, token, {lp('ub', 'nb')} AS logp_base1, {lp('uf', 'nf')} AS logp_ft1, {lp('cb', 'pb')} AS logp_base2, {lp('cf', 'pf')} AS logp_ft2 FROM vt LEFT JOIN bg USING (prev, token) LEFT JOIN ug USING (token) LEFT JOIN pc USING (prev), tn, vs)"
)
ORIG = "v AS (SELECT id, 'orig' AS kind, 0 AS no, text FROM s WHERE text IS NOT NULL)"
STATS = ", ".join(
    f"avg(-logp_{m}) AS loss_{m}, max(-logp_{m}) AS max_{m}, coalesce(stddev_samp(logp_{m}), 0) AS std_{m}, stddev_pop(logp_{m}) AS pstd_{m}, list_sort(list(logp_{m})) AS a_{m}" for m in ("base2", "ft2")
)
MINK = "list_sum(list_slice(a_{m}, 1, greatest(1, len(a_{m}) * 20 // 100))) / greatest(1, len(a_{m}) * 20 // 100)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(*columns: str) -> list:
    return [(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in columns]  # no negative zero


def r6_sql(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in columns)


# ---- tables


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return latest_delivery(read_table(spark, folder, "text_samples").select("id", "text", "is_member", "split", "source", "loaded_at"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return latest_delivery(read_table(spark, folder, "image_text_samples").select("id", "text", "is_member", "split", "source", "type", "loaded_at"))


def scorer(spark: SparkSession, folder: str, own: DataFrame) -> scoring.NGramScorer:
    documents = spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id", scan=True)
    base = documents.select("text").unionByName(read_table(spark, folder, "control_items").select("text")).where("text is not null")
    return scoring.NGramScorer(base, own.where("is_member = 1 and text is not null"), own.where("text is not null"))


def all_variants(own: DataFrame) -> DataFrame:
    own = spread(own.where("text is not null"), "id")
    columns = ("id", "kind", "no", "text")
    orig = own.select("id", F.lit("orig").alias("kind"), F.lit(0).alias("no"), "text")
    lower = variants.lowercase(own).withColumn("kind", F.lit("lower")).withColumnRenamed("variant_no", "no").select(*columns)
    drops = variants.token_drops(own).withColumn("kind", F.lit("drop")).withColumnRenamed("variant_no", "no").select(*columns)
    return orig.unionByName(lower).unionByName(drops)


def scored_originals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    own = samples(spark, folder)
    return own, scorer(spark, folder, own).score(spread(own.where("text is not null"), "id"), ["id"])


def variant_losses(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    own = samples(spark, folder)
    kinds = [("orig", 0), ("lower", 0), *[("drop", i) for i in range(DEFAULT.neighbours)]]
    return own, scorer(spark, folder, own).variant_losses(all_variants(own), "id", kinds)


# ---- inspection

_STAT = "count({c}) AS n, round(coalesce(avg({c}), 0), 6) AS mean_len, coalesce(max({c}), 0) AS max_len, coalesce(min({c}), 0) AS min_len"
SPLITS = ("train", "validation", "test")


@query("split_length_stats", with_(S, "k AS (SELECT unnest(['train', 'validation', 'test']) AS split)") + f"SELECT k.split, {_STAT.replace('{c}', 'length(s.text)')} FROM k LEFT JOIN s USING (split) GROUP BY k.split")
def split_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A1, A3: an empty split has zeros."""
    names = spark.createDataFrame([(x,) for x in SPLITS], "split string")
    n = F.length("text")
    got = samples(spark, folder).groupBy("split").agg(F.count(n).alias("n"), F.avg(n).alias("mean_len"), F.max(n).alias("max_len"), F.min(n).alias("min_len"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(got, "split", "left").select("split", zero("n"), F.round(F.coalesce("mean_len", F.lit(0.0)), 6).alias("mean_len"), zero("max_len"), zero("min_len"))


@query("split_text_stats", with_(Q) + "SELECT split, count(*) AS n, round(avg(l), 6) AS mean_len, round(median(l), 6) AS median_len, round(stddev_pop(l), 6) AS std_len, max(l) AS max_len, min(l) AS min_len FROM (SELECT split, length(trim(concat_ws(' ', id, text, source))) AS l FROM q) GROUP BY split")
def split_text_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A2, P14."""
    d = pairs(spark, folder).select("split", P.joined_length("id", "text", "source").alias("l"))
    return d.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("l"), 6).alias("mean_len"), F.round(F.percentile("l", F.lit(0.5)), 6).alias("median_len"), F.round(F.stddev_pop("l"), 6).alias("std_len"), F.max("l").alias("max_len"), F.min("l").alias("min_len"))


@query("sample_preview", with_(Q) + "SELECT id, split, type, length(text) AS n_chars FROM q ORDER BY id LIMIT 3")
def sample_preview(spark: SparkSession, folder: str) -> DataFrame:
    """K8: the limit is the report's."""
    return sinks.preview(pairs(spark, folder).withColumn("n_chars", F.length("text")), ["id", "split", "type", "n_chars"], "id")


@query("record_lengths", with_(S) + "SELECT id, length(to_json({'id': id, 'text': text, 'is_member': is_member, 'split': split, 'source': source})::VARCHAR) AS n_chars FROM s")
def record_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Length of the JSON record."""
    return samples(spark, folder).select("id", P.record_length("id", "text", "is_member", "split", "source").alias("n_chars"))


# ---- projections


@query("qa_split_empty", with_(Q) + f"SELECT id, {QUESTION} AS question, {ANSWER.replace('{other}', chr(39) * 2)} AS answer FROM q WHERE text IS NOT NULL")
def qa_split_empty(spark: SparkSession, folder: str) -> DataFrame:
    """P1."""
    return pairs(spark, folder).where("text is not null").select("id", P.question("text").alias("question"), P.answer_or_empty("text").alias("answer"))


@query("qa_split_full", with_(Q) + f"SELECT id, {ANSWER.replace('{other}', 'text')} AS answer FROM q WHERE text IS NOT NULL")
def qa_split_full(spark: SparkSession, folder: str) -> DataFrame:
    """P2."""
    return pairs(spark, folder).where("text is not null").select("id", P.answer_or_text("text").alias("answer"))


_CAPTION = rf"regexp_replace(regexp_replace({ANSWER.replace('{other}', 'text')}, '^\s+|\s+$', '', 'g'), '^(Assistant:|ASSISTANT:|assistant:|A:)', '')"


@query("caption_prep", with_(Q) + f"SELECT id, array_to_string(list_slice({w(_CAPTION)}, 1, 300), ' ') AS caption FROM q WHERE text IS NOT NULL")
def caption_prep(spark: SparkSession, folder: str) -> DataFrame:
    """P3."""
    return pairs(spark, folder).where("text is not null").select("id", P.caption("text").alias("caption"))


@query("truncate_words", with_(S) + f"SELECT id, array_to_string(list_slice({w('text')}, 1, 300), ' ') AS text FROM s WHERE text IS NOT NULL")
def truncate_words(spark: SparkSession, folder: str) -> DataFrame:
    """P4."""
    return samples(spark, folder).where("text is not null").select("id", P.first_words("text", DEFAULT.caption_words).alias("text"))


@query("truncate_chars", with_(S) + "SELECT id, substr(text, 1, 300) AS text FROM s WHERE text IS NOT NULL")
def truncate_chars(spark: SparkSession, folder: str) -> DataFrame:
    """P5."""
    return samples(spark, folder).where("text is not null").select("id", P.first_chars("text").alias("text"))


@query("text_features", with_(S) + f"SELECT id, len(ws) AS text_len, round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws))::DOUBLE / len(ws) ELSE 0 END, 6) AS unique_ratio FROM (SELECT id, {w('text')} AS ws FROM s WHERE text IS NOT NULL)")
def text_features(spark: SparkSession, folder: str) -> DataFrame:
    """P7, P9, P10."""
    return samples(spark, folder).where("text is not null").select("id", F.size(P.words("text")).cast("bigint").alias("text_len"), F.round(P.unique_ratio("text"), 6).alias("unique_ratio"))


@query("chat_prompts", with_(Q) + f"SELECT id, 'USER: <image>' || {NL} || {QUESTION} || {NL} || 'ASSISTANT: ' || {ANSWER.replace('{other}', chr(39) * 2)} AS prompt, 'USER: <image>' || {NL} || 'Describe this image.' || {NL} || 'ASSISTANT: ' || {ANSWER.replace('{other}', chr(39) * 2)} AS plain_prompt FROM q WHERE text IS NOT NULL")
def chat_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """P15, P16."""
    return pairs(spark, folder).where("text is not null").select("id", P.chat_prompt("text").alias("prompt"), P.chat_prompt("text", False).alias("plain_prompt"))


@query("seeded_sample", with_(S) + "SELECT id FROM s ORDER BY md5('42-' || id), id LIMIT 500")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sampling operator, so it is limited."""
    return samples(spark, folder).orderBy(F.md5(F.concat(F.lit(f"{DEFAULT.seed}-"), "id")), "id").limit(500).select("id")


# ---- variants


@query("lowercase_variant", with_(S) + "SELECT id, 0 AS variant_no, lower(text) AS text FROM s WHERE text IS NOT NULL")
def lowercase_variant(spark: SparkSession, folder: str) -> DataFrame:
    return variants.lowercase(samples(spark, folder).where("text is not null"))


@query("token_drop_neighbors", with_(S, DROPS) + "SELECT id, no AS variant_no, text FROM d")
def token_drop_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """V1."""
    return variants.token_drops(spread(samples(spark, folder).where("text is not null"), "id")).withColumn("variant_no", F.col("variant_no").cast("bigint"))


_ADROP = f"d AS (SELECT id, no, CASE WHEN len(ws) < 5 THEN text ELSE qq || {NL} || {kept_sql('ws')} END AS text FROM (SELECT id, text, qq, {w('aa')} AS ws, unnest(range(5)) AS no FROM (SELECT id, text, {QUESTION} AS qq, {ANSWER.replace('{other}', chr(39) * 2)} AS aa FROM q WHERE text IS NOT NULL)))"


@query("answer_drop_neighbors", with_(Q, _ADROP) + "SELECT id, no AS variant_no, text FROM d")
def answer_drop_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """V2."""
    return variants.answer_drops(spread(pairs(spark, folder).where("text is not null"), "id")).withColumn("variant_no", F.col("variant_no").cast("bigint"))


NEGATIVES = (
    "pl AS (SELECT p, substr(md5(p), 1, 2) AS b, row_number() OVER (PARTITION BY substr(md5(p), 1, 2) ORDER BY md5(p)) - 1 AS i FROM (SELECT DISTINCT text AS p FROM s WHERE text IS NOT NULL)), "
    "pn AS (SELECT b, count(*) AS n FROM pl GROUP BY b), ak AS (SELECT id, text, a, md5(concat_ws('-', id, a)) AS k FROM (SELECT id, text, unnest(range(8)) AS a FROM s WHERE text IS NOT NULL)), "
    "mt AS (SELECT ak.id, pl.p, min(ak.a) AS a FROM ak JOIN pn ON pn.b = substr(ak.k, 1, 2) JOIN pl ON pl.b = pn.b AND pl.i = ('0x' || substr(md5(ak.k), 1, 8))::BIGINT % pn.n WHERE pl.p <> ak.text GROUP BY ak.id, pl.p), "
    "ng AS (SELECT id, p AS text, row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS no FROM mt)"
)


@query("caption_negatives", with_(S, NEGATIVES) + "SELECT id, no AS variant_no, text FROM ng WHERE no < 3")
def caption_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """V4, J4."""
    return variants.caption_negatives(samples(spark, folder)).withColumn("variant_no", F.col("variant_no").cast("bigint"))


# ---- scoring and token statistics

LOGP = tuple(f"logp_{m}" for m in scoring.MODELS)


@query("token_logprobs", with_(S, LM, ORIG, SCORED) + f"SELECT id, pos, token, {r6_sql(*LOGP)} FROM sc")
def token_logprobs(spark: SparkSession, folder: str) -> DataFrame:
    """L1, L3 for the four built-in models."""
    return scored_originals(spark, folder)[1].select("id", F.col("pos").cast("bigint").alias("pos"), "token", *r6(*LOGP))


@query("baseline_score", with_(S, LM, ORIG, SCORED) + "SELECT id, round(-avg(-logp_ft2), 6) AS score FROM sc GROUP BY id")
def baseline_score(spark: SparkSession, folder: str) -> DataFrame:
    """F1."""
    return tokenstats.losses(scored_originals(spark, folder)[1], ["id"], ("ft2",)).select("id", F.round(-F.col("loss_ft2"), 6).alias("score"))


@query("reference_score", with_(S, LM, ORIG, SCORED) + "SELECT id, round(avg(-logp_base2) - avg(-logp_ft2), 6) AS score FROM sc GROUP BY id")
def reference_score(spark: SparkSession, folder: str) -> DataFrame:
    """F2."""
    return tokenstats.losses(scored_originals(spark, folder)[1], ["id"], ("base2", "ft2")).select("id", F.round(F.col("loss_base2") - F.col("loss_ft2"), 6).alias("score"))


@query("min_k_prob", with_(S, LM, ORIG, SCORED) + f"SELECT id, round({MINK.replace('{m}', 'ft2')}, 6) AS min_k_prob FROM (SELECT id, {STATS} FROM sc GROUP BY id)")
def min_k_prob(spark: SparkSession, folder: str) -> DataFrame:
    """T4."""
    return tokenstats.sequence_stats(scored_originals(spark, folder)[1], ["id"], "logp_ft2").select("id", *r6("min_k_prob"))


_SEVEN = ("loss", "perplexity", "perplexity_clamped", "min_k_prob", "min_k_loss", "max_token_loss", "std_token_loss", "std_token_loss_pop")


@query(
    "token_stats",
    with_(S, LM, ORIG, SCORED)
    + f"SELECT id, n AS num_tokens, {r6_sql(*_SEVEN)} FROM (SELECT id, n, loss_ft2 AS loss, exp(loss_ft2) AS perplexity, exp(least(loss_ft2, 100)) AS perplexity_clamped, {MINK.replace('{m}', 'ft2')} AS min_k_prob, -({MINK.replace('{m}', 'ft2')}) AS min_k_loss, max_ft2 AS max_token_loss, std_ft2 AS std_token_loss, pstd_ft2 AS std_token_loss_pop FROM (SELECT id, count(*) AS n, {STATS} FROM sc GROUP BY id))",
)
def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    """T1-T9."""
    return tokenstats.sequence_stats(scored_originals(spark, folder)[1], ["id"], "logp_ft2").select("id", "num_tokens", *r6(*_SEVEN))


_PAIRED = "v AS (SELECT id, 'orig' AS kind, 0 AS no, text FROM q WHERE text IS NOT NULL)"


@query("answer_only_loss", with_(S, Q, LM, _PAIRED, SCORED, f"st AS (SELECT id, len({w(QUESTION)}) AS start FROM q WHERE text IS NOT NULL)") + "SELECT id, round(coalesce(avg(CASE WHEN pos >= start THEN -logp_ft2 END), avg(-logp_ft2)), 6) AS answer_loss FROM sc JOIN st USING (id) GROUP BY id")
def answer_only_loss(spark: SparkSession, folder: str) -> DataFrame:
    """The loss of the pairs' answers; of all if there is nothing after the question."""
    own = spread(pairs(spark, folder).where("text is not null"), "id")
    scored = scorer(spark, folder, samples(spark, folder)).score(own, ["id"])
    start = own.select("id", F.size(P.words(P.question("text"))).alias("start"))
    return tokenstats.answer_loss(scored.join(start, "id"), ["id"], "logp_ft2", "start").select("id", *r6("answer_loss"))


@query("zlib_ratio")
def zlib_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """P12, T10-T12."""
    own, scored = scored_originals(spark, folder)
    loss = tokenstats.losses(scored, ["id"], ("ft2",)).join(own.select("id", P.zlib_length("text").alias("n"), P.zlib_length(P.answer_or_empty("text")).alias("na")), "id")
    a, b = tokenstats.zlib_ratios(F.col("loss_ft2"), F.col("n"))
    return loss.select("id", F.round(a, 9).alias("zlib_ratio_a"), F.round(b, 9).alias("zlib_ratio_b"), F.round(F.col("loss_ft2") / F.greatest("na", F.lit(1)), 9).alias("zlib_ratio_c"))


# ---- features

_VL = "vl AS (SELECT id, kind, no, " + ", ".join(f"avg(-logp_{m}) AS l_{m}" for m in scoring.MODELS) + " FROM sc GROUP BY id, kind, no)"
_CASING = ("loss_orig", "loss_lower", "loss_diff", "loss_ratio")


@query("casing_features", with_(S, LM, DROPS, VARIANTS, SCORED, _VL, "o AS (SELECT id, max(CASE WHEN kind = 'orig' THEN l_ft2 END) AS loss_orig, max(CASE WHEN kind = 'lower' THEN l_ft2 END) AS loss_lower FROM vl GROUP BY id)") + "SELECT id, round(loss_orig, 6) AS loss_orig, round(loss_lower, 6) AS loss_lower, round(loss_lower - loss_orig, 6) AS loss_diff, round(loss_lower / (loss_orig + 1e-8), 6) AS loss_ratio FROM o")
def casing_features(spark: SparkSession, folder: str) -> DataFrame:
    """F3."""
    _, loss = variant_losses(spark, folder)
    own = loss.where("kind <> 'drop'").groupBy("id").agg(*[F.max(F.when(F.col("kind") == k, F.col("loss_ft2"))).alias(f"loss_{k}") for k in ("orig", "lower")])
    return own.withColumn("loss_diff", F.col("loss_lower") - F.col("loss_orig")).withColumn("loss_ratio", P.guarded_ratio(F.col("loss_lower"), F.col("loss_orig"))).select("id", *r6(*_CASING))


_F16 = ("loss_ft1", "loss_ft2", "loss_base1", "loss_base2", "ref_diff_1", "ref_diff_2", "ref_ratio_1", "ref_ratio_2", "nb_gap_ft1", "nb_gap_ft2", "nb_std_ft1", "nb_std_ft2", "loss_diff_ft", "gap_diff", "unique_ratio")
_N16 = (
    "o AS (SELECT id, " + ", ".join(f"max(CASE WHEN kind = 'orig' THEN l_{m} END) AS loss_{m}" for m in scoring.MODELS) + ", " + ", ".join(f"avg(CASE WHEN kind = 'drop' THEN l_{m} END) AS nbm_{m}, stddev_pop(CASE WHEN kind = 'drop' THEN l_{m} END) AS nbs_{m}" for m in scoring.MODELS) + " FROM vl GROUP BY id), "
    f"tf AS (SELECT id, len(ws) AS text_len, CASE WHEN len(ws) > 0 THEN len(list_distinct(ws))::DOUBLE / len(ws) ELSE 0 END AS unique_ratio FROM (SELECT id, {w('text')} AS ws FROM s WHERE text IS NOT NULL)), "
    "f16 AS (SELECT id, loss_ft1, loss_ft2, loss_base1, loss_base2, loss_base1 - loss_ft1 AS ref_diff_1, loss_base2 - loss_ft2 AS ref_diff_2, loss_ft1 / (loss_base1 + 1e-8) AS ref_ratio_1, loss_ft2 / (loss_base2 + 1e-8) AS ref_ratio_2, nbm_ft1 - loss_ft1 AS nb_gap_ft1, nbm_ft2 - loss_ft2 AS nb_gap_ft2, nbs_ft1 AS nb_std_ft1, nbs_ft2 AS nb_std_ft2, loss_ft1 - loss_ft2 AS loss_diff_ft, (nbm_ft1 - loss_ft1) - (nbm_ft2 - loss_ft2) AS gap_diff, text_len, unique_ratio, nbm_base2 - loss_base2 AS nb_gap_base2 FROM o JOIN tf USING (id))"
)


def neighbourhood_table(spark: SparkSession, folder: str) -> DataFrame:
    own, loss = variant_losses(spark, folder)
    stats = [a for m in scoring.MODELS for a in features.neighbour_stats(loss, "id", "kind", f"loss_{m}", "drop")]
    wide = loss.groupBy("id").agg(*[F.max(F.when(F.col("kind") == "orig", F.col(f"loss_{m}"))).alias(f"o_{m}") for m in scoring.MODELS], *stats)
    text = own.where("text is not null").select("id", "is_member", "split", F.size(P.words("text")).cast("bigint").alias("text_len"), P.unique_ratio("text").alias("unique_ratio"))
    gap = lambda m: F.col(f"nb_mean_loss_{m}") - F.col(f"o_{m}")
    (d1, q1), (d2, q2) = features.reference("o_base1", "o_ft1"), features.reference("o_base2", "o_ft2")
    return wide.join(text, "id").select(
        "id", "is_member", "split", *[F.col(f"o_{m}").alias(f"loss_{m}") for m in scoring.MODELS], d1.alias("ref_diff_1"), d2.alias("ref_diff_2"), q1.alias("ref_ratio_1"), q2.alias("ref_ratio_2"),
        gap("ft1").alias("nb_gap_ft1"), gap("ft2").alias("nb_gap_ft2"), F.col("nb_std_loss_ft1").alias("nb_std_ft1"), F.col("nb_std_loss_ft2").alias("nb_std_ft2"),
        (F.col("o_ft1") - F.col("o_ft2")).alias("loss_diff_ft"), (gap("ft1") - gap("ft2")).alias("gap_diff"), "text_len", "unique_ratio", gap("base2").alias("nb_gap_base2"),
    )


@query("neighborhood_features_16", with_(S, LM, DROPS, VARIANTS, SCORED, _VL, _N16) + f"SELECT id, text_len, {r6_sql(*_F16)} FROM f16")
def neighborhood_features_16(spark: SparkSession, folder: str) -> DataFrame:
    """F4-F7, P9, P10, A4."""
    return neighbourhood_table(spark, folder).select("id", "text_len", *r6(*_F16))


@query("neighborhood_features_text", with_(S, LM, DROPS, VARIANTS, SCORED, _VL, _N16) + "SELECT id, round(ref_diff_2, 6) AS ref_diff, round(ref_ratio_2, 6) AS ref_ratio, round(nb_gap_ft2, 6) AS text_nb_gap_ft, round(nb_gap_base2, 6) AS text_nb_gap_base, round(nb_std_ft2, 6) AS text_nb_std_ft, round(nb_gap_ft2 - nb_gap_base2, 6) AS text_nb_relative_gap FROM f16")
def neighborhood_features_text(spark: SparkSession, folder: str) -> DataFrame:
    """F8, F9."""
    t = neighbourhood_table(spark, folder)
    return t.select("id", F.round("ref_diff_2", 6).alias("ref_diff"), F.round("ref_ratio_2", 6).alias("ref_ratio"), F.round("nb_gap_ft2", 6).alias("text_nb_gap_ft"), F.round("nb_gap_base2", 6).alias("text_nb_gap_base"), F.round("nb_std_ft2", 6).alias("text_nb_std_ft"), F.round(F.col("nb_gap_ft2") - F.col("nb_gap_base2"), 6).alias("text_nb_relative_gap"))


@query("three_layer_scores", with_(S, NEGATIVES, LM, "v AS (SELECT id, 'orig' AS kind, 0 AS no, text FROM s WHERE text IS NOT NULL UNION ALL SELECT id, 'other', no, text FROM ng WHERE no < 3)", SCORED, _VL) + "SELECT id, round(CASE WHEN base IS NULL THEN -ft ELSE base / (ft + 1e-8) END, 6) AS loss_ratio, round(coalesce(other - ft, 0), 6) AS caption_contrast FROM (SELECT id, max(CASE WHEN kind = 'orig' THEN l_base2 END) AS base, max(CASE WHEN kind = 'orig' THEN l_ft2 END) AS ft, avg(CASE WHEN kind = 'other' THEN l_ft2 END) AS other FROM vl GROUP BY id) WHERE ft IS NOT NULL")
def three_layer_scores(spark: SparkSession, folder: str) -> DataFrame:
    """F13, F14."""
    own = samples(spark, folder).where("text is not null")
    other = variants.caption_negatives(own).select("id", F.lit("other").alias("kind"), F.col("variant_no").alias("no"), "text")
    every = own.select("id", F.lit("orig").alias("kind"), F.lit(0).alias("no"), "text").unionByName(other)
    loss = scorer(spark, folder, samples(spark, folder)).variant_losses(every, "id", [("orig", 0), *[("other", i) for i in range(DEFAULT.negatives)]])
    one = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = loss.groupBy("id").agg(one("orig", "loss_base2").alias("base"), one("orig", "loss_ft2").alias("ft"), F.avg(F.when(F.col("kind") == "other", F.col("loss_ft2"))).alias("other")).where("ft is not null")
    return wide.select("id", F.round(features.three_layer_ratio("base", "ft"), 6).alias("loss_ratio"), F.round(features.contrast(F.col("other"), F.col("ft")), 6).alias("caption_contrast"))


# ---- cached features

LF = "lf AS (SELECT id, model, loss, min_k_prob AS min_k, perplexity, max_token_loss AS mx, std_token_loss AS sd, zlib_ratio AS zl, is_member FROM (SELECT *, row_number() OVER (PARTITION BY id, model ORDER BY loaded_at DESC NULLS LAST, scored_at DESC NULLS LAST, batch_no DESC NULLS LAST, row_no DESC NULLS LAST, loss DESC) AS rn FROM loss_features WHERE id IS NOT NULL AND isfinite(loss)) WHERE rn = 1)"
_LF = {"loss": "loss", "min_k": "min_k_prob", "perplexity": "perplexity", "mx": "max_token_loss", "sd": "std_token_loss", "zl": "zlib_ratio"}
MODEL_NAMES = ("ft1", "ft2", "base1", "base2")


def loss_cache(spark: SparkSession, folder: str) -> DataFrame:
    """One row an id and model of the cached losses: the row loaded, then scored last. ``max_by`` combines before the shuffle, so the control item that every batch scores costs one row a task."""
    times = ("loaded_at", "scored_at", "batch_no", "row_no")
    d = read_table(spark, folder, "loss_features").select("id", "model", "is_member", *times, *_LF.values()).where("id is not null and loss is not null and not isnan(loss) and abs(loss) < double('Infinity')")
    order = F.struct(*[x for c in times for x in (F.col(c).isNotNull(), F.col(c))], "loss")
    own = F.struct(*[F.col(v).alias(k) for k, v in _LF.items()], "is_member")
    return d.groupBy("id", "model").agg(F.max_by(own, order).alias("x")).select("id", "model", "x.*")


@query("loss_pivot", with_(LF) + "SELECT id, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN loss END), 6) AS loss_{m}" for m in MODEL_NAMES) + " FROM lf GROUP BY id")
def loss_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """The models' losses of an id side by side."""
    return features.pivot_models(loss_cache(spark, folder), "id", "model", ["loss"], MODEL_NAMES).select("id", *r6(*[f"loss_{m}" for m in MODEL_NAMES]))


_LIRA = ("loss_ratio", "loss_diff", "min_k_diff", "perplexity_ratio", "max_loss_diff", "std_loss_diff", "zlib_ratio_diff", "norm_loss_improvement")
_PV = "pv AS (SELECT id, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN {c} END) AS {c}_{m}" for m in ("ft1", "base1") for c in _LF) + " FROM lf GROUP BY id)"


@query("lira_features", with_(LF, _PV) + f"SELECT id, {r6_sql(*_LIRA)} FROM (SELECT id, loss_base1 / (loss_ft1 + 1e-8) AS loss_ratio, loss_base1 - loss_ft1 AS loss_diff, min_k_ft1 - min_k_base1 AS min_k_diff, perplexity_base1 / (perplexity_ft1 + 1e-8) AS perplexity_ratio, mx_base1 - mx_ft1 AS max_loss_diff, sd_base1 - sd_ft1 AS std_loss_diff, zl_base1 - zl_ft1 AS zlib_ratio_diff, (loss_base1 - loss_ft1) / (loss_base1 + 1e-8) AS norm_loss_improvement FROM pv WHERE loss_ft1 IS NOT NULL AND loss_base1 IS NOT NULL)")
def lira_features(spark: SparkSession, folder: str) -> DataFrame:
    """F12."""
    p = features.pivot_models(loss_cache(spark, folder), "id", "model", list(_LF), ("ft1", "base1")).where("loss_ft1 is not null and loss_base1 is not null")
    named = {"loss": "loss", "min_k": "min_k", "perplexity": "perplexity", "max": "mx", "std": "sd", "zlib": "zl"}
    return p.select("id", *features.lira({k: f"{v}_ft1" for k, v in named.items()}, {k: f"{v}_base1" for k, v in named.items()})).select("id", *r6(*_LIRA))


CF, TF, NF = latest_sql("cf", "clip_features", "*"), latest_sql("tf3", "three_layer_features", "*"), latest_sql("nf", "neighborhood_features", "*")
CLIP = ("clip_img_text_sim", "clip_img_question_sim", "clip_text_complexity")
THREE = ("loss_ratio", "caption_contrast", "corruption_sensitivity")
NB17 = ("loss_ft", "loss_base", "ref_diff", "ref_ratio", "text_nb_gap_ft", "text_nb_gap_base", "text_nb_std_ft", "text_nb_relative_gap", "img_nb_gap_ft", "img_nb_gap_base", "img_nb_std_ft", "img_nb_relative_gap", "cross_modal_gap", "binding_score", "total_nb_gap", "text_len", "unique_ratio")


def clean_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR NOT isfinite({c}::DOUBLE) THEN 0 ELSE {c} END::DOUBLE"  # isnan is answered from the file's statistics, which leave NaN out


def cached_table(spark: SparkSession, folder: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    return latest_delivery(read_table(spark, folder, name).select("id", "is_member", "loaded_at", *columns)).select("id", "is_member", *[F.col(c).cast("double").alias(c) for c in columns])


@query("merge_cached_features", with_(CF, LF) + f"SELECT cf.id, {', '.join(f'round({clean_sql(c)}, 6) AS {c}' for c in CLIP)}, round(lf.loss, 6) AS loss, round(lf.min_k, 6) AS min_k FROM cf JOIN lf ON lf.id = cf.id AND lf.model = 'ft1'")
def merge_cached_features(spark: SparkSession, folder: str) -> DataFrame:
    """Inner join on id; unmatched rows drop out, unused columns never leave the scan."""
    right = loss_cache(spark, folder).where("model = 'ft1'").select("id", "loss", "min_k")
    left = cached_table(spark, folder, "clip_features", CLIP)
    return left.join(right, "id").select("id", *[F.round(P.cleaned(c), 6).alias(c) for c in CLIP], *r6("loss", "min_k"))


@query("combined_20", with_(TF, NF) + f"SELECT t.id, {', '.join(f'CASE WHEN round({clean_sql("t." + c)}, 6) = 0 THEN 0::DOUBLE ELSE round({clean_sql("t." + c)}, 6) END AS {c}' for c in THREE)}, {', '.join(f'CASE WHEN round({clean_sql("n." + c)}, 6) = 0 THEN 0::DOUBLE ELSE round({clean_sql("n." + c)}, 6) END AS {c}' for c in NB17)} FROM tf3 t JOIN nf n ON n.id = t.id")
def combined_20(spark: SparkSession, folder: str) -> DataFrame:
    """J7, P18."""
    return combined(spark, folder).select("id", *r6(*THREE, *NB17))


def combined(spark: SparkSession, folder: str) -> DataFrame:
    three = cached_table(spark, folder, "three_layer_features", THREE).drop("is_member")
    return models.prepared(three.join(cached_table(spark, folder, "neighborhood_features", NB17), "id"), [*THREE, *NB17])


@query("standardized_features", with_(CF, "cl AS (SELECT id, " + ", ".join(f"{clean_sql(c)} AS {c}" for c in CLIP) + " FROM cf)") + "SELECT id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM cl)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM cl), 6) AS {c}" for c in CLIP) + " FROM cl")
def standardized_features(spark: SparkSession, folder: str) -> DataFrame:
    """M1."""
    t = models.prepared(cached_table(spark, folder, "clip_features", CLIP), list(CLIP))
    return models.Scaler.fit(t, list(CLIP)).transform(t).select("id", *r6(*CLIP))


@query("class_counts", with_(S) + "SELECT is_member, count(*) AS n FROM s GROUP BY is_member")
def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """R9."""
    return samples(spark, folder).groupBy("is_member").agg(F.count("*").alias("n"))


@query("balanced_class_weights", with_(S) + "SELECT is_member, round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS weight FROM s WHERE is_member IS NOT NULL GROUP BY is_member")
def balanced_class_weights(spark: SparkSession, folder: str) -> DataFrame:
    """M2, M3."""
    return models.class_weights(samples(spark, folder), "is_member").select("is_member", *r6("weight"))


@query("score_summary", with_(LF) + "SELECT model, count(*) AS n, round(avg(-loss), 6) AS mean_score, round(stddev_pop(-loss), 6) AS std_score FROM lf GROUP BY model")
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    """K7."""
    return loss_cache(spark, folder).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(-F.col("loss")), 6).alias("mean_score"), F.round(F.stddev_pop(-F.col("loss")), 6).alias("std_score"))


# ---- evaluation


def roc_sql(source: str, group: str, score: str, label: str) -> str:
    return f"g AS (SELECT {group} AS grp, {score} AS score, count(*) FILTER ({label} = 1) AS pos, count(*) FILTER ({label} <> 1) AS neg FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL AND (isfinite({score}::DOUBLE) OR isinf({score}::DOUBLE)) GROUP BY ALL), rp AS (SELECT grp, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS n_pos, sum(neg) OVER (PARTITION BY grp) AS n_neg FROM g WINDOW w AS (PARTITION BY grp ORDER BY score DESC))"


METRICS = "mx AS (SELECT grp, CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN sum(pos * (n_neg - fp + neg / 2.0::DOUBLE)) / (max(n_pos) * max(n_neg)::DOUBLE) END AS auc, coalesce(max(CASE WHEN fp <= 0.1::DOUBLE * n_neg AND n_pos > 0 THEN tp::DOUBLE / n_pos END), 0) AS tpr_at_fpr FROM rp GROUP BY grp)"
_METHODS = "m AS (SELECT 'loss' AS method, -loss_ft2 AS score, s.is_member FROM x JOIN s USING (id) UNION ALL SELECT 'reference', loss_base2 - loss_ft2, s.is_member FROM x JOIN s USING (id) UNION ALL SELECT 'min_k', " + MINK.replace("{m}", "ft2") + ", s.is_member FROM x JOIN s USING (id))"


def method_scores(spark: SparkSession, folder: str) -> DataFrame:
    own, scored = scored_originals(spark, folder)
    stats = scored.groupBy("id").agg(F.avg(-F.col("logp_ft2")).alias("ft"), F.avg(-F.col("logp_base2")).alias("base"), F.sort_array(F.collect_list("logp_ft2")).alias("a"))
    three = F.array(F.struct(F.lit("loss").alias("method"), (-F.col("ft")).alias("score")), F.struct(F.lit("reference").alias("method"), (F.col("base") - F.col("ft")).alias("score")), F.struct(F.lit("min_k").alias("method"), tokenstats.min_k(F.col("a")).alias("score")))
    return stats.join(own.select("id", "is_member"), "id").select("is_member", F.explode(three).alias("x")).select("is_member", "x.*")


@query("audit_metrics", with_(S, LM, ORIG, SCORED, f"x AS (SELECT id, {STATS} FROM sc GROUP BY id)", _METHODS, roc_sql("m", "method", "round(score, 9)", "is_member"), METRICS) + "SELECT grp AS method, round(auc, 6) AS auc, round(tpr_at_fpr, 6) AS tpr_at_fpr FROM mx")
def audit_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The audit end to end: scan, score, aggregate, evaluate."""
    scored = method_scores(spark, folder).withColumn("score", F.round("score", 9))
    return evaluate.auc_and_tpr(evaluate.roc_points(scored, "method", "score", "is_member"), "method").select("method", *r6("auc", "tpr_at_fpr"))


@query("roc_curve", with_(LF, roc_sql("lf", "model", "-loss", "is_member")) + "SELECT grp AS model, round(score, 6) AS score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp::DOUBLE / n_pos, 6) AS tpr, round(fp::DOUBLE / n_neg, 6) AS fpr FROM rp")
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    """The full curve."""
    p = evaluate.roc_points(loss_cache(spark, folder).withColumn("score", -F.col("loss")), "model", "score", "is_member")
    return p.select("model", F.round("score", 6).alias("score"), "tp", "fp", F.round(F.try_divide(F.col("tp").cast("double"), F.col("n_pos")), 6).alias("tpr"), F.round(F.try_divide(F.col("fp").cast("double"), F.col("n_neg")), 6).alias("fpr"))


_UNP = "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {clean_sql(c)} AS value, is_member FROM nf" for c in NB17) + ")"


@query("per_feature_auc", with_(NF, _UNP, roc_sql("u", "feature", "value", "is_member"), METRICS) + "SELECT grp AS feature, round(auc, 6) AS auc, round(tpr_at_fpr, 6) AS tpr_at_fpr, round(greatest(auc, 1 - auc), 6) AS best_auc, CASE WHEN auc >= 0.5 THEN 'higher' ELSE 'lower' END AS direction FROM mx")
def per_feature_auc(spark: SparkSession, folder: str) -> DataFrame:
    """All features in one pass."""
    t = models.prepared(cached_table(spark, folder, "neighborhood_features", NB17), list(NB17))
    return evaluate.feature_aucs(t, "is_member", list(NB17)).select("feature", *r6("auc", "tpr_at_fpr", "best_auc"), "direction")


@query("accuracy_at_half", with_(CF) + f"SELECT round(avg(CASE WHEN (CASE WHEN {clean_sql('clip_img_text_sim')} >= 0.5 THEN 1 ELSE 0 END) = is_member THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM cf WHERE is_member IS NOT NULL")
def accuracy_at_half(spark: SparkSession, folder: str) -> DataFrame:
    """R4 on a similarity taken as probability."""
    t = models.prepared(cached_table(spark, folder, "clip_features", CLIP), list(CLIP))
    return evaluate.accuracy_at_half(t, "clip_img_text_sim", "is_member").select(*r6("accuracy"))


@query("late_loss_windows", "SELECT epoch(time_bucket(INTERVAL '7 days', scored_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'))::BIGINT AS week, model, count(*) AS n, round(avg(loss), 6) AS mean_loss FROM (SELECT DISTINCT row_no, batch_no, scored_at, model, loss FROM loss_features WHERE loss IS NOT NULL AND isfinite(loss)) GROUP BY ALL")
def late_loss_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming aggregation, here over the whole table."""
    d = windowed_losses(read_table(spark, folder, "loss_features").select("row_no", "batch_no", "scored_at", "model", "loss").where("scored_at is not null"))
    return d.select(F.unix_seconds("window.start").alias("week"), "model", "n", *r6("mean_loss"))


# ---- similarity and embeddings

_HYP = f"h AS (SELECT id, {w('lower(' + ANSWER.replace('{other}', chr(39) * 2) + ')')} AS ref, hyp FROM q JOIN (SELECT id, {w('lower(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE ' + chr(39) * 2 + ' END)')} AS hyp FROM d WHERE no = 0) USING (id) WHERE text IS NOT NULL)"


def reworded(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ref, hyp): the words of each answer, and of the answer with some dropped; all of them."""
    own = spread(pairs(spark, folder).where("text is not null"), "id")
    ws = lambda c: P.words(F.lower(P.answer_or_empty(c)))
    hyp = variants.answer_drops(own, n=1).select("id", ws("text").alias("hyp"))
    return own.select("id", ws("text").alias("ref")).join(hyp, "id")


@query("token_overlap", with_(Q, _ADROP, _HYP) + "SELECT id, round(CASE WHEN len(ref) > 0 AND len(hyp) > 0 THEN len(list_intersect(list_distinct(ref), list_distinct(hyp)))::DOUBLE / len(list_distinct(list_concat(ref, hyp))) ELSE 0 END, 6) AS token_overlap FROM h")
def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """G3."""
    return reworded(spark, folder).select("id", F.round(G.token_overlap(F.col("ref"), F.col("hyp")), 6).alias("token_overlap"))


def grams_sql(a: str, n: int) -> str:
    return a if n == 1 else f"list_transform(range(1, len({a}) - {n - 2}), lambda i: array_to_string(list_slice({a}, i, i + {n - 1}), ' '))"


def clipped_sql(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda y: y = g))))), 0)"


@query("rouge_n", with_(Q, _ADROP, _HYP, f"k AS (SELECT id, {grams_sql('ref', 1)} AS r1, {grams_sql('hyp', 1)} AS h1, {grams_sql('ref', 2)} AS r2, {grams_sql('hyp', 2)} AS h2 FROM h)") + f"SELECT id, round(CASE WHEN {clipped_sql('r1', 'h1')} > 0 THEN 2.0::DOUBLE * {clipped_sql('r1', 'h1')} / (len(r1) + len(h1)) ELSE 0 END, 6) AS rouge_1, round(CASE WHEN {clipped_sql('r2', 'h2')} > 0 THEN 2.0::DOUBLE * {clipped_sql('r2', 'h2')} / (len(r2) + len(h2)) ELSE 0 END, 6) AS rouge_2 FROM k")
def rouge_n(spark: SparkSession, folder: str) -> DataFrame:
    """G2."""
    return reworded(spark, folder).select("id", F.round(G.rouge_n(F.col("ref"), F.col("hyp"), 1), 6).alias("rouge_1"), F.round(G.rouge_n(F.col("ref"), F.col("hyp"), 2), 6).alias("rouge_2"))


def bleu_sql(n: int) -> str:
    logs = " + ".join(f"ln((CASE WHEN {clipped_sql(f'h{k}', f'r{k}')} > 0 THEN {clipped_sql(f'h{k}', f'r{k}')}::DOUBLE ELSE 0.1::DOUBLE END) / greatest(len(h{k}), 1)) / {n}" for k in range(1, n + 1))
    brevity = "CASE WHEN len(h1) > len(r1) THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - len(r1)::DOUBLE / greatest(len(h1), 1)) END"
    return f"round(CASE WHEN len(r1) > 0 AND len(h1) > 0 AND {clipped_sql('h1', 'r1')} > 0 THEN ({brevity}) * exp({logs}) ELSE 0 END, 6)"


def lcs_sql(name: str, source: str, keys: str) -> str:
    """Rows (keys, n_ref, n_hyp, lcs) of source (keys, ref, hyp): a row of the table of lengths a step, as the running greatest value."""
    step = "list_transform(range(0, len(ref) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE greatest(t[j + 1], t[j] + CASE WHEN ref[j] = hyp[i + 1] THEN 1 ELSE 0 END) END)"
    greatest = f"(SELECT list_transform(range(1, len(c) + 1), lambda j: list_max(list_slice(c, 1, j))) FROM (SELECT {step} AS c))"
    return (
        f"{name}_t AS (SELECT {keys}, ref, hyp, 0 AS i, list_transform(range(0, len(ref) + 1), lambda x: 0) AS t FROM {source} UNION ALL SELECT {keys}, ref, hyp, i + 1, {greatest} FROM {name}_t WHERE i < len(hyp)), "
        f"{name} AS (SELECT {keys}, len(ref) AS n_ref, len(hyp) AS n_hyp, list_max(t) AS lcs FROM {name}_t WHERE i = len(hyp))"
    )


F1_LCS = "CASE WHEN lcs > 0 THEN 2.0::DOUBLE * lcs / (n_ref + n_hyp) ELSE 0 END"
_GRAMS = f"k AS (SELECT id, {grams_sql('ref', 1)} AS r1, {grams_sql('hyp', 1)} AS h1, {grams_sql('ref', 2)} AS r2, {grams_sql('hyp', 2)} AS h2 FROM h)"


@query("rouge_l", "WITH RECURSIVE " + ", ".join([Q, _ADROP, _HYP, lcs_sql("l", "h", "id")]) + f" SELECT id, round({F1_LCS}, 6) AS rouge_l FROM l")
def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    """G1; checked against brute force in the tests."""
    return reworded(spark, folder).select("id", F.round(G.rouge_l("ref", "hyp"), 6).alias("rouge_l"))


@query("bleu_1_2", with_(Q, _ADROP, _HYP, _GRAMS) + f"SELECT id, {bleu_sql(1)} AS bleu_1, {bleu_sql(2)} AS bleu_2 FROM k")
def bleu_1_2(spark: SparkSession, folder: str) -> DataFrame:
    """G4; checked against hand-computed values in the tests."""
    return reworded(spark, folder).select("id", F.round(G.bleu(F.col("ref"), F.col("hyp"), 1), 6).alias("bleu_1"), F.round(G.bleu(F.col("ref"), F.col("hyp"), 2), 6).alias("bleu_2"))


_ANSWERS = f"g AS (SELECT id, no, {w('lower(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE ' + chr(39) * 2 + ' END)')} AS ws FROM d WHERE no < 3), gp AS (SELECT a.id, a.no AS i_, b.no AS j_, a.ws AS ref, b.ws AS hyp FROM g a JOIN g b ON a.id = b.id AND a.no < b.no)"


@query("generation_consistency", "WITH RECURSIVE " + ", ".join([Q, _ADROP, _ANSWERS, lcs_sql("l", "gp", "id, i_, j_")]) + f" SELECT id, round(avg({F1_LCS}), 6) AS mean_rouge_l, round(stddev_pop({F1_LCS}), 6) AS std_rouge_l FROM l GROUP BY id")
def generation_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and population spread of the ROUGE-L of the three pairs of an id's variants."""
    own = variants.answer_drops(spread(pairs(spark, folder).where("text is not null"), "id"), n=3)
    ws = P.words(F.lower(P.answer_or_empty("text")))
    a = own.select("id", F.col("variant_no").alias("i"), ws.alias("a"))
    both = a.join(own.select("id", F.col("variant_no").alias("j"), ws.alias("b")), "id").where("i < j")
    scored = both.select("id", G.rouge_l("a", "b").alias("r"))
    return scored.groupBy("id").agg(F.round(F.avg("r"), 6).alias("mean_rouge_l"), F.round(F.stddev_pop("r"), 6).alias("std_rouge_l"))


@query("embedding_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def embedding_norms(spark: SparkSession, folder: str) -> DataFrame:
    """E1, E5."""
    return read_table(spark, folder, "embeddings").select("vec_id", F.round(E.norm("embedding"), 6).alias("norm"))


@query("clip_style_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS img_text_sim, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS img_gen_sim, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim_gap, round(list_cosine_similarity(b.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS text_gen_sim, round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS img_question_sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2 JOIN embeddings q ON q.vec_id = a.vec_id + 3")
def clip_style_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """A vector as picture, the next as text, the one after as generated text, the third as question."""
    e = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    at = lambda k, n: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(n))
    j = e.join(at(1, "b"), "vec_id").join(at(2, "c"), "vec_id").join(at(3, "q"), "vec_id")
    return j.select("vec_id", F.round(E.cosine("embedding", "b"), 6).alias("img_text_sim"), F.round(E.cosine("embedding", "c"), 6).alias("img_gen_sim"), F.round(E.cosine("embedding", "c") - E.cosine("embedding", "b"), 6).alias("sim_gap"), F.round(E.cosine("b", "c"), 6).alias("text_gen_sim"), F.round(E.cosine("embedding", "q"), 6).alias("img_question_sim"))


# ---- pictures and models


def latest_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(id, b) of every id's latest delivery, chosen on short rows: the bytes aren't shuffled to drop repeats. Equal repeats of the latest delivery stay."""
    t = read_table(spark, folder, "image_text_samples").select("id", F.col("image.bytes").alias("b"), "loaded_at").where("id is not null")
    t = t.withColumn("__h", F.xxhash64("b")).withColumn("__at", F.coalesce(F.col("loaded_at").cast("double"), F.lit(-1e18)))
    last = t.groupBy("id").agg(F.max(F.struct("__at", "__h")).alias("x")).select("id", "x.*")
    return t.join(last, ["id", "__at", "__h"], "left_semi").select("id", "b")


@query("image_decode")
def image_decode(spark: SparkSession, folder: str) -> DataFrame:
    """(id, decoded, height, width, mean) of every picture."""

    def run(stream):
        for b in stream:
            found = [decode(x) for x in b["b"]]
            yield pd.DataFrame({"id": b["id"], "decoded": [p is not None for p in found], "height": [0 if p is None else p.shape[0] for p in found], "width": [0 if p is None else p.shape[1] for p in found], "mean": [None if p is None else round(float(p.mean()), 6) for p in found]})

    return latest_pictures(spark, folder).mapInPandas(run, "id string, decoded boolean, height int, width int, mean double").distinct()


_HEAD = "hd AS (SELECT DISTINCT id, CASE WHEN hex(b[1:4]) = '89504E47' THEN b WHEN hex(b[1:5]) = '69564F5277' THEN from_base64(decode(b[1:48])) ELSE b END AS b, octet_length(b) AS n FROM (SELECT id, image.bytes AS b, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM image_text_samples WHERE id IS NOT NULL) WHERE rn = 1 AND b IS NOT NULL)"


@query("image_headers", with_(_HEAD) + "SELECT id, n AS n_bytes, CASE WHEN hex(b[1:4]) = '89504E47' THEN 'png' WHEN hex(b[1:2]) = '424D' THEN 'bmp' ELSE 'other' END AS kind, CASE WHEN hex(b[1:4]) = '89504E47' AND octet_length(b) >= 24 THEN ('0x' || hex(b[17:20]))::BIGINT END AS png_width FROM hd")
def image_headers(spark: SparkSession, folder: str) -> DataFrame:
    """S8, the part that needs no decoding: kind, size and width as the header tells, in Spark expressions."""
    raw, hexed = F.col("b"), F.hex(F.substring("b", 1, 5))
    t = latest_pictures(spark, folder).where("b is not null").withColumn("n_bytes", F.octet_length("b"))
    head = F.when(hexed == "69564F5277", F.unbase64(F.substring(raw, 1, 48).cast("string"))).otherwise(raw)
    t = t.select("id", "n_bytes", F.substring(head, 1, 24).alias("b"))
    png = F.hex(F.substring("b", 1, 4)) == "89504E47"
    width = F.when(png & (F.octet_length("b") >= 24), F.conv(F.hex(F.substring("b", 17, 4)), 16, 10).cast("bigint"))
    return t.select("id", F.col("n_bytes").cast("bigint").alias("n_bytes"), F.when(png, "png").when(F.hex(F.substring("b", 1, 2)) == "424D", "bmp").otherwise("other").alias("kind"), width.alias("png_width")).distinct()


#: The grid of masked patches: small pictures have several patches of 8 pixels.
PATCH = 8


@query("image_neighbors")
def image_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """V5-V9: mean absolute change of five neighbours and of a corruption of every picture that decodes."""

    def run(stream):
        for b in stream:
            rows = []
            for i, x, seed in zip(b["id"], b["b"], b["h"]):
                p = decode(x)
                if p is None:
                    continue
                change = [float(np.abs(variants.neighbour(p, k, int(seed), PATCH).astype(int) - p).mean()) for k in range(DEFAULT.neighbours)]
                worn = variants.corrupted(p, np.random.default_rng(int(seed) & 0xFFFFFFFF))
                rows.append((i, *change, float(np.abs(worn.astype(int) - p).mean())))
            yield pd.DataFrame(rows, columns=["id", *[f"change_{k}" for k in range(DEFAULT.neighbours)], "corruption"])

    d = latest_pictures(spark, folder).where("b is not null").withColumn("h", F.xxhash64("id"))
    return d.mapInPandas(run, "id string, " + ", ".join(f"change_{k} double" for k in range(DEFAULT.neighbours)) + ", corruption double").distinct()


# ---- image and text together: any scorer of (picture, text), here a fixed one


def visual_losses(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, no, model, loss) of every pair's text with its picture, the picture's neighbours and its corruption.

    A picture is decoded and its variants are made once for all models. The built-in scorer is fixed: a word's loss is its length over the picture's
    contrast and brightness; a neural one takes its place through ``VisualScorer``.
    """
    texts = pairs(spark, folder).where("text is not null").select("id", P.answer_or_text("text").alias("text"))
    return scoring.VisualScorer(lambda: scoring.contrast_losses, ("ft", "base")).score(latest_pictures(spark, folder).where("b is not null").distinct().join(texts, "id"), "id", "b", "text", PATCH)


@query("image_neighbor_features")
def image_neighbor_features(spark: SparkSession, folder: str) -> DataFrame:
    """image neighbour gaps, with the text gaps of the cached table the cross-modal ones, and corruption sensitivity."""
    own = lambda kind, m, f: f(F.when((F.col("kind") == kind) & (F.col("model") == m), F.col("loss")))
    t = visual_losses(spark, folder).groupBy("id").agg(
        own("orig", "ft", F.max).alias("ft"), own("orig", "base", F.max).alias("base"), own("image", "ft", F.avg).alias("nft"), own("image", "base", F.avg).alias("nbase"),
        own("image", "ft", F.stddev_pop).alias("img_nb_std_ft"), own("corrupt", "ft", F.avg).alias("worn"),
    )
    t = t.select("id", (F.col("nft") - F.col("ft")).alias("img_nb_gap_ft"), (F.col("nbase") - F.col("base")).alias("img_nb_gap_base"), "img_nb_std_ft", features.contrast(F.col("worn"), F.col("ft")).alias("__c"))
    t = t.withColumn("img_nb_relative_gap", F.col("img_nb_gap_ft") - F.col("img_nb_gap_base")).withColumn("corruption_sensitivity", -F.col("__c"))
    text = cached_table(spark, folder, "neighborhood_features", ("text_nb_gap_ft",)).select("id", P.cleaned("text_nb_gap_ft").alias("text_nb_gap_ft"))
    joined = t.join(text, "id")
    return joined.select("id", *r6("img_nb_gap_ft", "img_nb_gap_base", "img_nb_std_ft", "img_nb_relative_gap", "corruption_sensitivity"), *[F.round(c, 6).alias(n) for c, n in zip(features.cross_modal("text_nb_gap_ft", "img_nb_gap_ft"), ("cross_modal_gap", "binding_score", "total_nb_gap"))])


CROSS = ("cross_modal_gap", "binding_score", "total_nb_gap")


@query("cross_modal_features", with_(NF) + f"SELECT id, {', '.join(f'CASE WHEN round({e}, 6) = 0 THEN 0::DOUBLE ELSE round({e}, 6) END AS {n}' for n, e in zip(CROSS, (f'{clean_sql("text_nb_gap_ft")} - {clean_sql("img_nb_gap_ft")}', f'{clean_sql("text_nb_gap_ft")} * {clean_sql("img_nb_gap_ft")}', f'{clean_sql("text_nb_gap_ft")} + {clean_sql("img_nb_gap_ft")}')))} FROM nf")
def cross_modal_features(spark: SparkSession, folder: str) -> DataFrame:
    """F11 from the cached gaps."""
    t = models.prepared(cached_table(spark, folder, "neighborhood_features", ("text_nb_gap_ft", "img_nb_gap_ft")), ["text_nb_gap_ft", "img_nb_gap_ft"])
    return t.select("id", *features.cross_modal("text_nb_gap_ft", "img_nb_gap_ft")).select("id", *r6(*CROSS))


FAMILIES = {"three_layer": list(THREE), "text_neighbours": [c for c in NB17 if c.startswith("text_nb")], "image_neighbours": [c for c in NB17 if c.startswith("img_nb")], "losses": ["loss_ft", "loss_base", "ref_diff", "ref_ratio"], "all": [*THREE, *NB17]}


def fit_and_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows in two parts by the hash of their id: three quarters to fit, the rest to test."""
    t = combined(spark, folder).where("is_member is not null").withColumn("__part", F.pmod(variants.hash32(F.col("id")), F.lit(4)))
    return t.where("__part > 0").drop("__part"), t.where("__part = 0").drop("__part")


@query("lr_scores")
def lr_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The membership probability of every id."""
    names = [*THREE, *NB17]
    train, _ = fit_and_test(spark, folder)
    scaler = models.Scaler.fit(train, names)
    model = models.fit_logistic(scaler.transform(train), names, "is_member", balanced=True)
    return models.probabilities(model, scaler.transform(combined(spark, folder)), names).select("id", F.round("score", 6).alias("score"))


@query("gbt_scores")
def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    """M5-M11."""
    names = [*THREE, *NB17]
    train, _ = fit_and_test(spark, folder)
    return models.probabilities(models.fit_boosted(train, names, "is_member"), combined(spark, folder), names).select("id", F.round("score", 6).alias("score"))


@query("signal_ablation")
def signal_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """R8."""
    train, test = fit_and_test(spark, folder)
    return models.ablation(train, test, FAMILIES, "is_member").select("family", "n_features", *r6("auc", "tpr_at_fpr"))


@query("cross_validation")
def cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Five folds on the three-layer features."""
    return models.cross_validated(combined(spark, folder), list(THREE), "is_member").select("fold", *r6("auc", "tpr_at_fpr"))


@query("image_model_input")
def image_model_input(spark: SparkSession, folder: str) -> DataFrame:
    """Every picture, or the blank one, resampled for a model; here its size, mean and spread."""

    def run(stream):
        for b in stream:
            shown = [model_input(x) for x in b["b"]]  # resampled pictures of a batch would be 4 GB
            yield pd.DataFrame({"id": b["id"], "side": [side for side, _, _ in shown], "mean": [round(mean, 6) for _, mean, _ in shown], "spread": [round(spread, 6) for _, _, spread in shown]})

    return latest_pictures(spark, folder).mapInPandas(run, "id string, side int, mean double, spread double").distinct()


@query("feature_importances")
def feature_importances(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most important features; the limit is the report's."""
    names = [*THREE, *NB17]
    train, _ = fit_and_test(spark, folder)
    top = models.importances(models.fit_boosted(train, names, "is_member"), names)[:10]
    return spark.createDataFrame([(f, round(v, 6), i) for i, (f, v) in enumerate(top, 1)], "feature string, importance double, place int")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
