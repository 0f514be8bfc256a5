"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.config import cut_lineage
from auditloom.llm import abuse, chunking, neardup, overlap, packing, pairs, pii, quality, ranking, tokenize
from auditloom.sources.tables import latest_delivery, read_table

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.find_defects(latest_delivery(read_table(spark, folder, "image_text_samples").select("id", "text", "loaded_at")).drop("loaded_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    texts, shown = read_table(spark, folder, "text_samples"), read_table(spark, folder, "image_text_samples")
    return (
        overlap.found_rows(overlap.text_overlaps(texts, "id", "text", "split", "loaded_at", 30), "text_samples", "text")
        .unionByName(overlap.found_rows(overlap.text_overlaps(shown, "id", "text", "split", "loaded_at", 25, answers=True), "image_text_samples", "text"))
        .unionByName(overlap.found_rows(overlap.picture_overlaps(shown, "id", "image", "split", "loaded_at"), "image_text_samples", "image"))
        .distinct()
    )


def overlap_links(spark: SparkSession, folder: str) -> list[tuple[str, str, DataFrame, DataFrame]]:
    """(table, field, links, members) of the three searches of problem 2."""
    texts, shown = read_table(spark, folder, "text_samples"), read_table(spark, folder, "image_text_samples")
    found = [
        ("text_samples", "text", overlap.text_links(texts, "id", "text", "split", "loaded_at", 30)),
        ("image_text_samples", "text", overlap.text_links(shown, "id", "text", "split", "loaded_at", 25, answers=True)),
        ("image_text_samples", "image", overlap.picture_links(shown, "id", "image", "split", "loaded_at")),
    ]
    return [(table, field, cut_lineage(links), members) for table, field, (links, members) in found]


def _labelled(found: list[tuple[str, str, DataFrame, DataFrame]], f: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    parts = [f(links, members).select(F.lit(table).alias("tbl"), F.lit(field).alias("field"), "*") for table, field, links, members in found]
    return reduce(DataFrame.unionByName, parts)


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping evaluation records and pairs (of all copies) by table, field, evaluation split and source."""
    columns = ["id", "split", "source", "loaded_at"]
    every = [latest_delivery(read_table(spark, folder, t).select(*columns)).withColumn("tbl", F.lit(t)) for t in ("text_samples", "image_text_samples")]
    evaluated = every[0].unionByName(every[1]).where(F.col("split").isin("validation", "test")).select("tbl", "id", "split", "source")
    found = _labelled(overlap_links(spark, folder), overlap.partners)
    return found.join(evaluated, ["tbl", "id"]).groupBy("tbl", "field", "split", "source").agg(F.countDistinct("id").alias("records"), F.sum("pairs").alias("pairs"))


def p2_members(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every overlapping record, and the covered share of evaluation texts."""
    return _labelled(overlap_links(spark, folder), overlap.membership)


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """The linked classes: with p2_members, all pairs."""
    return _labelled(overlap_links(spark, folder), overlap.class_links)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.oversized(documents(spark, folder))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.split_documents(documents(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal(documents(spark, folder)).select("doc_id", "pii_type", "start_pos")


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact(documents(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_pairs(documents(spark, folder)).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(documents(spark, folder))


def audit_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One row an id with the four scores of problem 6."""
    near = latest_delivery(read_table(spark, folder, "neighborhood_features").select("id", "ref_ratio", "loss_ft", "text_nb_gap_ft", "loaded_at"))
    clip = latest_delivery(read_table(spark, folder, "clip_features").select("id", "clip_img_text_sim", "loaded_at"))
    return near.drop("loaded_at").join(clip.drop("loaded_at"), "id")


def p6_flows(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.net_flows(audit_scores(spark, folder), "id", ranking.MEMBERSHIP)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_share(p6_flows(spark, folder), "id")


def p7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.document_quality(documents(spark, folder), read_table(spark, folder, "common_words"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_quality(spark, folder).where(~F.col("kind").isin("prose", "empty")).select("doc_id", "kind")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_documents(documents(spark, folder))


def p9_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(tokenize.token_counts(documents(spark, folder)))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score_documents(documents(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where("abusive").select("doc_id")


def p10_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.source_rates(p10_scores(spark, folder))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
