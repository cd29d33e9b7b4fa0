"""The queries of the operators in this package, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import leaks, neardup, packing, pii, quality, similar, terms, together
from engram.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = terms.term_frequencies(table(spark, sf, "memory"), "key", ["tags", "entities"])
    return found.where("mark is not null").select("field", "term", "mark")


def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(table(spark, sf, "memory"), "key", ["tags", "entities"])


def _personal(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    parts = table(spark, sf, "name_parts")
    ids = {"messages": "id", "memory": "key"}
    return {f"{t}.content": pii.personal(table(spark, sf, t), i, "content", parts) for t, i in ids.items()}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (pii.mentions(found).select(F.lit(field).alias("field"), "rec_id", "kind", "mention") for field, found in _personal(spark, sf).items())
    return a.unionByName(b)


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (pii.redact(found).select(F.lit(field).alias("field"), "rec_id", F.col("redacted").alias("content")).distinct() for field, found in _personal(spark, sf).items())
    return a.unionByName(b)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = together.appear_together(table(spark, sf, "memory"), "key", "entities", least=20)
    return pairs.where("lift >= 4").select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = together.appear_together(table(spark, sf, "memory"), "key", "entities")
    return pairs.select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "records", F.round("lift", 6).alias("lift"))


#: How far the triangle inequality is relaxed; 1 is exact. At 4 about half of all vectors are compared, and of the pairs
#: of cosine 0.9 and more 0.03 % are missed (measured on 12,000 vectors).
RELAXED = 4.0


def _mini(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vectors").where("model = 'mini-embed-64'")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar.similar_pairs(_mini(spark, sf), "key", "embedding", 64, k=5, min_cosine=0.9, factor=RELAXED)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.near_pairs(table(spark, sf, "memory"), "content_hash", "content", "entities")
    return pairs.select(F.col("id_a").alias("hash_a"), F.col("id_b").alias("hash_b"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = neardup.near_groups(table(spark, sf, "memory"), "content_hash", "content", "entities")
    return groups.select(F.col("id").alias("content_hash"), F.col("group_id").alias("group_hash"), "links")


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf, "documents"), "doc_id", "text", capacity=2048).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = leaks.leaked_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return spans.select("doc_id", "item_id", F.col("start").alias("first_unit"), F.col("end").alias("end_unit"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    kinds = quality.text_quality(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))
    return kinds.where("kind <> 'prose'").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_quality(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
