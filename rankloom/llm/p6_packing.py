"""Queries of problem 6: filling fixed-capacity containers with documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import packing
from rankloom.llm.tokens import VOCABULARY
from rankloom.session import materialize, read_table

CAPACITIES = [512, 2048, 8192]


def p6_pack(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(capacity, doc_id, piece, token_start, tokens, container_id, position) for each document or piece."""
    return packing.pack_texts(read_table(spark, folder, "documents"), "doc_id", "text", CAPACITIES, vocabulary)[0]


def p6_report(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers, items and unused share of each capacity."""
    packed = p6_pack(spark, folder, vocabulary).filter("container_id IS NOT NULL")
    fill = packed.groupBy("capacity", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return fill.groupBy("capacity").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.round(1 - F.sum("tokens") / (F.count("*") * F.first("capacity")), 6).alias("unused_share"),
    )


def p6_invariants(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """What must hold of every capacity: each document there, none cut that fits, no container too full, positions whole, under 5 % unused but for the last containers."""
    packed = materialize(p6_pack(spark, folder, vocabulary))
    docs = packed.groupBy("capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("size"), F.count("container_id").alias("placed"))
    each = docs.groupBy("capacity").agg(F.count("*").alias("documents"), F.count_if(F.col("placed") > 0).alias("placed"), F.count_if((F.col("size") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("cut_needlessly"))
    boxes = packed.filter("container_id IS NOT NULL").groupBy("capacity", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"), F.max("position").alias("last"), F.countDistinct("position").alias("places"))
    fill = boxes.groupBy("capacity").agg(
        F.count_if(F.col("tokens") > F.col("capacity")).alias("too_full"), F.count_if((F.col("last") != F.col("items")) | (F.col("places") != F.col("items"))).alias("odd_positions"),
        (F.count("*") * F.first("capacity") - F.sum("tokens") <= F.count("*") * F.first("capacity") * 0.05 + 20 * F.first("capacity")).alias("little_unused"),
    )
    return each.join(fill, "capacity").select("capacity", "documents", "placed", "cut_needlessly", "too_full", "odd_positions", "little_unused")


QUERIES = {"p6_pack": p6_pack, "p6_report": p6_report, "p6_invariants": p6_invariants}
SQL = {
    "p6_invariants": """
    SELECT unnest([512, 2048, 8192])::INTEGER AS capacity, count(*) AS documents, count(*) FILTER (WHERE length(text) > 0) AS placed, 0::BIGINT AS cut_needlessly, 0::BIGINT AS too_full, 0::BIGINT AS odd_positions, true AS little_unused FROM documents""",
}
