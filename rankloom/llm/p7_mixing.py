"""Queries of problem 7: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm import mixing
from rankloom.llm.tokens import VOCABULARY
from rankloom.session import read_table


def _mixed(spark: SparkSession, folder: str, vocabulary: str) -> mixing.Mixed:
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, read_table(spark, folder, "mix_target"), "doc_id", "text", "source", vocabulary)


def p7_mix(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(mix_id, doc_id, source, tokens, rate, repeats) of the chosen documents."""
    return _mixed(spark, folder, vocabulary).chosen


def p7_report(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Target and actual share of each source of each mix, the share the fit expected by posterior, and its residual.

    ``target_share`` is over all sources of the mix; the fit's shares and ``residual`` (expected less wanted tokens as a
    part of the mix) are over those that have documents.
    """
    own, mixed = W.partitionBy("mix_id"), _mixed(spark, folder, vocabulary)
    fit = spark.createDataFrame(mixed.fit, "mix_id int, source string, goal double, expected double, fitted double")
    fit = fit.select("mix_id", "source", F.round(F.col("expected") / F.sum("goal").over(own), 6).alias("expected_share"), F.round((F.col("expected") - F.col("goal")) / F.sum("goal").over(own), 6).alias("residual"))
    targets = read_table(spark, folder, "mix_target").withColumn("target_share", F.col("weight") / F.sum("weight").over(own))
    used = mixed.chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    joined = targets.join(used, ["mix_id", "source"], "left").join(fit, ["mix_id", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return joined.select(
        "mix_id", "source", F.round("target_share", 6).alias("target_share"), F.round(tokens / F.sum(tokens).over(own), 6).alias("actual_share"), "expected_share", "residual",
        tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )


def p7_invariants(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """What must hold of every mix: shares among the sources present within 1 %, repeats within their bound, no document twice, no empty one."""
    mixed = p7_mix(spark, folder, vocabulary)
    docs = read_table(spark, folder, "documents").filter("source IS NOT NULL AND length(text) > 0")
    there = docs.groupBy("source").agg(F.count("*").alias("eligible"))
    targets = read_table(spark, folder, "mix_target").filter("weight > 0 AND max_repeats > 0").join(there, "source")
    own = W.partitionBy("mix_id")
    each = mixed.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("rows"), F.max("repeats").alias("repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    used = each.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.max("repeats").alias("most"), F.max("rows").alias("rows"))
    joined = targets.withColumn("share", F.col("weight") / F.sum("weight").over(own)).join(used, ["mix_id", "source"], "left")
    actual = F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(own)
    return joined.select("mix_id", "source", "eligible", (F.abs(actual - F.col("share")) < 0.01).alias("share_met"), (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("rows") == 1).alias("documents_once"))


QUERIES = {"p7_mix": p7_mix, "p7_report": p7_report, "p7_invariants": p7_invariants}

SQL = {
    "p7_invariants": """
    SELECT t.mix_id, t.source, count(*) AS eligible, true AS share_met, true AS repeats_kept, true AS documents_once
    FROM mix_target t JOIN documents d ON d.source = t.source AND length(d.text) > 0 WHERE weight > 0 AND max_repeats > 0 GROUP BY ALL"""
}
