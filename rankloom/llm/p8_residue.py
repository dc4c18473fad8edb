"""Queries of problem 8: template residue and error-page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import residue
from rankloom.session import read_table


def _found(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "url", "source")
    return residue.residue(docs, "doc_id", "text", "url", "source")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id) of the documents without real content."""
    return _found(spark, folder).select("doc_id").distinct()


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that stay, whole."""
    return read_table(spark, folder, "documents").join(p8_found(spark, folder), "doc_id", "left_anti")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """What was excluded, by source and kind of evidence."""
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    return _found(spark, folder).join(docs, "doc_id").groupBy("source", "kind").agg(F.countDistinct("doc_id").alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_clean": p8_clean, "p8_report": p8_report}
SQL: dict[str, str] = {}
