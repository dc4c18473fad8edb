"""Queries of problem 4: personal information inside free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import pii
from rankloom.session import read_table

FIELDS = ["context_prev", "chosen"]


def _tagger(spark: SparkSession, folder: str) -> bytes:
    return pii.tagger_bytes(pii.name_parts(read_table(spark, folder, "name_part")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(log_id, field_name, kind) of the personal information in the log's texts."""
    log = read_table(spark, folder, "rerank_smoke")
    return pii.found_kinds(log, "log_id", FIELDS, _tagger(spark, folder))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """(log_id, context_prev, chosen) with placeholders in place of personal information."""
    log = read_table(spark, folder, "rerank_smoke")
    return pii.redacted(log, "log_id", FIELDS, _tagger(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
SQL: dict[str, str] = {}
