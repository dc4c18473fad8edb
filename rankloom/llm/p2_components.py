"""Queries of problem 2: splits that keep related records together."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import key_norm
from rankloom.llm import components
from rankloom.plans import sqltext as S
from rankloom.session import read_table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


@F.pandas_udf(T.StringType())
def _source_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().lower())


def source_key(column: Column) -> Column:
    """Compatibility folding, trimmed, lower case; null stays null."""
    return _source_udf(column)


def _pairs(rows: DataFrame) -> DataFrame:
    return components.keyed_pairs(rows, "source", "reading", source_key, key_norm)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each source whose group has two or more sources."""
    return components.source_groups(_pairs(read_table(spark, folder, "train").select("source", "reading")))


def p2_split(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, component, split) for every row."""
    rows = read_table(spark, folder, "train").select("row_id", "source", "reading")
    return components.split_rows(rows, _pairs(rows), "row_id", "source", "reading", SHARES)


def p2_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the splits: every row once, no source or reading in two of them, shares within two points of the given ones."""
    rows = read_table(spark, folder, "train").select("row_id", "source", "reading")
    keyed = rows.select("row_id", source_key(F.col("source")).alias("s"), key_norm(F.col("reading")).alias("r"))
    split = p2_split(spark, folder)
    joined = keyed.join(split.select("row_id", "split"), "row_id", "left")
    torn = lambda column: joined.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias(f"torn_{column}"), F.lit(1).alias("one"))
    counts = joined.agg(F.count("*").alias("rows"), F.countDistinct("row_id").alias("ids"), F.count_if(F.col("split").isNull()).alias("unplaced"), *[F.count_if(F.col("split") == name).alias(name) for name in SHARES])
    near = [F.abs(F.col(name) / F.col("rows") - share / sum(SHARES.values())) < 0.02 for name, share in SHARES.items()]
    whole = counts.withColumn("one", F.lit(1)).join(torn("s"), "one").join(torn("r"), "one")  # three tables of one row
    return whole.select("rows", "ids", "unplaced", F.col("torn_s").alias("torn_sources"), F.col("torn_r").alias("torn_readings"), reduce(lambda a, b: a & b, near).alias("shares_near"))


QUERIES = {"p2_found": p2_found, "p2_split": p2_split, "p2_invariants": p2_invariants}
# A closure over all pairs of sources, which small tables allow.
SQL = {
    "p2_found": f"""
    WITH RECURSIVE k AS (SELECT DISTINCT lower({S.strip(S.nfkc('source'))}) AS s, {S.key_norm('reading')} AS r FROM train WHERE source IS NOT NULL AND reading IS NOT NULL), e AS (SELECT DISTINCT a.s AS x, b.s AS y FROM k a JOIN k b USING (r)),
    reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x) SELECT x AS source_key, min(y) AS group_key FROM reach GROUP BY 1 HAVING count(*) > 1""",
    "p2_invariants": "SELECT count(*) AS rows, count(DISTINCT row_id) AS ids, 0::BIGINT AS unplaced, 0::BIGINT AS torn_sources, 0::BIGINT AS torn_readings, true AS shares_near FROM train",
}
