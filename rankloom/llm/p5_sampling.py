"""Queries of problem 5: samples that match target category proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm import sampling
from rankloom.session import materialize, read_table

CELLS = ["context_sensitive", "gold_in_nbest"]


def _quotas(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.cell_quotas(
        read_table(spark, folder, "train").select("row_id", *CELLS), read_table(spark, folder, "sample_target").withColumn("set_id", F.col("set_id").cast("bigint")), "set_id", CELLS, "target_share", "sample_fraction", "min_rows"
    )


def _flag(column: str) -> object:
    return F.col(column).cast("string").alias(column)


def _sample(spark: SparkSession, folder: str, quotas: DataFrame) -> DataFrame:
    total = quotas.agg(F.max("total_rows")).first()[0] or 0
    ranked = materialize(sampling.rank_rows(read_table(spark, folder, "train").select("row_id", *CELLS), "row_id", CELLS, total))
    sample = materialize(sampling.systematic_sample(ranked, quotas, "row_id", "set_id", CELLS))
    return sampling.repair_floors(sample, ranked, quotas, "row_id", "set_id", CELLS)


def _report(spark: SparkSession, folder: str) -> DataFrame:
    quotas = materialize(_quotas(spark, folder))
    drawn = _sample(spark, folder, quotas).groupBy("set_id", *CELLS).agg(F.count("*").alias("drawn"))
    return quotas.join(drawn, ["set_id", *CELLS], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of each set where the drawn sample falls short because the table has too few rows."""
    return _report(spark, folder).filter("drawn < wanted").select("set_id", *[_flag(c) for c in CELLS])


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """(set_id, row_id, flags): the sample of every set over the whole table."""
    return _sample(spark, folder, materialize(_quotas(spark, folder))).select("set_id", "row_id", *[_flag(c) for c in CELLS])


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each cell with its target, what was drawn, its actual share and whether the target could not be met."""
    whole = W.partitionBy("set_id")
    return _report(spark, folder).select(
        "set_id", *[_flag(c) for c in CELLS], "cell_rows", "target_share", F.round("wanted", 6).alias("wanted"), "quota", "short", "drawn",
        F.round(F.col("drawn") / F.sum("drawn").over(whole), 6).alias("actual_share"),
    )


QUERIES = {"p5_found": p5_found, "p5_sample": p5_sample, "p5_report": p5_report}

_CELLS_SQL = """
    WITH counts AS (SELECT coalesce(context_sensitive, false) AS context_sensitive, coalesce(gold_in_nbest, false) AS gold_in_nbest, count(*) AS n FROM train GROUP BY 1, 2),
    quotas AS (SELECT t.set_id, t.context_sensitive, t.gold_in_nbest, t.target_share, coalesce(n, 0) AS cell_rows,
        greatest(min_rows::DOUBLE, target_share * sample_fraction * (SELECT count(*) FROM train)) AS wanted
        FROM sample_target t LEFT JOIN counts c ON c.context_sensitive = coalesce(t.context_sensitive, false) AND c.gold_in_nbest = coalesce(t.gold_in_nbest, false))"""

SQL = {
    "p5_report": f"""{_CELLS_SQL}, drawn AS (SELECT *, least(ceil(wanted), cell_rows)::BIGINT AS quota FROM quotas)
    SELECT set_id::BIGINT AS set_id, context_sensitive::VARCHAR AS context_sensitive, gold_in_nbest::VARCHAR AS gold_in_nbest, cell_rows, target_share, round(wanted, 6) AS wanted, quota, cell_rows < wanted AS short, quota AS drawn,
    round(quota / sum(quota) OVER (PARTITION BY set_id), 6) AS actual_share FROM drawn""",
    "p5_found": f"{_CELLS_SQL} SELECT set_id::BIGINT AS set_id, context_sensitive::VARCHAR AS context_sensitive, gold_in_nbest::VARCHAR AS gold_in_nbest FROM quotas WHERE cell_rows < wanted",
}
