"""Statistics that need an order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.prefix import running_total


def average_ranks(df: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """(key, rank): ranks from 1 where ties share their mean rank.

    Equal values are counted first; running totals then cover blocks of ``width`` of the value.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col(value) / width).cast("bigint"))
    ranked = running_total(counts, [], "_block", [F.col(value)], "_n", "_before").select(value, (F.col("_before") + (F.col("_n") + 1) / 2).alias("rank"))
    return df.join(ranked, value).select(key, "rank")


def spearman(df: DataFrame, key: str, x: str, y: str, width: float = 1.0) -> DataFrame:
    """One row with the rank correlation of two columns."""
    a = average_ranks(df.select(key, x), key, x, width).withColumnRenamed("rank", "a")
    b = average_ranks(df.select(key, y), key, y, width).withColumnRenamed("rank", "b")
    return a.join(b, key).agg(F.corr("a", "b").alias("spearman"))


def value_at(df: DataFrame, value: str, place: Column, width: float) -> DataFrame:
    """The value at a place (from 0) of the sorted column, by counts of equal values and running totals over blocks.

    ``place`` may use ``n``, the number of values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col(value) / width).cast("bigint"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    ranked = running_total(counts, [], "_block", [F.col(value)], "_n", "_before").withColumn("n", F.lit(total))
    at = place.cast("bigint")
    return ranked.filter((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))).select(value)


def upper_median_by(df: DataFrame, groups: list[str], value: str, width: float) -> DataFrame:
    """(groups..., n, value): the upper median of each group, by counts of equal values and running totals; nulls do not count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col(value) / width).cast("bigint"))
    totals = counts.groupBy(*groups).agg(F.sum("_n").alias("n"))
    ranked = running_total(counts, groups, "_block", [F.col(value)], "_n", "_before").join(totals, groups)
    at = F.floor(F.col("n") / 2)
    return ranked.filter((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))).select(*groups, "n", value)


def pair_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: mean absolute, root mean square, mean and largest difference, means and population deviations."""
    d = F.col(x) - F.col(y)
    r = lambda c, name: F.round(c, 6).alias(name)
    return df.agg(
        F.count("*").alias("n"), r(F.avg(F.abs(d)), "mae"), r(F.sqrt(F.avg(d * d)), "rmse"), r(F.avg(d), "mean_diff"), r(F.max(F.abs(d)), "max_abs"),
        r(F.avg(x), "mean_x"), r(F.avg(y), "mean_y"), r(F.stddev_pop(x), "std_x"), r(F.stddev_pop(y), "std_y"), r(F.corr(x, y), "pearson"),
    )
