"""Samples whose cells have target shares: systematic unequal-probability sampling, then repaired floors, and a report.

Rows are ordered by cell and, within a cell, at random (by a hash of the row key).  Each row of a cell has the
inclusion probability (target rows of the cell) / (rows of the cell); the prefix sums of these probabilities run
across all cells and partitions, and a row is taken where its interval crosses a whole number, counted from one random
start.  Each cell so gets its target rounded up or down.  Then floors are repaired: cells below the larger of the
minimum and the rounded-up target get the passed-over rows that come first in the random order.

Defined results: a null flag counts as false; rows with a null key are not drawn; repeated rows count each; a cell with
fewer rows than wanted is taken whole and reported; an empty table gives an empty sample and reports every cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.prefix import buckets_for, hash_bucket, running_total


def cell_quotas(df: DataFrame, targets: DataFrame, set_column: str, cells: list[str], share: str, fraction: str, floor: str) -> DataFrame:
    """(set, cells..., cell_rows, wanted, quota, rate_rows, short): the targets against what the table has.

    wanted = max(floor, share x fraction x rows); quota = least(ceil(wanted), rows of the cell); rate_rows is the
    expected number before floors.  One aggregate over the cells; the result has a row for each target.
    """
    flags = df.select(*[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in cells])
    counts = flags.groupBy(*cells).agg(F.count("*").alias("cell_rows"))
    total = counts.agg(F.coalesce(F.sum("cell_rows"), F.lit(0))).first()[0]
    wanted = targets.select(set_column, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in cells], share, fraction, floor)
    joined = wanted.join(counts, cells, "left").withColumn("total_rows", F.lit(total))
    need = F.greatest(F.col(floor).cast("double"), F.col(share) * F.col(fraction) * F.col("total_rows"))
    have = F.coalesce(F.col("cell_rows"), F.lit(0))
    return joined.select(
        set_column, *cells, have.alias("cell_rows"), "total_rows", share, need.alias("wanted"),
        F.least(F.ceil(need), have).cast("bigint").alias("quota"), F.least(F.col(share) * F.col(fraction) * F.col("total_rows"), have).alias("rate_rows"), (have < need).alias("short"),
    )


def rank_rows(df: DataFrame, key: str, cells: list[str], rows: int, seed: int = 17) -> DataFrame:
    """(key, cells..., sample_hash, rank): the random order of every cell, ranks from 1; ``rows`` is about their number.

    The only shuffle of rows is the one that ranks a hash bucket; the bucket totals are counts of (cell, bucket).
    """
    each = df.select(key, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in cells]).filter(F.col(key).isNotNull())
    each = each.withColumn("sample_hash", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_bucket", hash_bucket(buckets_for(rows), seed, F.col(key))).withColumn("_one", F.lit(1))
    ranked = running_total(each, cells, "_bucket", [F.col("sample_hash"), F.col(key)], "_one", "_before")
    return ranked.select(key, *cells, "sample_hash", (F.col("_before") + 1).alias("rank"))


def systematic_sample(ranked: DataFrame, quotas: DataFrame, key: str, set_column: str, cells: list[str], seed: int = 17) -> DataFrame:
    """(set, key, cells..., sample_hash): the sample of each set from ``rank_rows`` and the small result of ``cell_quotas``."""
    # Where the intervals of a cell begin: running totals of the quotas in cell order, from one random start.
    chain = W.partitionBy(set_column).orderBy(*cells).rowsBetween(W.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64(F.lit(seed), F.col(set_column)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    plan = quotas.filter("rate_rows > 0").withColumn("_base", F.coalesce(F.sum("rate_rows").over(chain), F.lit(0.0)) + start)
    joined = ranked.join(F.broadcast(plan), cells)  # the plan has one row for each target, a documented small table
    step = F.col("rate_rows") / F.col("cell_rows")
    high, low = F.floor(F.col("_base") + step * F.col("rank")), F.floor(F.col("_base") + step * (F.col("rank") - 1))
    return joined.filter(high > low).select(set_column, key, *cells, "sample_hash")


def repair_floors(sample: DataFrame, ranked: DataFrame, quotas: DataFrame, key: str, set_column: str, cells: list[str]) -> DataFrame:
    """Fill the cells below their quota with the passed-over rows that come first in the random order.

    The gaps are a row for each target and come to the driver.  A cell sampled at the rate s has at least g passed-over
    rows among its first (g + 2) / (1 - s), so no other rows are looked at.
    """
    spark = sample.sparkSession
    got = sample.groupBy(set_column, *cells).agg(F.count("*").alias("_got"))
    gap = F.col("quota") - F.coalesce("_got", F.lit(0))
    rate = F.col("rate_rows") / F.col("cell_rows")
    last = F.when(rate < 1, F.least("cell_rows", F.ceil((gap + 2) / (1 - rate)))).otherwise(F.col("cell_rows")).cast("bigint")
    gaps = quotas.join(got, [set_column, *cells], "left").filter(gap > 0).select(set_column, *cells, gap.alias("_gap"), last.alias("_last"))
    found = gaps.collect()
    if not found:
        return sample
    small = F.broadcast(spark.createDataFrame(found, gaps.schema))  # at most one row for each target
    passed = ranked.join(small, cells).filter(F.col("rank") <= F.col("_last")).join(sample.select(set_column, key), [set_column, key], "left_anti")
    first = W.partitionBy(set_column, *cells).orderBy("rank")
    fill = passed.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= max(x["_gap"] for x in found)).filter(F.col("_r") <= F.col("_gap"))
    return sample.unionByName(fill.select(set_column, key, *cells, "sample_hash"))
