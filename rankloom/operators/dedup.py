"""First and last wins, caps and ranks for each key, with an explicit order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.prefix import buckets_for, running_total


def wins(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the order column.

    ``min_by`` of the whole row combines before the shuffle, so a hot key sends one row from each task; a window would
    sort all of them in one place.  Nulls in keys are a key of their own.
    """
    row = F.struct(*df.columns)
    pick = F.max_by(row, order) if last else F.min_by(row, order)
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(pick.alias("_row")).select("_row.*")


def cap_per_key(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """At most ``most`` rows of each key; the engine keeps that many in each task before the shuffle."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= most).drop("_place")


def sha_order(column: str, seed: int) -> Column:
    """A stable order that DuckDB reproduces: SHA-256 of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")), 256)


def hash_rank(df: DataFrame, groups: list[str], key: str, seed: int, out: str = "hash_rank") -> DataFrame:
    """The place (from 0) of every row in hash order within its group, by running totals over hash buckets.

    The rows are counted first, so that a bucket holds a bounded number of them at every size.
    """
    digits = max(1, math.ceil(math.log(buckets_for(df.count()), 16)))
    hashed = df.withColumn("_sha", sha_order(key, seed)).withColumn("_one", F.lit(1)).withColumn("_b", F.conv(F.substring("_sha", 1, min(digits, 12)), 16, 10).cast("bigint"))
    return running_total(hashed, groups, "_b", [F.col("_sha"), F.col(key)], "_one", out).drop("_sha", "_one", "_b")
