"""Running totals over a whole table without a single-task window.

The order is (bucket, keys...).  Totals of each (group, bucket) are aggregated first and their running offsets are
computed from that small table; the windows then only cover one bucket each.  Buckets must be chosen so that one of
them fits a task: a hash of the row's key, or a length class and such a hash.  Without groups the offsets go two levels,
so that the one window over everything has a row for ``SPAN`` buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows that a bucket should hold; buckets under one row of the upper level.
ROWS_PER_BUCKET, SPAN = 50_000, 1024


def buckets_for(rows: int) -> int:
    """How many hash buckets keep a bucket at ``ROWS_PER_BUCKET`` rows."""
    return max(1, -(-rows // ROWS_PER_BUCKET))


def hash_bucket(buckets: int, seed: int, *keys: Column) -> Column:
    """A bucket number that is uniform and the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).cast("int")


def running_total(df: DataFrame, groups: list[str], bucket: str, order: list[Column], weight: str, out: str) -> DataFrame:
    """Add ``out``: the total weight of the rows before this one in its group, in (bucket, order).

    The table of bucket totals has (number of groups) x (number of buckets) rows; a window of it covers one group, or
    ``SPAN`` buckets where there are no groups.  Null weights count as zero.  An empty table stays empty.
    """
    weighed, nothing = F.coalesce(F.col(weight), F.lit(0)), F.lit(0)
    totals = df.groupBy(*groups, bucket).agg(F.sum(weighed).alias("_sum"))
    if groups:
        before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
        offsets = totals.select(*groups, bucket, F.coalesce(F.sum("_sum").over(before), nothing).alias("_before"))
    else:
        totals = totals.withColumn("_span", F.floor(F.col(bucket) / SPAN))
        spans = totals.groupBy("_span").agg(F.sum("_sum").alias("_spans"))
        spans = spans.select("_span", F.coalesce(F.sum("_spans").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), nothing).alias("_above"))
        own = F.coalesce(F.sum("_sum").over(W.partitionBy("_span").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), nothing)
        offsets = totals.withColumn("_own", own).join(spans, "_span").select(bucket, (F.col("_above") + F.col("_own")).alias("_before"))
    inside = W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = df.withColumn("_inside", F.coalesce(F.sum(weighed).over(inside), F.lit(0)))
    condition = [ranked[c].eqNullSafe(offsets[c]) for c in [*groups, bucket]]
    joined = ranked.join(offsets, condition, "inner")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_before") + F.col("_inside")).alias(out))
