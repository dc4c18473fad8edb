"""Splits and samples that are the same on every run: hash order in place of a seeded shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.dedup import hash_rank
from rankloom.operators.skew import salted_lookup


def group_holdout(df: DataFrame, row: str, key: str, share: float, seed: int) -> DataFrame:
    """(row, key, held): whole keys are held out, max(1, round(keys x share)) of them; a null key is never held."""
    keys = df.filter(F.col(key).isNotNull()).select(key).distinct()
    n = max(1, _half_even(keys.count() * share))
    held = hash_rank(keys, [], key, seed).filter(F.col("hash_rank") < n).select(key, F.lit(True).alias("_held"))
    return salted_lookup(df.select(row, key), held, [key], [F.col(row)], "left").select(row, key, F.coalesce("_held", F.lit(False)).alias("held"))


def _half_even(x: float) -> int:
    return round(x)


def quota_sample(df: DataFrame, row: str, stratum: str, quotas: dict[str, int], total: int, seed: int) -> DataFrame:
    """(row, stratum, filled): up to each stratum's quota by hash order, then filled to ``total`` from what is left."""
    ranked = hash_rank(df.select(row, stratum), [stratum], row, seed)
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(stratum) == name, F.lit(n)).otherwise(quota)
    first = ranked.filter(F.col("hash_rank") < quota).select(row, stratum, F.lit(False).alias("filled"))
    missing = total - first.count()
    if missing <= 0:
        return first
    left = hash_rank(ranked.filter(F.col("hash_rank") >= quota).select(row, stratum), [], row, seed + 1)
    return first.unionByName(left.filter(F.col("hash_rank") < missing).select(row, stratum, F.lit(True).alias("filled")))
