"""Joins that stay even when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialize

#: Rows of one key on one side that a task of a many-to-many join should meet at most.
HOT = 20_000


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[Column], how: str = "inner", salts: int = 8, null_safe: bool = False, hint: str | None = None) -> DataFrame:
    """Join many rows with a table that has at most one row for each key.

    Each row goes to one of ``salts`` tasks of its key by a hash of ``spread``; the lookup is repeated that often.  No
    row is copied on the large side.  Columns of the lookup beside the keys are appended.  ``hint`` names the join
    strategy, such as "merge" where the lookup grows with the data and must not be broadcast.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", salt).alias("l")
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("r")
    right = right.hint(hint) if hint else right
    if not null_safe:
        return left.join(right, [*keys, "_salt"], how).drop("_salt")
    condition = F.col("l._salt") == F.col("r._salt")
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    extra = [F.col(f"r.{c}") for c in lookup.columns if c not in keys] if how in ("inner", "left") else []
    return left.join(right, condition, how).select(*[F.col(f"l.{c}") for c in rows.columns], *extra)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, hot: int = HOT) -> DataFrame:
    """An inner join of many rows with many rows, whole even where one key is hot on the right.

    Keys with more than ``hot`` rows on the right are counted first.  Their right rows are spread over as many tasks as
    keep ``hot`` rows each, by a hash of ``spread``, and only the left rows of these keys are repeated; the other keys
    join as usual.  Null keys meet nothing.
    """
    counts = right.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot)
    salts = materialize(counts.select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_salts")))
    if salts.isEmpty():
        return left.join(right, keys)
    cold = left.join(salts, keys, "left_anti").join(right.join(salts, keys, "left_anti"), keys)
    few = left.join(salts, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    many = right.join(salts, keys).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")).drop("_salts")
    return cold.unionByName(few.join(many, [*keys, "_salt"]).drop("_salt"))
