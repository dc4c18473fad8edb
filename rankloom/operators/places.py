"""Places and neighbours within a key, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.prefix import running_total
from rankloom.operators.skew import salted_lookup


def places(df: DataFrame, key: str, order: str, block: int = 4096) -> DataFrame:
    """Rows with ``place`` (from 0) within their key by a whole-number order; running totals over blocks of the order."""
    each = df.withColumn("_one", F.lit(1)).withColumn("_block", F.floor(F.col(order) / block).cast("bigint"))
    return running_total(each, [key], "_block", [F.col(order)], "_one", "place").drop("_one", "_block")


def with_place(df: DataFrame, key: str, order: str, block: int = 4096) -> DataFrame:
    """Rows with ``place`` (from 0) within their key by a whole-number order, and ``n`` rows of the key.

    Places are running totals over blocks of the order, so a hot key is spread over tasks.
    """
    return salted_lookup(places(df, key, order, block), df.groupBy(key).agg(F.count("*").alias("n")), [key], [F.col(order)])


def with_previous(df: DataFrame, key: str, order: str, columns: dict[str, tuple[str, int]], block: int = 4096) -> DataFrame:
    """Rows with values of earlier rows of their key: ``columns`` names (column, how many rows before).

    A key is cut into blocks of places; the last rows of a block are repeated at the head of the next one, so each window
    covers one block and sees what it needs.
    """
    most = max(back for _, back in columns.values())
    placed = places(df, key, order, block).withColumn("_b", F.floor(F.col("place") / block))
    near = F.col("place") % block >= block - most
    copies = F.when(near, F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy")), F.struct((F.col("_b") + 1).alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy"))))
    each = placed.withColumn("_x", F.explode(copies)).drop("_b")
    own = W.partitionBy(key, "_x.b").orderBy("place")
    values: list[Column] = [F.lag(column, back).over(own).alias(name) for name, (column, back) in columns.items()]
    return each.select("*", *values).filter("NOT _x.copy").select(*df.columns, *columns)
