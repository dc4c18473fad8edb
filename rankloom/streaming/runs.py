"""Streams over a table's files: scored requests, windows, sessions, dedup and budgeted batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.dedup import wins
from rankloom.session import ensure_checkpoint_dir, ship_package


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream, with the schema of the table."""
    ship_package(spark)
    path = os.path.join(folder, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_once(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process what is there and give the written rows back as a table of the shared folder.

    The checkpoint lies beside it, so a lost run goes on where it stopped.  In complete mode the last micro-batch holds
    everything; in update mode the last row of each of ``keys`` counts, whatever micro-batch it came from.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer.foreachBatch(keep).start().awaitTermination()
    if not spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")):
        return spark.createDataFrame([], stream.schema)
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    if keys:
        return wins(written, keys, "batch", last=True).drop("batch")
    last = written.agg(F.max("batch")).first()[0]
    return written.filter(F.col("batch") == last).drop("batch")


def windows(events: DataFrame, time: str, keys: list[str], length: str, late: str, *measures: tuple[str, Column]) -> DataFrame:
    """Counts and named measures of each window; windows close when the watermark passes them."""
    names = [m for m, _ in measures]
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), *[c.alias(m) for m, c in measures]).select("w", *keys, "n", *names).withColumn("window_start", F.col("w.start")).drop("w")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, session_start, n) of sessions that a gap ends."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), "n")


def answer_requests(lines: DataFrame, schema: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ok, response) for each line: bad JSON gives an error row, a ping its echo, the rest what ``answer`` makes of it.

    ``answer`` adds a column ``response`` to the parsed requests.
    """
    request = F.from_json("value", schema)
    good = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    parsed = lines.select("value", good.alias("ok"), request.alias("request"))
    answered = answer(parsed.select("value", "ok", "request.*"))
    ping = F.get_json_object("value", "$.ping").isNotNull()
    return answered.select("ok", F.when(~F.col("ok"), F.lit('{"ok":false}')).when(ping, F.lit('{"ok":true,"pong":true}')).otherwise(F.col("response")).alias("response"))


def budgeted(pending: DataFrame, done: DataFrame, key: str, cost: str, order: str, spent: float, most: float) -> DataFrame:
    """The pending rows, not yet done, that the rest of the budget pays for in their order."""
    from rankloom.operators.prefix import running_total

    rows = pending.join(done.select(key), key, "left_anti").withColumn("_block", F.floor(F.col(order) / 4096).cast("bigint"))
    total = running_total(rows, [], "_block", [F.col(order)], cost, "_before")
    return total.filter(F.col("_before") + F.coalesce(F.col(cost), F.lit(0)) + F.lit(spent) <= most).drop("_block", "_before")


def last_spend(log: DataFrame, order: str, spend: str) -> float:
    """The running spend of the last row of a resume log, zero for an empty one; the last row counts, not the largest."""
    row = log.agg(F.max_by(spend, order).alias("s")).first()
    return float(row["s"] or 0.0)
