"""Ragged tab-separated candidate lists, key files, dictionaries and generated listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import key_norm, strong_surface, weak_surface
from rankloom.operators.dedup import wins


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, order): the lines of the files in file, block and line order."""
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", order.alias("order"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(key, candidates): a key and any number of candidates on each line; the last line of a key wins, blank lines are skipped."""
    lines = _numbered(spark, path).filter(F.trim("value") != "").withColumn("parts", F.split("value", "\t"))
    rows = lines.select(key_norm(F.get("parts", F.lit(0))).alias("key"), F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))).alias("candidates"), "order").filter("key <> ''")
    return wins(rows, ["key"], "order", last=True).select("key", "candidates")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, surface): a key and a surface on each line; lines that start with # are comments, the first line of a pair wins."""
    lines = _numbered(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("parts", F.split("value", "\t"))
    rows = lines.select(key_norm(F.get("parts", F.lit(0))).alias("key"), weak_surface(F.get("parts", F.lit(1))).alias("surface"), "order").filter("key <> '' AND surface <> ''")
    return wins(rows, ["key", "surface"], "order").select("key", "surface")


def dictionary_of(rows: DataFrame, order: str) -> DataFrame:
    """(key, surface) of dictionary rows (reading, surface): the first of each pair of key and surface norm stays."""
    keyed = rows.select(key_norm(F.col("reading")).alias("key"), "surface", strong_surface(F.col("surface")).alias("_ns"), F.col(order).alias("_o")).filter("key <> '' AND _ns <> ''")
    return wins(keyed, ["key", "_ns"], "_o").select("key", "surface")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(key) of an allow-list: JSON with ``readings`` or ``eligible``, else a listing of quoted strings."""
    whole = spark.read.option("wholetext", True).text(path)
    lists = whole.select(F.from_json("value", "readings array<string>, eligible array<string>").alias("j"), "value")
    named = F.coalesce("j.readings", "j.eligible")
    quoted = F.regexp_extract_all("value", F.lit(r'(?m)^\s+"([^"]+)",\s*$'), F.lit(1))
    return lists.select(F.explode(F.coalesce(named, quoted)).alias("key")).filter("key <> ''").distinct()


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as (metric, value) lines of JSON."""
    flat = report.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in report.columns])).alias("x"))
    flat.select("x.*").write.mode("overwrite").json(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, surface, position) from one JSON object of key to list of surfaces."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("key", "surfaces")).select("key", F.posexplode("surfaces").alias("position", "surface"))


def write_keys(df: DataFrame, path: str, column: str, order: str) -> None:
    """One key a line, normalised and unique, in the order they are first seen."""
    keys = df.select(key_norm(F.col(column)).alias("key"), order).filter("key <> ''").groupBy("key").agg(F.min(order).alias("o"))
    keys.orderBy("o").select(F.col("key").alias("value")).write.mode("overwrite").text(path)


def write_listing(df: DataFrame, path: str, column: str) -> int:
    """Sorted quoted strings with commas, for inclusion in a program; returns their number."""
    names = df.select(column).filter(F.col(column).isNotNull()).distinct()
    names.orderBy(column).select(F.concat(F.lit('  "'), column, F.lit('",')).alias("value")).write.mode("overwrite").text(path)
    return names.count()


def write_audit(df: DataFrame, folder: str, key: str, context: str, n: int = 300, seed: int = 1) -> None:
    """A seeded sample for people: JSON Lines, and tab-separated with tabs and line ends of the context as spaces."""
    from rankloom.operators.dedup import sha_order

    sample = df.orderBy(sha_order(key, seed), key).limit(n)
    sample.write.mode("overwrite").json(f"{folder}/audit.json")
    flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    sample.select(*flat).withColumn(context, F.regexp_replace(context, "[\\t\\r\\n]+", " ")).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/audit.tsv")


def write_bundle(entries: DataFrame, folder: str) -> dict[str, int]:
    """A dictionary bundle: entries as JSON Lines, a map of key to surfaces, and a report of counts and sizes in bytes.

    Every part is a partitioned write; only the report's few numbers are on the driver.
    """
    from rankloom.sources.json_lines import write_sorted

    spark = entries.sparkSession
    n = write_sorted(entries, f"{folder}/entries.json")
    grouped = entries.groupBy("reading").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))
    grouped.select(F.to_json(F.create_map("reading", "surfaces")).alias("value")).write.mode("overwrite").text(f"{folder}/map.jsonl")
    report = {"entries": n, "readings": spark.read.text(f"{folder}/map.jsonl").count()}
    for part in ("entries.json", "map.jsonl"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        report[f"{part.partition('.')[0]}_bytes"] = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    write_report(spark.createDataFrame([tuple(report.values())], list(report)), f"{folder}/report.json")
    return report
