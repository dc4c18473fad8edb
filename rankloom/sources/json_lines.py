"""JSON Lines and plain JSON: strict and lenient scans, adapters, sorted sinks, an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import strip

PROVENANCE = "struct<source_id: string, source_url: string, license_id: string, retrieved_at: string, source_version: string>"
TERM = f"surface string, reading string, category string, provenance {PROVENANCE}, reading_source string, reading_confidence string, aliases array<string>, metadata map<string, string>"
TERM_FIELDS = f"surface: string, reading: string, category: string, provenance: {PROVENANCE}, reading_source: string, reading_confidence: string, aliases: array<string>, metadata: map<string, string>"
LOG = "ts string, reading string, nbest array<string>, chosen string, context_prev string, rerank_top1 string, final_top1 string, overwritten boolean, tau double, scores array<double>, session_id string, source string"


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of the non-blank lines, without a byte-order mark."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("value"), F.input_file_name().alias("file"))
    return lines.filter(F.trim("value") != "")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every non-blank line must hold an object; anything else fails the job with its file and text.

    A line with an array is an error here, where the JSON reader would make rows of it.
    """
    parsed = _objects(spark, path).withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    message = F.concat(F.lit("not a JSON object: "), "file", F.lit(": "), F.left("value", F.lit(80)))
    return parsed.select(F.when(good, F.col("row")).otherwise(F.raise_error(message).cast(T.StructType.fromDDL(schema))).alias("row")).select("row.*")


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are no objects are dropped."""
    good = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    return _objects(spark, path).filter(good).select(F.from_json("value", schema).alias("row")).select("row.*")


def first_rows(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows in an order; zero means all of them."""
    return rows.orderBy(order).limit(most) if most else rows


def read_pairs(spark: SparkSession, classified: str, raw: str) -> DataFrame:
    """(reading, surface, candidates, source, category): classified rows with their candidates, raw terms with unknown ones.

    A row holds the record itself or under ``record``; blank readings and surfaces are dropped, empty candidates too.
    """
    parts = []
    for path, known in ((classified, True), (raw, False)):
        rows = records(read_strict(spark, path, f"{TERM}, record struct<{TERM_FIELDS}>, candidates array<string>"))
        candidates = F.filter(F.coalesce("candidates", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")) if known else F.lit(None).cast("array<string>")
        parts.append(rows.select(strip(F.col("reading")).alias("reading"), strip(F.col("surface")).alias("surface"), candidates.alias("candidates"), F.col("provenance.source_id").alias("source"), F.coalesce("category", F.lit("")).alias("category")))
    return parts[0].unionByName(parts[1]).filter("reading <> '' AND surface <> ''")


def read_requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object, one array of objects, or JSON Lines; which of them is seen from the first character."""
    first = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''").limit(1).collect()
    if first and (first[0]["v"].startswith("[") or not first[0]["v"].rstrip().endswith("}")):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return read_lenient(spark, path, schema)


def records(df: DataFrame) -> DataFrame:
    """Rows that are a record or hold one under ``record``."""
    if "record" not in df.columns:
        return df
    fields = df.schema["record"].dataType.names
    plain = [c for c in df.columns if c not in fields and c != "record"]
    return df.select(*plain, *[F.coalesce(F.col(f"record.{f}"), F.col(f)).alias(f) if f in df.columns else F.col(f"record.{f}") for f in fields])


def write_sorted(df: DataFrame, path: str) -> int:
    """JSON Lines with sorted fields; the number of rows comes from the write itself."""
    from pyspark.sql import Observation

    seen = Observation()
    df.select(sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def append(df: DataFrame, path: str) -> None:
    df.select(sorted(df.columns)).write.mode("append").json(path)


def append_log(df: DataFrame, path: str) -> DataFrame:
    """Append the valid rows of a conversion log; gives back the others with their error codes."""
    from rankloom.operators.tables import log_errors

    checked = df.withColumn("errors", log_errors())
    append(checked.filter("size(errors) = 0").drop("errors"), path)
    return checked.filter("size(errors) > 0")


def benchmark_rows(df: DataFrame) -> DataFrame:
    """(key, gold, candidates): fixture rows, or instruction rows whose prompt lists the candidates."""
    listed = F.regexp_extract(F.coalesce("input", F.lit("")), "既存候補（これら以外を提案）: ([^\\n]*)", 1)
    key = F.regexp_extract(F.coalesce("input", F.lit("")), "現在の入力: ([^\\n]*)", 1)
    return df.select(
        F.coalesce("key", F.nullif(key, F.lit(""))).alias("key"), F.coalesce("gold", F.get(F.split("output", "\n"), F.lit(0))).alias("gold"),
        F.when(listed != "", F.split(listed, ", ")).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )
