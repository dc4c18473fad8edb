"""Queries of problem 3: same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import lookalike as look
from rankloom.llm import overlap
from rankloom.operators.skew import salted_lookup
from rankloom.plans import sqltext as S
from rankloom.session import materialize, read_table


_COLUMNS = ("row_id", "gold", "reading", "context_prev")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(holdout_id, train_id) of every overlap between the evaluation splits and the training split."""
    pairs = overlap.near_pairs(read_table(spark, folder, "holdout"), read_table(spark, folder, "train"), *_COLUMNS)
    return pairs.select(F.col("left_id").alias("holdout_id"), F.col("right_id").alias("train_id"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps counted by split and training source, and the mean part of the overlapping records' chunks that train has.

    Counted from classes and their sizes; no pair of rows is formed.
    """
    holdout, train = read_table(spark, folder, "holdout"), read_table(spark, folder, "train")
    found = overlap.near_classes(holdout, train, *_COLUMNS)
    pairs = materialize(found.pairs)
    splits = found.left.join(holdout.select(F.col("row_id").alias("id"), "split_name"), "id").groupBy("class", "split_name").agg(F.count("*").alias("holdout"))
    sources = found.right.join(train.select(F.col("row_id").alias("id"), F.col("source").alias("train_source")), "id").groupBy("class", "train_source").agg(F.count("*").alias("train"))
    met = pairs.join(sources.withColumnRenamed("class", "b"), "b").groupBy("a", "train_source").agg(F.sum("train").alias("train"), F.sum(F.when(F.col("edits") == 0, F.col("train")).otherwise(0)).alias("same"))
    each = met.join(splits.withColumnRenamed("class", "a"), "a").join(overlap.record_fractions(found).withColumnRenamed("class", "a"), "a")
    return each.groupBy("split_name", "train_source").agg(
        F.sum(F.col("holdout") * F.col("train")).alias("pairs"), F.sum(F.col("holdout") * F.col("same")).alias("same_pairs"), F.sum("holdout").alias("holdout_rows"),
        F.round(F.sum(F.col("fraction") * F.col("holdout")) / F.sum("holdout"), 6).alias("mean_fraction"),
    )


def p3_fractions(spark: SparkSession, folder: str) -> DataFrame:
    """(holdout_id, fraction): how much of each holdout row whose gold train has, by length of its chunks, is in train."""
    found = overlap.near_classes(read_table(spark, folder, "holdout"), read_table(spark, folder, "train"), *_COLUMNS)
    return salted_lookup(found.left, overlap.record_fractions(found), ["class"], [F.col("id")]).select(F.col("id").alias("holdout_id"), F.round("fraction", 6).alias("fraction"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_fractions": p3_fractions}

# Every pair of rows with golds of one form is compared here, which small tables allow; no chunk is cut.  The engine's
# distance counts bytes, so the letters of a pair (fewer than 128 different ones) are given a byte each first.
def _rows_sql(table: str) -> str:
    context = f"regexp_replace({S.nfkc("coalesce(context_prev, '')")}, {S.quote(look.INVISIBLE)}, '', 'g')"
    return f"SELECT row_id, gold, {context} AS c, {S.key_norm('reading')} AS r FROM {table} WHERE reading IS NOT NULL AND gold IS NOT NULL"


SQL = {
    "p3_found": f"""
    WITH strings AS (SELECT gold AS v FROM holdout UNION SELECT gold FROM train), {look.canonical_ctes()},
    h AS ({_rows_sql('holdout')}), t AS ({_rows_sql('train')}), hf AS (SELECT h.*, form FROM h JOIN canonical ON v = gold), tf AS (SELECT t.*, form FROM t JOIN canonical ON v = gold),
    pairs AS (SELECT hf.row_id AS holdout_id, tf.row_id AS train_id, hf.r || hf.c AS a, tf.r || tf.c AS b FROM hf JOIN tf USING (form) WHERE (hf.c = '') = (tf.c = '')),
    letters AS (SELECT *, array_to_string(list_distinct(string_split(a || b, '')), '') AS used FROM pairs), codes AS (SELECT string_agg(chr(i::INTEGER), '' ORDER BY i) AS bytes FROM range(1, 128) t(i)),
    short AS (SELECT *, translate(a, used, left(bytes, length(used))) AS x, translate(b, used, left(bytes, length(used))) AS y FROM letters, codes)
    SELECT holdout_id, train_id FROM short WHERE levenshtein(x, y) * 8 <= greatest(length(a), length(b))""",
}
