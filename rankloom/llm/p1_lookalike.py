"""Queries of problem 1: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import lookalike as look
from rankloom.plans import sqltext as S
from rankloom.session import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, row_key): terms with a look-alike among the terms, holdout rows with a look-alike of their target."""
    terms = look.lookalike_members(read_table(spark, folder, "term_record"), "term_id", "surface")
    rows = look.lookalike_candidates(read_table(spark, folder, "holdout"), "row_id", "gold", "mozc_nbest")
    return terms.select(F.lit("term_record").alias("tbl"), "row_key").unionByName(rows.select(F.lit("holdout").alias("tbl"), "row_key"))


def p1_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The one form of every surface, target and candidate."""
    terms = look.canonical_rows(read_table(spark, folder, "term_record"), "term_id", ["surface"], [])
    rows = look.canonical_rows(read_table(spark, folder, "holdout"), "row_id", ["gold"], ["mozc_nbest"])
    return terms.select(F.lit("term_record").alias("tbl"), "*").unionByName(rows.select(F.lit("holdout").alias("tbl"), "*"))


QUERIES = {"p1_found": p1_found, "p1_canonical": p1_canonical}


def skeleton_sql(x: str) -> str:
    """Another way to the same families: letters of one shape become one letter everywhere, whatever they stand between."""
    bare = f"regexp_replace({S.nfkc(f"regexp_replace({x}, {S.quote(look.INVISIBLE)}, '', 'g')")}, {S.quote(look.INVISIBLE)}, '', 'g')"
    marks = f"nfc_normalize(translate({bare}, '゛゜', {S.quote(chr(0x3099) + chr(0x309A))}))"
    one = look.DASHES + look.ONE
    same = [
        (look.CYRILLIC_FROM + look.GREEK_FROM + look.RADICAL_FROM, look.CYRILLIC_TO + look.GREEK_TO + look.RADICAL_TO), (look.KANA_SHAPED + look.KATAKANA_SAME, look.IDEOGRAPH_SHAPED + look.HIRAGANA_SAME),
        (one, look.LONG_MARK * len(one)), (look.DOTS + look.CIRCLES, look.DOT * len(look.DOTS) + look.CIRCLE * len(look.CIRCLES)),
    ]
    out = marks
    for source, target in same:
        out = f"translate({out}, {S.quote(source)}, {S.quote(target)})"
    return f"nfc_normalize({out})"


SQL = {
    "p1_found": f"""
    WITH s AS (SELECT v, {skeleton_sql('v')} AS form FROM (SELECT DISTINCT surface AS v FROM term_record WHERE surface IS NOT NULL)), f AS (SELECT form FROM s GROUP BY 1 HAVING count(*) > 1),
    pairs AS (SELECT row_id, gold, unnest(mozc_nbest) AS cand FROM holdout WHERE gold IS NOT NULL)
    SELECT 'term_record' AS tbl, term_id AS row_key FROM term_record JOIN s ON v = surface WHERE form IN (SELECT form FROM f)
    UNION ALL
    SELECT DISTINCT 'holdout', row_id FROM pairs WHERE cand <> gold AND {skeleton_sql('cand')} = {skeleton_sql('gold')}""",
    "p1_canonical": f"""
    WITH cells AS (
        SELECT 'term_record' AS tbl, term_id AS row_key, 'surface' AS field_name, 0 AS position, surface AS value FROM term_record
        UNION ALL SELECT 'holdout', row_id, 'gold', 0, gold FROM holdout
        UNION ALL SELECT 'holdout', row_id, 'mozc_nbest', generate_subscripts(mozc_nbest, 1)::INTEGER, unnest(mozc_nbest) FROM holdout),
    strings AS (SELECT DISTINCT value AS v FROM cells), {look.canonical_ctes()}
    SELECT tbl, row_key, field_name, position, value, form FROM cells JOIN canonical ON v = value""",
}
