"""Queries that write tables in outside formats and read them back."""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.places import with_place
from rankloom.plans import sqltext as S
from rankloom.plans.q_joins import ALLOW_SQL, MAP_SQL, allow_list, candidate_map
from rankloom.plans.q_reports import baseline
from rankloom.plans.q_text import T_fraction, fraction_sql
from rankloom.session import ensure_checkpoint_dir
from rankloom.session import read_table as read
from rankloom.sources import archives, json_lines, pages, tab_separated

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _place(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one small file into the shared folder, whatever file system that is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(content))
    out.close()


def _zipped(name: str, content: bytes) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr(name, content)
    return buffer.getvalue()


def _nations(spark: SparkSession, folder: str) -> list:
    return read(spark, folder, "nation").orderBy("n_nationkey").collect()  # 25 rows at every scale


@query("SELECT log_id, reading, len(nbest)::INTEGER AS n FROM rerank_smoke WHERE log_id % 3 <> 0")
def lenient_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The log through lines of which a third is broken; broken lines, arrays and blanks are dropped."""
    path = _place(spark)
    log = read(spark, folder, "rerank_smoke").select("log_id", F.to_json(F.struct("log_id", "reading", "nbest")).alias("value"))
    bad = F.when(F.col("log_id") % 9 == 0, "").when(F.col("log_id") % 9 == 3, F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.expr("left(value, length(value) - 2)"))
    log.select(F.when(F.col("log_id") % 3 == 0, bad).otherwise(F.col("value")).alias("value")).write.text(path)
    back = json_lines.read_lenient(spark, path, "log_id bigint, reading string, nbest array<string>")
    return back.select("log_id", "reading", F.size("nbest").alias("n"))


@query("SELECT log_id FROM rerank_smoke ORDER BY log_id LIMIT 50")
def limited_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty rows in order: an operator whose feature is the limit."""
    return json_lines.first_rows(read(spark, folder, "rerank_smoke").select("log_id"), "log_id", 50)


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def json_array_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON array, found to be one by its first character."""
    path = _place(spark)
    put(spark, f"{path}/requests.json", json.dumps([{"key": r["n_nationkey"], "name": r["n_name"]} for r in _nations(spark, folder)], indent=1).encode())
    return json_lines.read_requests(spark, path, "key bigint, name string")


@query("SELECT count(*) AS appended, count(DISTINCT session_id) AS sessions FROM rerank_smoke WHERE coalesce(ts, '') <> '' AND coalesce(reading, '') <> '' AND nbest IS NOT NULL AND coalesce(chosen, '') <> ''")
def append_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows of the log appended to a log in two parts."""
    path, log = _place(spark), read(spark, folder, "rerank_smoke")
    for part in (0, 1):
        json_lines.append_log(log.filter(F.col("log_id") % 2 == part), path)
    return json_lines.read_strict(spark, path, json_lines.LOG).agg(F.count("*").alias("appended"), F.countDistinct("session_id").alias("sessions"))


@query(f"SELECT key FROM (SELECT {S.key_norm('reading')} AS key FROM train) WHERE key <> '' GROUP BY 1")
def key_file(spark: SparkSession, folder: str) -> DataFrame:
    """The unique keys through a file of one key a line."""
    path = _place(spark)
    tab_separated.write_keys(read(spark, folder, "train"), path, "reading", "row_id")
    return spark.read.text(path).select(F.col("value").alias("key"))


@query("SELECT c_nationkey::VARCHAR AS key, arg_max(c_name, c_custkey) || '|' || arg_max(c_mktsegment, c_custkey) AS candidates FROM customer GROUP BY 1")
def ragged_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate lines whose keys repeat; the last line of a key wins."""
    path = _place(spark)
    read(spark, folder, "customer").orderBy("c_custkey").select(F.concat_ws("\t", F.col("c_nationkey").cast("string"), "c_name", "c_mktsegment").alias("value")).write.text(path)
    return tab_separated.read_candidates(spark, path).select("key", F.array_join("candidates", "|").alias("candidates"))


_DIGITS, _KANA = "0123456789", "アイウエオカキクケコ"
_POSTAL_SQL = f"""WITH n AS (SELECT n_nationkey AS i, translate(n_nationkey::VARCHAR, '{_DIGITS}', 'あいうえおかきくけこ') AS k, n_name AS p, 'R' || n_regionkey AS c, CASE n_nationkey % 5 WHEN 1 THEN '番地がくる場合' WHEN 2 THEN n_name || '（１〜３）' ELSE 'Ｔ' || n_name END AS town FROM nation),
    e AS (SELECT i, unnest([0, 1, 2, 3, 4]) AS slot, unnest([p, c, p || c, CASE WHEN i % 5 NOT IN (1, 2) THEN 'T' || p END, CASE WHEN i % 5 NOT IN (1, 2) THEN c || 'T' || p END]) AS surface, unnest(['けん' || k, 'しち', 'けん' || k || 'しち', 'まち' || k, 'しちまち' || k]) AS reading, unnest(['prefecture', 'city', 'prefecture_city', 'town', 'city_town']) AS kind FROM n)
    SELECT surface, reading, arg_max(kind, (i, slot)) AS kind FROM e WHERE surface IS NOT NULL GROUP BY 1, 2"""


@query(_POSTAL_SQL)
def postal_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A zipped postal table in a legacy encoding to up to five records a row."""
    path, out = _place(spark), io.StringIO()
    rows = csv.writer(out)
    for r in _nations(spark, folder):
        i, kana = r["n_nationkey"], str(r["n_nationkey"]).translate(str.maketrans(_DIGITS, _KANA))
        town = {1: "番地がくる場合", 2: r["n_name"] + "（１〜３）"}.get(i % 5, "Ｔ" + r["n_name"])
        rows.writerow([i, "060", "0600000", "ケン" + kana, "シチ", "マチ" + kana, r["n_name"], f"R{r['n_regionkey']}", town])
    rows.writerow(["short", "row"])
    put(spark, f"{path}/table.zip", _zipped("table.csv", out.getvalue().replace("〜", "～").encode("cp932")))
    return archives.postal_records(archives.read_zip_csv(spark, path))


@query("SELECT n_name || '青空' AS text FROM nation")
def legacy_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in a legacy encoding, every second one zipped."""
    path = _place(spark)
    for r in _nations(spark, folder):
        content = (r["n_name"] + "青空").encode("shift_jis")
        put(spark, f"{path}/w{r['n_nationkey']}", _zipped("w.txt", content) if r["n_nationkey"] % 2 else content)
    return archives.read_legacy_texts(spark, path).select("text")


@query("SELECT n_nationkey::VARCHAR AS work_id, n_name AS title, 'R' || n_regionkey || '子' AS author FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey = 1")
def catalogue_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A zipped catalogue: works in the public domain of an author."""
    path, out = _place(spark), io.StringIO()
    rows = csv.writer(out)
    rows.writerow(["作品ID", "作品名", "姓", "名", "作品著作権フラグ", "人物著作権フラグ", "テキストファイルURL"])
    for r in _nations(spark, folder):
        i = r["n_nationkey"]
        rows.writerow([i, r["n_name"], f"R{r['n_regionkey']}", "子", "なし" if i % 3 == 0 else "あり", "なし", f"https://x/{i}.zip"])
    put(spark, f"{path}/list.zip", _zipped("list.csv", out.getvalue().encode("utf-8-sig")))
    return archives.public_domain(archives.read_index(spark, path), "R1").select("work_id", "title", "author")


_CLEAN = f"trim(regexp_replace(text, '[{S.WS}\\x{{1C}}-\\x{{1F}}]+', ' ', 'g'))"


@query(f"SELECT 'wiki_' || doc_id AS doc_id, length(t) + (NOT ends_with(t, '。'))::INTEGER AS n FROM (SELECT doc_id, {_CLEAN} AS t FROM documents WHERE text IS NOT NULL) WHERE length(t) >= 80 AND contains(t, '。')")
def dump_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document through an XML dump; short ones and those without a sentence are left out."""
    path = _place(spark)
    docs = read(spark, folder, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("Wikipedia: t"), "doc_id").alias("title"), F.col("text").alias("abstract"), F.concat(F.lit("https://x/y/"), "doc_id", F.lit("/")).alias("url"))
    docs.write.option("rowTag", "doc").option("rootTag", "feed").xml(path)
    return archives.read_dump(spark, path).select("doc_id", F.length("text").alias("n"))


@query(
    f"""WITH f AS (SELECT doc_id, coalesce(source, '') AS title, 't' || doc_id || '。' || regexp_replace(coalesce({_CLEAN}, ''), '<[^>]+>', '', 'g') AS text, coalesce(url, '') AS link FROM documents),
    w AS (SELECT doc_id, regexp_replace(text, '^。+|。+$', '', 'g') || '。' AS text, link, CASE WHEN link <> '' THEN link ELSE 't' || doc_id END AS k FROM f),
    o AS (SELECT k, arg_min(text, doc_id) AS text, min(doc_id) AS d FROM w WHERE length(text) >= 40 GROUP BY 1) SELECT 'doc_' || lpad((row_number() OVER (ORDER BY d) - 1)::VARCHAR, 5, '0') AS doc_id, length(text)::INTEGER AS n, d::VARCHAR AS title FROM o"""
)
def feed_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a feed entry: the first entry of each link, numbered in feed order."""
    path = _place(spark)
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?U)[\s\x1c-\x1f]+", " "))
    items = read(spark, folder, "documents").orderBy("doc_id").select(F.concat(F.lit("t"), "doc_id").alias("title"), body.alias("description"), F.coalesce("url", F.lit("")).alias("link"))
    items.write.option("rowTag", "item").option("rootTag", "rss").xml(path)
    return archives.read_feed(spark, path).select("doc_id", F.length("text").alias("n"), F.expr("substring(title, 2)").alias("title"))


@query("SELECT doc_id::VARCHAR AS title, least(length(trim(text)), 1500)::INTEGER AS n FROM documents WHERE length(trim(text)) >= 120 AND length(left(trim(text), 1500)) - length(replace(left(trim(text), 1500), '。', '')) >= 2")
def article_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Articles that are long enough, cut to a length, with two sentences in it; the cut is the operator's feature."""
    docs = read(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("t"), "text")
    return archives.articles(docs, "t", "text").select("title", F.length("text").alias("n"))


@query("SELECT p_name AS surface, p_brand AS reading, 'Q' || min(p_partkey) AS qid FROM part GROUP BY 1, 2")
def paged_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A paged service whose last page is short: pages are counted by probing, then read in parallel."""
    path, size = _place(spark), 500
    parts = read(spark, folder, "part").select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").collect()  # the service of this query; pages are its files
    value = lambda x: {"value": x}
    for page in range(len(parts) // size + 1):
        own = [{"item": value(f"Q{r['p_partkey']}"), "label": value(r["p_name"]), "kana": value(r["p_brand"])} for r in parts[page * size : (page + 1) * size]]
        put(spark, f"{path}/{page}.json", json.dumps({"results": {"bindings": own}}).encode())
    return pages.read_pages(spark, f"{path}/{{page}}.json", size=size)


_TERMS = ["surface", "reading", "category", "provenance", "reading_source", "reading_confidence", "aliases", "metadata"]


@query(
    f"""WITH {MAP_SQL}, t AS (SELECT reading, surface, {S.key_norm('reading')} AS key, provenance.source_id AS source, coalesce(category, '') AS category FROM term_record)
    SELECT {S.strip('reading')} AS reading, {S.strip('surface')} AS surface, len(list_filter(coalesce(candidates, []), lambda x: x <> ''))::INTEGER AS candidates, source, category FROM t LEFT JOIN m USING (key) WHERE {S.strip('reading')} <> '' AND {S.strip('surface')} <> ''
    UNION ALL SELECT {S.strip('reading')}, {S.strip('gold')}, NULL, source, coalesce(category, '') FROM train WHERE {S.strip('reading')} <> '' AND {S.strip('gold')} <> ''"""
)
def pair_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Classified records with their candidates and raw terms without, as one table."""
    from rankloom.functions.text import key_norm
    from rankloom.operators.skew import salted_lookup

    path = _place(spark)
    terms = read(spark, folder, "term_record").withColumn("key", key_norm(F.col("reading")))
    joined = salted_lookup(terms, candidate_map(spark, folder), ["key"], [F.col("term_id")], "left")
    joined.select(F.to_json(F.struct(F.struct(*_TERMS).alias("record"), "candidates")).alias("value")).write.text(f"{path}/classified")
    raw = read(spark, folder, "train").select("reading", F.col("gold").alias("surface"), "category", F.struct(F.col("source").alias("source_id")).alias("provenance"))
    raw.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/raw")
    return json_lines.read_pairs(spark, f"{path}/classified", f"{path}/raw").withColumn("candidates", F.when(F.col("candidates").isNotNull(), F.size("candidates")))


@query(
    f"""WITH r AS (SELECT term_id, {S.key_norm('reading')} AS key, surface, {S.strong('surface')} AS ns FROM term_record WHERE reading IS NOT NULL AND surface IS NOT NULL) SELECT key, arg_min(surface, term_id) AS surface FROM r WHERE key <> '' AND ns <> '' GROUP BY key, ns"""
)
def dictionary_build(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary of terms: the first surface of each key and surface norm."""
    terms = read(spark, folder, "term_record").filter("reading IS NOT NULL AND surface IS NOT NULL").select("term_id", "reading", "surface")
    return tab_separated.dictionary_of(terms, "term_id")


@query(f"SELECT DISTINCT {S.key_norm('reading')} AS key, {S.weak('surface')} AS surface FROM term_record WHERE {S.key_norm('reading')} <> '' AND {S.weak('surface')} <> '' AND NOT regexp_matches(reading || surface, '[\\t\\r\\n]') AND NOT starts_with(reading, '#')")
def dictionary_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary through tab-separated lines with comments."""
    path = _place(spark)
    terms = read(spark, folder, "term_record").filter("reading IS NOT NULL AND surface IS NOT NULL").filter(~F.concat("reading", "surface").rlike("[\t\r\n]"))
    lines = terms.select(F.concat_ws("\t", "reading", "surface").alias("value"))
    lines.unionByName(lines.select(F.concat(F.lit("# "), "value").alias("value"))).write.text(path)
    return tab_separated.read_dictionary(spark, path)


@query(f"WITH {ALLOW_SQL} SELECT reading AS key, kind FROM allow, (SELECT unnest(['listing', 'json']) AS kind)")
def listing_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The allow-list as a generated listing and as JSON, read back by one reader."""
    path, allowed = _place(spark), allow_list(spark, folder)
    tab_separated.write_listing(allowed, f"{path}/listing", "reading")
    allowed.groupBy(F.lit(1)).agg(F.collect_set("reading").alias("readings")).select(F.to_json(F.struct("readings")).alias("value")).write.text(f"{path}/json")  # one list of keys is the format
    return tab_separated.read_listing(spark, f"{path}/listing").withColumn("kind", F.lit("listing")).unionByName(tab_separated.read_listing(spark, f"{path}/json").withColumn("kind", F.lit("json")))


@query("SELECT unnest(['n', 'hit1', 'gold_in', 'miss_n']) AS metric, unnest([count(*), count(*) FILTER (WHERE mozc_hit1), count(*) FILTER (WHERE gold_in_nbest), count(*) FILTER (WHERE NOT coalesce(mozc_hit1, false))])::VARCHAR AS value FROM train")
def report_sink(spark: SparkSession, folder: str) -> DataFrame:
    """A report of one row through a sink of (metric, value) lines."""
    path = _place(spark)
    tab_separated.write_report(baseline(read(spark, folder, "train")).select("n", "hit1", "gold_in", "miss_n"), path)
    return spark.read.schema("metric string, value string").json(path)


@query("SELECT log_id, length(coalesce(reading, ''))::INTEGER AS reading_size, length(coalesce(context_prev, ''))::INTEGER AS context_size, coalesce(len(nbest), 0)::INTEGER AS candidates, len(list_filter(coalesce(scores, []), lambda x: x IS NOT NULL))::INTEGER AS scored FROM rerank_smoke")
def size_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """What may be logged of a request without its text: sizes only."""
    none, no = F.lit(""), F.array().cast("array<string>")
    return read(spark, folder, "rerank_smoke").select("log_id", F.length(F.coalesce("reading", none)).alias("reading_size"), F.length(F.coalesce("context_prev", none)).alias("context_size"), F.size(F.coalesce("nbest", no)).alias("candidates"), F.size(F.filter(F.coalesce("scores", F.array().cast("array<double>")), lambda x: x.isNotNull())).alias("scored"))


@query(f"SELECT row_id, {fraction_sql('61', 'row_id::VARCHAR')} < 0.05 AS evaluated FROM train")
def split_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """A plain evaluation share by a stable coin of each row."""
    return read(spark, folder, "train").select("row_id", (T_fraction("row_id", 61) < 0.05).alias("evaluated"))


@query("SELECT row_id, concat_ws('\t', coalesce(source, ''), coalesce(reading, ''), coalesce(gold, '')) AS natural_key FROM train")
def natural_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The natural key of every row as text; joins use its columns."""
    none = F.lit("")
    return read(spark, folder, "train").select("row_id", F.concat_ws("\t", F.coalesce("source", none), F.coalesce("reading", none), F.coalesce("gold", none)).alias("natural_key"))


@query("SELECT log_id, row_number() OVER (PARTITION BY reading ORDER BY log_id) - 1 AS place, count(*) OVER (PARTITION BY reading) AS n FROM rerank_smoke WHERE reading IS NOT NULL")
def key_places(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every row within its key, by running totals over blocks, so that a hot key is no hot task."""
    return with_place(read(spark, folder, "rerank_smoke").filter("reading IS NOT NULL").select("log_id", "reading"), "reading", "log_id").select("log_id", "place", "n")
