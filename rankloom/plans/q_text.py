"""Queries over scalar text functions and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import tables
from rankloom.plans import sqltext as S
from rankloom.session import read_table as read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


@query(f"SELECT term_id, {S.weak('surface')} AS weak, {S.strong('surface')} AS strong FROM term_record")
def norm_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """Both surface norms of every term."""
    n = read(spark, folder, "term_record").select("term_id", T.nfkc(F.col("surface")).alias("n"))
    return n.select("term_id", T.strip(F.col("n")).alias("weak"), F.regexp_replace("n", r"(?U)[\s・･]", "").alias("strong"))


@query(f"SELECT row_id, k AS key, c AS context_key, {S.valid_key('k')} AS valid FROM (SELECT row_id, {S.key_norm('reading')} AS k, {S.context_key('reading')} AS c FROM train)")
def norm_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Both key norms of every reading and whether the key is valid."""
    n = read(spark, folder, "train").select("row_id", T.nfkc(F.col("reading")).alias("n"))
    keyed = n.select("row_id", F.regexp_replace(T.to_hiragana(F.col("n")), r"(?U)[\s・･]", "").alias("key"), T.to_hiragana_small(F.col("n")).alias("context_key"))
    return keyed.withColumn("valid", T.valid_key(F.col("key")))


@query(
    f"""SELECT row_id, meaningful, plausible_key, plausible_surface, plausible_key AND plausible_surface AND has_candidates AS row_ok, token_ok FROM (
    SELECT row_id, {S.meaningful('gold')} AS meaningful, coalesce(regexp_full_match({S.strip('reading')}, '[ぁ-ゖァ-ヶー・･]{{1,40}}'), false) AS plausible_key,
    coalesce(length({S.weak('gold')}) BETWEEN 1 AND 48, false) AS plausible_surface, coalesce(len(mozc_nbest) > 0, false) AS has_candidates,
    coalesce(regexp_full_match(reading, '[ぁ-ゖー]{{1,16}}') AND length(gold) BETWEEN 1 AND 12, false) AS token_ok FROM train)"""
)
def quality_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Quality checks of keys, surfaces, tokens and rows."""
    rows = read(spark, folder, "train").select("row_id", "reading", "gold", F.coalesce(F.size("mozc_nbest") > 0, F.lit(False)).alias("has"), T.weak_surface(F.col("gold")).alias("w"))
    no = F.lit(False)
    flags = rows.select(
        "row_id", T.meaningful_surface(F.col("gold")).alias("meaningful"), F.coalesce(T.strip(F.col("reading")).rlike("^[ぁ-ゖァ-ヶー・･]{1,40}$"), no).alias("plausible_key"),
        F.coalesce(F.length("w").between(1, 48), no).alias("plausible_surface"), "has", F.coalesce(F.col("reading").rlike("^[ぁ-ゖー]{1,16}$") & F.length("gold").between(1, 12), no).alias("token_ok"),
    )
    return flags.select("row_id", "meaningful", "plausible_key", "plausible_surface", (F.col("plausible_key") & F.col("plausible_surface") & F.col("has")).alias("row_ok"), "token_ok")


@query(f"SELECT row_id, {S.clean_context('context_prev')} AS clean, right({S.clean_context('context_prev')}, 10) AS short FROM train")
def context_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned left contexts and their last ten characters."""
    clean = read(spark, folder, "train").select("row_id", T.clean_context(F.col("context_prev")).alias("clean"))
    return clean.withColumn("short", T.cap_context(F.col("clean"), 10))


@query(f"SELECT doc_id, {S.clean_context('substr(text, 1, length(text) // 2)', 30)} AS context FROM documents")
def left_context(spark: SparkSession, folder: str) -> DataFrame:
    """The clean left context at the middle of every document."""
    half = F.expr("substring(text, 1, cast(length(text) / 2 as int))")
    return read(spark, folder, "documents").select("doc_id", T.clean_context(half, 30).alias("context"))


@query(f"SELECT log_id, {S.linguistic('context_prev')} AS linguistic, c = '' OR NOT {S.linguistic('c')} AS context_empty FROM (SELECT log_id, context_prev, {S.clean_context('context_prev')} AS c FROM rerank_smoke)")
def linguistic_content(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a context has letters, and whether nothing is left of it after cleaning."""
    rows = read(spark, folder, "rerank_smoke").select("log_id", "context_prev", T.clean_context(F.col("context_prev")).alias("c"))
    return rows.select("log_id", T.linguistic(F.col("context_prev")).alias("linguistic"), ((F.col("c") == "") | ~T.linguistic(F.col("c"))).alias("context_empty"))


@query(f"SELECT row_id, position, candidate FROM (SELECT row_id, generate_subscripts(mozc_nbest, 1)::INTEGER AS position, unnest(mozc_nbest) AS candidate FROM holdout) WHERE {S.junk('candidate')}")
def junk_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every junk surface among the candidates."""
    each = read(spark, folder, "holdout").select("row_id", F.posexplode("mozc_nbest").alias("position", "candidate"))
    return each.select("row_id", (F.col("position") + 1).alias("position"), "candidate").filter(T.junk_surface(F.col("candidate")))


@query("SELECT row_id, '読み: ' || coalesce(reading, '') || CASE WHEN coalesce(context_prev, '') <> '' THEN ' [SEP] 文脈: ' || context_prev ELSE '' END || ' [SEP] 候補: ' || coalesce(gold, '') AS pair_text FROM holdout")
def pair_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text of a (key, context, candidate) pair; an empty context is left out."""
    none = F.lit("")
    context = F.when(F.coalesce("context_prev", none) != "", F.concat(F.lit("文脈: "), "context_prev"))
    return read(spark, folder, "holdout").select("row_id", F.concat_ws(" [SEP] ", F.concat(F.lit("読み: "), F.coalesce("reading", none)), context, F.concat(F.lit("候補: "), F.coalesce("gold", none))).alias("pair_text"))


PROMPT = ("日本語入力の変換候補を提案してください。", "直前の入力: ", "現在の入力: ", "既存候補（これら以外を提案）: ", "3つの候補を改行区切りで出力（説明不要）:")  # fixed values


@query(
    f"""WITH c AS (SELECT row_id, unnest(mozc_nbest) AS x, generate_subscripts(mozc_nbest, 1) AS i FROM holdout),
    d AS (SELECT row_id, x, min(i) AS i FROM c WHERE x <> '' GROUP BY 1, 2),
    t AS (SELECT row_id, x, i, row_number() OVER (PARTITION BY row_id ORDER BY i) AS r FROM d),
    l AS (SELECT row_id, string_agg(x, ', ' ORDER BY i) AS names FROM t WHERE r <= 5 GROUP BY 1)
    SELECT row_id, '{PROMPT[0]}' || chr(10) || chr(10) || CASE WHEN coalesce(context_prev, '') <> '' THEN '{PROMPT[1]}' || context_prev || chr(10) || chr(10) ELSE '' END
    || '{PROMPT[2]}' || coalesce(reading, '') || chr(10) || chr(10) || CASE WHEN names IS NOT NULL THEN '{PROMPT[3]}' || names || chr(10) || chr(10) ELSE '' END || '{PROMPT[4]}' || chr(10) AS prompt
    FROM holdout LEFT JOIN l USING (row_id)"""
)
def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of a key with its context and at most five known candidates."""
    from rankloom.operators.candidates import dedupe

    names = F.slice(dedupe(F.col("mozc_nbest")), 1, 5)
    context = F.when(F.coalesce("context_prev", F.lit("")) != "", F.concat(F.lit(PROMPT[1]), "context_prev", F.lit("\n\n"))).otherwise("")
    known = F.when(F.size(names) > 0, F.concat(F.lit(PROMPT[3]), F.concat_ws(", ", names), F.lit("\n\n"))).otherwise("")
    return read(spark, folder, "holdout").select("row_id", F.concat(F.lit(PROMPT[0] + "\n\n"), context, F.lit(PROMPT[2]), F.coalesce("reading", F.lit("")), F.lit("\n\n"), known, F.lit(PROMPT[4] + "\n")).alias("prompt"))


@query(
    """WITH s AS (SELECT doc_id, string_split_regex(text, '[\\n\\r]+|,|、') AS parts FROM documents),
    e AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, regexp_replace(unnest(parts), '^[・*• \\t\\x{3000}-]+|[・*• \\t\\x{3000}-]+$', '', 'g') AS c FROM s),
    d AS (SELECT doc_id, c, min(i) AS i FROM e WHERE c <> '' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM d)
    SELECT doc_id, place::INTEGER AS place, c AS candidate FROM r WHERE place <= 3"""
)
def parse_completion(spark: SparkSession, folder: str) -> DataFrame:
    """The first three distinct items of a text that lists candidates."""
    parts = F.transform(F.split("text", "[\\n\\r]+|,|、"), lambda x: F.regexp_replace(x, "^[・*• \\t　-]+|[・*• \\t　-]+$", ""))
    three = F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, 3)
    return read(spark, folder, "documents").select("doc_id", F.posexplode(three).alias("place", "candidate")).select("doc_id", (F.col("place") + 1).alias("place"), "candidate")


def fraction_sql(seed: str, text: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {text}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


@query(
    f"""SELECT row_id, f AS fraction, CASE WHEN length(c) >= 4 THEN CASE WHEN f < 0.5 THEN substr(c, 1, length(c) // 2)
    ELSE array_to_string(list_filter(string_split(c, ''), lambda x, i: i % 2 = 1), '') END ELSE c END AS corrupted FROM (
    SELECT row_id, coalesce(context_prev, '') AS c, round({fraction_sql('7', 'row_id::VARCHAR')}, 9) AS f FROM train)"""
)
def corrupted_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts cut in half or thinned, by a stable coin."""
    c, f = F.coalesce("context_prev", F.lit("")), F.round(T_fraction("row_id", 7), 9)
    thin = F.array_join(F.filter(F.split(c, ""), lambda x, i: i % 2 == 0), "")
    cut = F.when(f < 0.5, F.left(c, F.floor(F.length(c) / 2).cast("int"))).otherwise(thin)
    return read(spark, folder, "train").select("row_id", f.alias("fraction"), F.when(F.length(c) >= 4, cut).otherwise(c).alias("corrupted"))


def T_fraction(column: str, seed: int):
    """A stable number in [0, 1) from the first 64 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")), 256), 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


# How places and companies end.
PLACE_END, COMPANY = "(市|区|町|村|駅|県|府|道)$", "株式会社|有限会社|合同会社"


@query(
    f"""SELECT hint, count(*) AS n FROM (SELECT CASE WHEN coalesce(category, '') <> '' THEN category WHEN regexp_matches(gold, '{PLACE_END}') THEN 'place_suffix'
    WHEN regexp_matches(gold, '{COMPANY}') THEN 'company' ELSE 'other' END AS hint FROM train WHERE NOT coalesce(mozc_hit1, false) AND NOT coalesce(gold_in_nbest, false)) GROUP BY 1"""
)
def type_hints(spark: SparkSession, folder: str) -> DataFrame:
    """What kinds of targets the candidates miss."""
    rows = read(spark, folder, "train").filter("NOT coalesce(mozc_hit1, false) AND NOT coalesce(gold_in_nbest, false)")
    hint = F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).when(F.col("gold").rlike(PLACE_END), "place_suffix").when(F.col("gold").rlike(COMPANY), "company").otherwise("other")
    return rows.groupBy(hint.alias("hint")).agg(F.count("*").alias("n"))


@query("SELECT (length(text) // 8) * 8 AS bucket, count(*) AS n, sum(CASE WHEN length(text) <= 512 THEN 1 ELSE 0 END)::BIGINT AS short FROM documents WHERE text IS NOT NULL GROUP BY 1")
def length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """A histogram of lengths in steps of eight."""
    size = F.length("text")
    return read(spark, folder, "documents").filter("text IS NOT NULL").groupBy((F.floor(size / 8) * 8).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(size <= 512).alias("short"))


@query(
    """SELECT log_id, array_to_string(list_filter([CASE WHEN coalesce(ts, '') = '' THEN 'missing:ts' END, CASE WHEN coalesce(reading, '') = '' THEN 'missing:reading' END,
    CASE WHEN nbest IS NULL THEN 'missing:nbest' END, CASE WHEN coalesce(chosen, '') = '' THEN 'missing:chosen' END], lambda x: x IS NOT NULL), ',') AS errors FROM rerank_smoke"""
)
def validate_log(spark: SparkSession, folder: str) -> DataFrame:
    """Error codes of every log row."""
    return read(spark, folder, "rerank_smoke").select("log_id", F.concat_ws(",", tables.log_errors()).alias("errors"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS packed FROM events""")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """A field out of JSON text and a row into JSON text."""
    return read(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("packed"))


@query(
    f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM l),
    m AS (SELECT doc_id, i, line, regexp_full_match(line, '[{S.WS}]*-{{20,}}[{S.WS}]*') AS bar, starts_with(line, '底本：') AS stop FROM n),
    d AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m WHERE bar),
    b AS (SELECT doc_id, max(i) AS i FROM d WHERE k = 2 GROUP BY 1),
    e AS (SELECT m.doc_id, min(m.i) AS i FROM m LEFT JOIN b USING (doc_id) WHERE m.stop AND m.i > coalesce(b.i, 0) GROUP BY 1)
    SELECT l.doc_id, coalesce({S.strip("string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE m.i > coalesce(b.i, 0) AND m.i < coalesce(e.i, 1000000000))")}, '') AS body
    FROM l LEFT JOIN m ON m.doc_id = l.doc_id LEFT JOIN b ON b.doc_id = l.doc_id LEFT JOIN e ON e.doc_id = l.doc_id GROUP BY l.doc_id"""
)
def boilerplate_strip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts after the second dashed line and before the colophon."""
    return read(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", tables.strip_boilerplate(F.col("text")).alias("body"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, unnest(regexp_extract_all(line, '｜[^《\\n]+《[^》\\n]+》')) AS x, 0 AS implicit FROM l UNION ALL
          SELECT doc_id, unnest(regexp_extract_all(line, '[一-鿿々〆ヶ]{1,20}《[^》\\n]+》')), 1 FROM l)
    SELECT DISTINCT doc_id, implicit, regexp_extract(x, '^｜?([^《]+)《', 1) AS surface, regexp_extract(x, '《([^》]+)》', 1) AS reading FROM m"""
)
def ruby_markup(spark: SparkSession, folder: str) -> DataFrame:
    """(surface, reading) of explicit and implicit ruby."""
    return tables.ruby(read(spark, folder, "documents"), "doc_id", "text").distinct()


@query("SELECT doc_id, trim(regexp_replace(text, '</?[A-Za-z][^>]*>', '', 'g')) AS plain FROM documents")
def strip_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Every text without tags."""
    return read(spark, folder, "documents").select("doc_id", F.trim(F.regexp_replace("text", "</?[A-Za-z][^>]*>", "")).alias("plain"))


TOKEN_SQL = f"""l AS (SELECT doc_id, regexp_extract_all(text, {S.quote(tables.TOKEN)}) AS parts FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS i FROM l),
    o AS (SELECT doc_id, i, token, (sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) - length(token))::BIGINT AS char_begin,
        (sum((token IN ('。', '！', '？', '!', '?'))::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) - (token IN ('。', '！', '？', '!', '?'))::INTEGER)::BIGINT AS sent_id,
        CASE WHEN regexp_full_match(token, '[一-鿿々〆ヶ]+|[ァ-ヺー]+|[A-Za-zＡ-Ｚａ-ｚ]+|[0-9０-９.,．，]*[0-9０-９][0-9０-９.,．，]*') THEN '名詞' WHEN regexp_full_match(token, '[ぁ-ゖ][ぁ-ゖー]*') THEN '助詞' ELSE '補助記号' END AS pos FROM u),
    k AS (SELECT doc_id, i::INTEGER - 1 AS position, sent_id, char_begin, token, pos FROM o)"""


@query(f"WITH {TOKEN_SQL} SELECT doc_id, position, sent_id, char_begin, token, pos FROM k WHERE NOT regexp_full_match(token, '[{S.WS}]+')")
def token_explode(spark: SparkSession, folder: str) -> DataFrame:
    """Every token of every whole text, cut by script, with its sentence, offset and part of speech; blanks are no tokens."""
    return tables.tokens(read(spark, folder, "documents"), "doc_id", "text").filter(~F.col("token").rlike(r"(?U)^\s+$"))


@query(f"WITH {TOKEN_SQL} SELECT doc_id, position, token FROM k WHERE pos = '名詞' AND NOT regexp_full_match(token, '{tables.DIGITS_ONLY}') AND NOT regexp_matches(token, 'https?://|www\\.|@')")
def content_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens that carry content: by part of speech, without numbers in any script and addresses."""
    t = tables.tokens(read(spark, folder, "documents"), "doc_id", "text")
    return t.filter(tables.content_token(F.array("pos"), F.col("token"))).select("doc_id", "position", "token")


@query(
    """WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^。！？!?]*[。！？!?]|[^。！？!?]+$') AS parts FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i FROM s)
    SELECT doc_id, i::INTEGER - 1 AS sent_id, (sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY i) - length(sentence))::BIGINT AS char_begin, length(sentence)::INTEGER AS length FROM e"""
)
def sentence_index(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of every document with their number and offset."""
    return tables.sentences(read(spark, folder, "documents"), "doc_id", "text")


@query(
    """SELECT n_name AS name, kind, text FROM (SELECT n_nationkey, n_name, r_name, unnest(['nation', 'region', 'both']) AS kind, unnest([n_name, r_name, r_name || ' ' || n_name]) AS text FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE text <> ''"""
)
def expand_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row into several records."""
    joined = read(spark, folder, "nation").join(F.broadcast(read(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # the table of regions is fixed and tiny
    pieces = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in (("nation", F.col("n_name")), ("region", F.col("r_name")), ("both", F.concat_ws(" ", "r_name", "n_name")))])
    return joined.select(F.col("n_name").alias("name"), F.inline(pieces)).filter("text <> ''")
