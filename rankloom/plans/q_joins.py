"""Queries that look up, exclude, deduplicate and combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import candidates as C
from rankloom.operators import dedup as D
from rankloom.operators.prefix import running_total
from rankloom.operators.skew import salted_lookup
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


def keyed(df: DataFrame, column: str = "reading", out: str = "key") -> DataFrame:
    return df.withColumn(out, T.key_norm(F.col(column)))


def candidate_map(spark: SparkSession, folder: str) -> DataFrame:
    """(key, candidates): the list of the last row of each key; the later row wins."""
    rows = keyed(read(spark, folder, "train").select("row_id", "reading", "mozc_nbest")).filter("key IS NOT NULL AND key <> '' AND mozc_nbest IS NOT NULL")
    return D.wins(rows, ["key"], "row_id", last=True).select("key", F.col("mozc_nbest").alias("candidates"))


MAP_SQL = f"k AS (SELECT row_id, {S.key_norm('reading')} AS key, mozc_nbest FROM train), m AS (SELECT key, arg_max(mozc_nbest, row_id) AS candidates FROM k WHERE key <> '' AND mozc_nbest IS NOT NULL GROUP BY 1)"


@query(f"WITH {MAP_SQL}, t AS (SELECT term_id, {S.key_norm('reading')} AS key FROM term_record) SELECT term_id, coalesce(len(candidates), 0)::INTEGER AS n, candidates[1] AS first FROM t LEFT JOIN m USING (key)")
def candidate_attach(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with the candidates of its key; a miss gives an empty list."""
    terms = keyed(read(spark, folder, "term_record").select("term_id", "reading"))
    joined = salted_lookup(terms, candidate_map(spark, folder), ["key"], [F.col("term_id")], "left")
    return joined.select("term_id", F.size(C.or_empty(F.col("candidates"))).alias("n"), F.get("candidates", F.lit(0)).alias("first"))


@query(
    f"""WITH {MAP_SQL}, t AS (SELECT term_id, surface, category, reading, reading_confidence, {S.key_norm('reading')} AS key, {S.weak('surface')} AS w FROM term_record),
    e AS (SELECT term_id, unnest(candidates) AS c, generate_subscripts(candidates, 1) AS i FROM t JOIN m USING (key)), f AS (SELECT term_id, c, row_number() OVER (PARTITION BY term_id ORDER BY i) AS i FROM e WHERE c <> ''),
    r AS (SELECT f.term_id, min(i) AS rank FROM f JOIN t USING (term_id) WHERE {S.weak('c')} = w GROUP BY 1)
    SELECT term_id, rank::INTEGER AS rank, CASE WHEN NOT {S.meaningful('surface')} OR surface IS NULL THEN 'reject:invalid_surface' WHEN NOT {S.valid_key('reading')} THEN 'reject:invalid_reading' WHEN rank <= 5 THEN 'abstain' WHEN rank <= 50 THEN 'rerank'
    WHEN category IN ('address', 'geographic_name', 'person_name', 'organization') AND reading_confidence = 'official' THEN 'dictionary_gap' ELSE 'generation_gap' END AS action FROM t LEFT JOIN r USING (term_id)"""
)
def classify_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What to do with every term, given where its surface stands among the candidates."""
    terms = keyed(read(spark, folder, "term_record").select("term_id", "surface", "category", "reading", "reading_confidence"))
    joined = salted_lookup(terms, candidate_map(spark, folder), ["key"], [F.col("term_id")], "left")
    some = F.filter(C.or_empty(F.col("candidates")), lambda x: x != "")
    n = joined.withColumn("w", T.weak_surface(F.col("surface"))).withColumn("cs", T.nfkc(F.array_join(some, "\u0001"))).withColumn("wc", F.transform(F.split("cs", "\u0001"), T.strip))
    rank = C.rank_of(F.col("w"), F.col("wc")).cast("int")
    stable = F.coalesce(F.col("category").isin("address", "geographic_name", "person_name", "organization") & (F.col("reading_confidence") == "official"), F.lit(False))
    action = (
        F.when(~T.meaningful_surface(F.col("surface")), "reject:invalid_surface").when(~T.valid_key(F.col("reading")), "reject:invalid_reading").when(F.col("rank") <= 5, "abstain")
        .when(F.col("rank") <= 50, "rerank").when(stable, "dictionary_gap").otherwise("generation_gap")
    )
    return n.withColumn("rank", rank).select("term_id", "rank", action.alias("action"))


@query(
    f"""WITH {MAP_SQL}, t AS (SELECT row_id, gold, {S.key_norm('reading')} AS key, {S.weak('gold')} AS w, {S.strong('gold')} AS ns FROM holdout WHERE gold IS NOT NULL), j AS (SELECT t.*, list_filter(coalesce(candidates, []), lambda x: x <> '') AS c FROM t LEFT JOIN m USING (key)),
    e AS (SELECT row_id, unnest(list_distinct(c)) AS x FROM j), n AS (SELECT row_id, x, {S.strong('x')} AS s FROM e), f AS (SELECT j.row_id, min(list_position(c, x)) FILTER (WHERE x = gold) AS exact, min(list_position(c, x)) FILTER (WHERE s = ns AND ns <> '') AS loose FROM j JOIN n USING (row_id) GROUP BY 1)
    SELECT row_id, len(c)::INTEGER AS n, coalesce(exact, loose)::INTEGER AS gold_rank, coalesce(exact, loose) IS NOT NULL AS gold_in, coalesce(c[1] = gold OR {S.weak('c[1]')} = w, false) AS hit1 FROM j LEFT JOIN f USING (row_id)"""
)
def attach_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with the candidates of their key: the target's place, exactly else under the strong norm, and whether the first one is it under the weak norm."""
    rows = keyed(read(spark, folder, "holdout").filter("gold IS NOT NULL").select("row_id", "reading", "gold"))
    joined = salted_lookup(rows, candidate_map(spark, folder), ["key"], [F.col("row_id")], "left")
    some = F.filter(C.or_empty(F.col("candidates")), lambda x: x != "")
    n = joined.select("row_id", "gold", T.nfkc(F.col("gold")).alias("g"), some.alias("c"), T.nfkc(F.array_join(some, "\u0001")).alias("j"))
    strong = lambda x: F.regexp_replace(x, r"(?U)[\s・･]", "")
    n = n.withColumn("norms", F.when(F.size("c") > 0, F.split("j", "\u0001")).otherwise(F.array().cast("array<string>")))
    place = C.rank_exact_then(F.col("gold"), F.col("c"), strong(F.col("g")), F.transform("norms", strong)).cast("int")
    hit = (F.get("c", F.lit(0)) == F.col("gold")) | (T.strip(F.get("norms", F.lit(0))) == T.strip(F.col("g")))
    return n.select("row_id", F.size("c").alias("n"), place.alias("gold_rank"), place.isNotNull().alias("gold_in"), F.coalesce(hit, F.lit(False)).alias("hit1"))


@query("SELECT row_id FROM train t WHERE NOT EXISTS (SELECT 1 FROM holdout h WHERE h.source = t.source AND h.reading = t.reading AND h.gold = t.gold) AND NOT EXISTS (SELECT 1 FROM holdout h WHERE h.reading = t.reading AND h.gold = t.gold)")
def holdout_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows that are not in the holdout, by full key or by (reading, target): two anti joins, not one OR."""
    train, hold = read(spark, folder, "train").select("row_id", "source", "reading", "gold"), read(spark, folder, "holdout").select("source", "reading", "gold")
    return train.join(hold, ["source", "reading", "gold"], "left_anti").join(hold.select("reading", "gold"), ["reading", "gold"], "left_anti").select("row_id")


@query(
    """WITH p AS (SELECT * FROM term_record t WHERE NOT EXISTS (SELECT 1 FROM train r WHERE r.gold = t.surface AND r.reading = t.reading))
    SELECT min(term_id) AS term_id, surface, reading, category FROM p GROUP BY surface, reading, category"""
)
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that are not done yet, the first of each key."""
    terms = read(spark, folder, "term_record").select("term_id", "surface", "reading", "category")
    done = read(spark, folder, "train").select(F.col("gold").alias("surface"), "reading")
    return D.wins(terms.join(done, ["surface", "reading"], "left_anti"), ["surface", "reading", "category"], "term_id").select("term_id", "surface", "reading", "category")


COUNTS_SQL = "c AS (SELECT reading, gold, count(*) AS n FROM train WHERE reading <> '' AND gold <> '' GROUP BY 1, 2)"


def target_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "train").filter("reading <> '' AND gold <> ''").groupBy("reading", "gold").agg(F.count("*").alias("n"))


@query(f"WITH {COUNTS_SQL} SELECT * FROM c")
def key_target_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each key means each target."""
    return target_counts(spark, folder)


#: A target of a key is well supported when this many rows have it.
STRONG = 5
AMBIGUOUS_SQL = f"SELECT reading, count(*) AS targets, max(n) AS most, count(*) FILTER (WHERE n >= {STRONG}) AS strong FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE n >= {STRONG}) >= 2"


@query(f"WITH {COUNTS_SQL} {AMBIGUOUS_SQL}")
def ambiguous_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with two or more well supported targets."""
    return target_counts(spark, folder).groupBy("reading").agg(F.count("*").alias("targets"), F.max("n").alias("most"), F.count_if(F.col("n") >= STRONG).alias("strong")).filter("strong >= 2")


CS_SQL = f"""q AS (SELECT reading, gold, count(*) AS n FROM train WHERE reading <> '' AND gold <> '' AND {S.clean_context('context_prev')} <> '' GROUP BY 1, 2),
    cs AS (SELECT reading, sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS top_share, count(*) FILTER (WHERE n >= 3 AND gold <> reading AND regexp_matches(gold, '[一-鿿]')) AS kanji_targets FROM q GROUP BY 1),
    keys AS (SELECT * FROM cs WHERE total >= 8 AND top_share < 0.70 AND kanji_targets >= 2)"""


def sensitive(rows: DataFrame, content: Column | None = None) -> DataFrame:
    """(reading, total, top_share, kanji_targets) of the keys whose target depends on the context.

    Rows need a context that is not blank after cleaning and, where they carry parts of speech, one that holds content;
    ``content`` says so for rows that carry them.
    """
    kept = rows.filter("reading <> '' AND gold <> ''").filter(T.clean_context(F.col("context_prev")) != "")
    kept = kept if content is None else kept.filter(content)
    counts = kept.groupBy("reading", "gold").agg(F.count("*").alias("n"))
    kanji = (F.col("n") >= 3) & (F.col("gold") != F.col("reading")) & T.has_kanji(F.col("gold"))
    keys = counts.groupBy("reading").agg(F.sum("n").alias("total"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), F.count_if(kanji).alias("kanji_targets"))
    return keys.filter("total >= 8 AND top_share < 0.70 AND kanji_targets >= 2")


def sensitive_keys(spark: SparkSession, folder: str) -> DataFrame:
    return sensitive(read(spark, folder, "train").select("reading", "gold", "context_prev"))


@query(f"WITH {CS_SQL} SELECT * FROM keys")
def cs_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys whose target depends on the context."""
    return sensitive_keys(spark, folder)


SEEDS, BLOCKED = ["かいふうすうでーた", "てつりつこく", "せいき"], ["せいき"]


ALLOW_SQL = f"{CS_SQL}, allow AS (SELECT DISTINCT reading FROM (SELECT reading FROM keys UNION SELECT unnest({SEEDS})) WHERE reading NOT IN ({', '.join(map(S.quote, BLOCKED))}))"


@query(f"WITH {ALLOW_SQL} SELECT * FROM allow")
def allow_list(spark: SparkSession, folder: str) -> DataFrame:
    """Context-sensitive keys and seeds without the blocked ones."""
    seeds = spark.createDataFrame([(x,) for x in SEEDS], "reading string")
    return sensitive_keys(spark, folder).select("reading").union(seeds).distinct().filter(~F.col("reading").isin(BLOCKED))


@query(
    f"""WITH {CS_SQL}, {COUNTS_SQL}, a AS ({AMBIGUOUS_SQL})
    SELECT row_id, a.reading IS NOT NULL AS ambiguous, coalesce(strong, 1) AS reading_gold_count,
    coalesce(keys.reading IS NOT NULL AND {S.clean_context('context_prev')} <> '' AND regexp_matches(gold, '[一-鿿]') AND gold <> t.reading, false) AS context_sensitive, coalesce(top_share, 1.0) AS top_share, coalesce(kanji_targets, 0) AS n_kanji_targets
    FROM train t LEFT JOIN a ON a.reading = t.reading LEFT JOIN keys ON keys.reading = t.reading"""
)
def annotate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with the statistics of its key; defaults where the key has none.

    A row is context-sensitive when its key is, its context is not blank and its target is written with ideographs.
    """
    rows = read(spark, folder, "train").select("row_id", "reading", ((T.clean_context(F.col("context_prev")) != "") & T.has_kanji(F.col("gold")) & (F.col("gold") != F.col("reading"))).alias("fit"))
    counts = ambiguous_keys(spark, folder).select("reading", "strong")
    keys = sensitive_keys(spark, folder).select("reading", "top_share", "kanji_targets")
    joined = salted_lookup(salted_lookup(rows, counts, ["reading"], [F.col("row_id")], "left"), keys, ["reading"], [F.col("row_id")], "left")
    return joined.select(
        "row_id", F.col("strong").isNotNull().alias("ambiguous"), F.coalesce("strong", F.lit(1)).alias("reading_gold_count"), F.coalesce(F.col("top_share").isNotNull() & F.col("fit"), F.lit(False)).alias("context_sensitive"),
        F.coalesce("top_share", F.lit(1.0)).alias("top_share"), F.coalesce("kanji_targets", F.lit(0)).alias("n_kanji_targets"),
    )


def skip_sql(strict: str) -> str:
    return f"CASE WHEN length(coalesce(r, '')) <= 2 THEN 'reading_too_short' WHEN c = '' OR NOT {S.linguistic('c')} THEN 'context_empty_or_symbol' WHEN {strict} AND r NOT IN (SELECT reading FROM allow) THEN 'reading_not_eligible' END"


def skip_reason(reading: Column, context: Column, eligible: Column, strict: Column) -> Column:
    """Why a request is not scored, or null: of a normalised key, a cleaned context, whether the key is on the allow-list, and whether that counts."""
    return F.when(F.length(F.coalesce(reading, F.lit(""))) <= 2, "reading_too_short").when((context == "") | ~T.linguistic(context), "context_empty_or_symbol").when(strict & ~eligible, "reading_not_eligible")


def with_eligible(spark: SparkSession, folder: str, rows: DataFrame, key: str, spread: str) -> DataFrame:
    """Rows with a flag whether their key is on the allow-list; a left join, not a collected set."""
    allowed = allow_list(spark, folder).select(F.col("reading").alias(key), F.lit(True).alias("_eligible"))
    return salted_lookup(rows, allowed, [key], [F.col(spread)], "left").withColumn("eligible", F.coalesce("_eligible", F.lit(False))).drop("_eligible")


@query(f"WITH {ALLOW_SQL} SELECT log_id, {skip_sql('true')} AS skip FROM (SELECT log_id, {S.context_key('reading')} AS r, {S.clean_context('context_prev')} AS c FROM rerank_smoke)")
def guard_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Why a request is not scored, or null."""
    rows = read(spark, folder, "rerank_smoke").select("log_id", T.context_key_norm(F.col("reading")).alias("r"), T.clean_context(F.col("context_prev")).alias("c"))
    return with_eligible(spark, folder, rows, "r", "log_id").select("log_id", skip_reason(F.col("r"), F.col("c"), F.col("eligible"), F.lit(True)).alias("skip"))


#: What the holdout takes out of a bundle: its targets and pairs, its pairs only, or everything of its keys as well.
MODES = ("gold_and_pair", "pair_only", "reading")


def bundle_sql(mode: str = "gold_and_pair") -> str:
    held = {"gold_and_pair": "WHEN gold THEN 'holdout_target' WHEN pair THEN 'holdout_pair'", "pair_only": "WHEN pair THEN 'holdout_pair'", "reading": "WHEN key_held THEN 'holdout_reading' WHEN gold THEN 'holdout_target' WHEN pair THEN 'holdout_pair'"}[mode]
    return f"""{MAP_SQL}, h AS (SELECT DISTINCT reading, {S.strong('gold')} AS ns FROM holdout WHERE gold IS NOT NULL AND {S.strong('gold')} <> ''),
    t AS (SELECT term_id, reading, surface, provenance.source_id AS source, provenance.license_id AS license, {S.key_norm('reading')} AS key, {S.strong('surface')} AS ns FROM term_record WHERE reading <> '' AND surface IS NOT NULL),
    l AS (SELECT key, unnest(candidates) AS c FROM m), n AS (SELECT DISTINCT key, {S.strong('c')} AS ns FROM l),
    j AS (SELECT t.*, m.key IS NULL AS unknown, n.ns IS NOT NULL AS listed, t.ns IN (SELECT ns FROM h) AS gold, (t.reading, t.ns) IN (SELECT (reading, ns) FROM h WHERE reading IS NOT NULL) AS pair, t.reading IN (SELECT reading FROM h WHERE reading IS NOT NULL) AS key_held FROM t LEFT JOIN m USING (key) LEFT JOIN n ON n.key = t.key AND n.ns = t.ns),
    d AS (SELECT *, CASE WHEN ns = '' THEN 'empty' WHEN unknown THEN 'no_candidates' WHEN listed THEN 'in_candidates' {held} END AS reason FROM j),
    r AS (SELECT *, row_number() OVER (PARTITION BY reading, ns ORDER BY term_id) AS dup FROM d WHERE reason IS NULL),
    capped AS (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY term_id) AS place FROM r WHERE dup = 1)"""


BUNDLE_SQL = bundle_sql()


def bundle_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Each term with what speaks against it: known and listed candidates, targets, pairs and keys of the holdout."""
    terms = read(spark, folder, "term_record").filter("reading <> '' AND surface IS NOT NULL").select("term_id", "reading", "surface", F.col("provenance.source_id").alias("source"), F.col("provenance.license_id").alias("license"))
    terms = keyed(terms).withColumn("ns", T.strong_surface(F.col("surface")))
    listed = candidate_map(spark, folder)
    known = listed.select("key", F.lit(True).alias("known"))
    norms = listed.select("key", F.explode("candidates").alias("c")).select("key", T.strong_surface(F.col("c")).alias("ns")).distinct().withColumn("listed", F.lit(True))
    hold = read(spark, folder, "holdout").filter("gold IS NOT NULL").select("reading", T.strong_surface(F.col("gold")).alias("ns")).filter("ns <> ''").distinct()
    golds, pairs, keys = hold.select("ns").distinct().withColumn("gold", F.lit(True)), hold.withColumn("pair", F.lit(True)), hold.select("reading").distinct().withColumn("key_held", F.lit(True))
    spread = [F.col("term_id")]
    j = salted_lookup(salted_lookup(terms, known, ["key"], spread, "left"), norms, ["key", "ns"], spread, "left")
    j = salted_lookup(salted_lookup(j, golds, ["ns"], spread, "left"), pairs, ["reading", "ns"], spread, "left")
    return salted_lookup(j, keys, ["reading"], spread, "left")


def drop_reason(mode: Column) -> Column:
    """The first reason to drop a term in a mode, or null."""
    return (
        F.when(F.col("ns") == "", "empty").when(F.col("known").isNull(), "no_candidates").when(F.col("listed"), "in_candidates").when((mode == "reading") & F.col("key_held"), "holdout_reading")
        .when((mode != "pair_only") & F.col("gold"), "holdout_target").when(F.col("pair"), "holdout_pair")
    )


def bundle_rows(spark: SparkSession, folder: str, mode: str = "gold_and_pair") -> DataFrame:
    """(term_id, reading, surface, source, license, ns, reason): each term with the first reason to drop it."""
    return bundle_flags(spark, folder).select("term_id", "reading", "surface", "source", "license", "ns", drop_reason(F.lit(mode)).alias("reason"))


_MODE_SQL = "SELECT '{0}' AS mode, coalesce(reason, CASE WHEN dup > 1 THEN 'duplicate' WHEN place > 4 THEN 'over_cap' ELSE 'kept' END) AS reason, count(*) AS n FROM d LEFT JOIN (SELECT r.term_id, dup, place FROM r LEFT JOIN capped USING (term_id)) x USING (term_id) GROUP BY ALL"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {bundle_sql(mode)} {_MODE_SQL.format(mode)})" for mode in MODES).replace("r.term_id, dup, place", "r.term_id, r.dup, place"))
def bundle_modes(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the terms in each mode of keeping the holdout out; the flags are joined once for all modes."""
    rows = bundle_flags(spark, folder).withColumn("mode", F.explode(F.array(*map(F.lit, MODES)))).withColumn("reason", drop_reason(F.col("mode"))).select("mode", "term_id", "reading", "ns", "reason")
    firsts = D.wins(rows.filter("reason IS NULL"), ["mode", "reading", "ns"], "term_id")
    capped = D.cap_per_key(firsts, ["mode", "reading"], ["term_id"], 4).select("mode", "term_id", F.lit(True).alias("kept"))
    marks = firsts.select("mode", "term_id", F.lit(True).alias("first")).join(capped, ["mode", "term_id"], "left")
    reason = F.coalesce("reason", F.when(F.col("kept"), "kept").when(F.col("first"), "over_cap").otherwise("duplicate"))
    return rows.join(marks, ["mode", "term_id"], "left").groupBy("mode", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {BUNDLE_SQL} SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, CASE WHEN grouping(license) = 1 THEN '*' ELSE license END AS license, count(*) AS entries, count(DISTINCT reading) AS readings FROM (SELECT coalesce(source, 'unknown') AS source, coalesce(license, 'unknown') AS license, reading FROM capped WHERE place <= 4) GROUP BY CUBE (source, license)")
def bundle_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the bundle by source and license, with all totals, in one pass."""
    kept = D.cap_per_key(D.wins(bundle_rows(spark, folder).filter("reason IS NULL"), ["reading", "ns"], "term_id"), ["reading"], ["term_id"], 4)
    named = kept.select(*[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("source", "license")], "reading")
    name = lambda c: F.when(F.col(f"g_{c}") == 1, "*").otherwise(F.col(c)).alias(c)
    sums = named.cube("source", "license").agg(F.grouping("source").alias("g_source"), F.grouping("license").alias("g_license"), F.count("*").alias("entries"), F.countDistinct("reading").alias("readings"))
    return sums.select(name("source"), name("license"), "entries", "readings")


@query(f"WITH {BUNDLE_SQL} SELECT term_id, reading, surface FROM capped WHERE place <= 4")
def diff_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary entries that the candidates lack and the holdout does not give away, at most four of a key."""
    kept = D.wins(bundle_rows(spark, folder).filter("reason IS NULL"), ["reading", "ns"], "term_id")
    return D.cap_per_key(kept, ["reading"], ["term_id"], 4).select("term_id", "reading", "surface")


@query(f"WITH {BUNDLE_SQL} SELECT source, coalesce(reason, CASE WHEN dup > 1 THEN 'duplicate' ELSE 'kept' END) AS reason, count(*) AS n FROM d LEFT JOIN (SELECT term_id, dup FROM r) USING (term_id) GROUP BY 1, 2")
def bundle_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each source by what became of them."""
    rows = bundle_rows(spark, folder)
    firsts = D.wins(rows.filter("reason IS NULL"), ["reading", "ns"], "term_id").select("term_id", F.lit(True).alias("first"))
    reason = F.coalesce("reason", F.when(F.col("first"), "kept").otherwise("duplicate"))
    return rows.join(firsts, "term_id", "left").groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))


EXTRA_SQL = f"""x AS (SELECT {S.key_norm('reading')} AS key, surface, min(term_id) AS o FROM term_record WHERE surface <> '' AND reading IS NOT NULL GROUP BY 1, 2), xr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o) AS xi FROM x),
    r AS (SELECT row_id, gold, mozc_nbest, {S.key_norm('reading')} AS key FROM holdout),
    l AS (SELECT row_id, unnest(mozc_nbest) AS c FROM r), n AS (SELECT row_id, {S.strong('c')} AS ns FROM l),
    a AS (SELECT r.row_id, surface, xi, row_number() OVER (PARTITION BY r.row_id ORDER BY xi) AS place FROM r JOIN xr USING (key) WHERE {S.strong('surface')} <> '' AND (r.row_id, {S.strong('surface')}) NOT IN (SELECT (row_id, ns) FROM n WHERE ns IS NOT NULL)),
    i AS (SELECT row_id, surface, place FROM a WHERE place <= 3)"""


def injected(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, gold, mozc_nbest, surface, place): rows with the extras of their key that are new to their list."""
    extras = keyed(read(spark, folder, "term_record").filter("surface <> '' AND reading IS NOT NULL").select("term_id", "reading", "surface"))
    extras = extras.groupBy("key", "surface").agg(F.min("term_id").alias("o")).withColumn("ns", T.strong_surface(F.col("surface"))).filter("ns <> ''")
    rows = keyed(read(spark, folder, "holdout").select("row_id", "reading", "gold", "mozc_nbest"))
    met = rows.select("row_id", "key").join(extras, "key")
    norms = rows.select("row_id", F.explode("mozc_nbest").alias("c")).select("row_id", T.strong_surface(F.col("c")).alias("ns"))
    fresh = met.join(norms, ["row_id", "ns"], "left_anti")
    from pyspark.sql import Window as W

    return fresh.withColumn("place", F.row_number().over(W.partitionBy("row_id").orderBy("o", "surface"))).filter("place <= 3").select("row_id", "surface", "place")


@query(f"WITH {EXTRA_SQL} SELECT row_id, surface, place::INTEGER AS place FROM i")
def tail_inject(spark: SparkSession, folder: str) -> DataFrame:
    """At most three dictionary surfaces appended to each list."""
    return injected(spark, folder)


@query(
    f"""WITH {EXTRA_SQL}, g AS (SELECT r.row_id, coalesce(list_contains(mozc_nbest, gold), false) AS before, coalesce(bool_or(i.surface = gold), false) AS added, count(i.row_id) AS extras FROM r LEFT JOIN i USING (row_id) GROUP BY r.row_id, mozc_nbest, gold)
    SELECT count(*) AS n, count(*) FILTER (WHERE before) AS gold_before, count(*) FILTER (WHERE before OR added) AS gold_after, count(*) FILTER (WHERE added AND NOT before) AS rescued, count(*) FILTER (WHERE extras > 0) AS touched, sum(extras)::BIGINT AS extras FROM g"""
)
def inject_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many targets the lists hold before and after the injection."""
    rows = read(spark, folder, "holdout").select("row_id", "gold", "mozc_nbest")
    each = rows.join(injected(spark, folder), "row_id", "left").groupBy("row_id").agg(
        F.first(F.coalesce(F.array_contains("mozc_nbest", F.col("gold")), F.lit(False))).alias("before"), F.coalesce(F.bool_or(F.col("surface") == F.col("gold")), F.lit(False)).alias("added"), F.count("surface").alias("extras")
    )
    return each.agg(F.count("*").alias("n"), F.count_if("before").alias("gold_before"), F.count_if(F.col("before") | F.col("added")).alias("gold_after"), F.count_if(F.col("added") & ~F.col("before")).alias("rescued"), F.count_if(F.col("extras") > 0).alias("touched"), F.sum("extras").alias("extras"))


@query(
    """WITH l AS (SELECT reading, context_prev, final_top1, max(log_id) AS last FROM rerank_smoke GROUP BY ALL)
    SELECT e.log_id, l.last AS last_log, d.tau AS last_tau, CASE WHEN d.tau IS NULL THEN NULL ELSE coalesce(e.scores[1], 0) >= d.tau END AS over FROM rerank_smoke e LEFT JOIN l ON l.reading IS NOT DISTINCT FROM e.reading AND l.context_prev IS NOT DISTINCT FROM e.context_prev AND l.final_top1 IS NOT DISTINCT FROM e.final_top1 JOIN rerank_smoke d ON d.log_id = l.last"""
)
def last_row_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the last logged row of the same (reading, context, shown)."""
    log = read(spark, folder, "rerank_smoke").select("log_id", "reading", "context_prev", "final_top1", "tau", F.coalesce(F.get("scores", F.lit(0)), F.lit(0.0)).alias("s"))
    last = D.wins(log, ["reading", "context_prev", "final_top1"], "log_id", last=True).select("reading", "context_prev", "final_top1", F.col("log_id").alias("last_log"), F.col("tau").alias("last_tau"))
    joined = salted_lookup(log.drop("tau"), last, ["reading", "context_prev", "final_top1"], [F.col("log_id")], "left", null_safe=True)
    return joined.select("log_id", "last_log", "last_tau", (F.col("s") >= F.col("last_tau")).alias("over"))


@query("SELECT doc_id, count(*) AS rows FROM train t WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = t.doc_id AND d.lang = 'ja') GROUP BY 1")
def missing_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that rows refer to and that the Japanese documents lack."""
    docs = read(spark, folder, "documents").filter("lang = 'ja'").select("doc_id")
    return read(spark, folder, "train").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).join(docs, "doc_id", "left_anti")


@query("SELECT split_name, reading IS NOT NULL AND reading IN (SELECT reading FROM train WHERE reading IS NOT NULL) AS overlap, count(*) AS n, count(*) FILTER (WHERE mozc_hit1) AS hits FROM holdout GROUP BY 1, 2")
def overlap_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Holdout rows by whether training knows their reading."""
    seen = read(spark, folder, "train").filter("reading IS NOT NULL").select("reading").distinct().withColumn("seen", F.lit(True))
    rows = read(spark, folder, "holdout").select("row_id", "split_name", "reading", "mozc_hit1")
    return salted_lookup(rows, seen, ["reading"], [F.col("row_id")], "left").groupBy("split_name", F.coalesce("seen", F.lit(False)).alias("overlap")).agg(F.count("*").alias("n"), F.count_if("mozc_hit1").alias("hits"))


@query("SELECT split_name, count(DISTINCT d) AS shared_docs FROM (SELECT split_name, doc_id AS d FROM holdout WHERE doc_id IN (SELECT doc_id FROM train WHERE doc_id IS NOT NULL)) GROUP BY 1")
def leak_check(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a split shares with training."""
    docs = read(spark, folder, "holdout").select("split_name", "doc_id").distinct()
    return docs.join(read(spark, folder, "train").filter("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("split_name").agg(F.count("doc_id").alias("shared_docs"))


@query("SELECT reading, gold, context_prev FROM train WHERE reading IS NOT NULL INTERSECT SELECT reading, gold, context_prev FROM holdout")
def row_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that are in both tables."""
    columns = ["reading", "gold", "context_prev"]
    return read(spark, folder, "train").filter("reading IS NOT NULL").select(columns).intersect(read(spark, folder, "holdout").select(columns))


@query("SELECT min(row_id) AS row_id, reading, gold FROM train GROUP BY reading, gold")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each (reading, target)."""
    return D.wins(read(spark, folder, "train").select("row_id", "reading", "gold"), ["reading", "gold"], "row_id")


@query("SELECT reading, max(row_id) AS row_id, arg_max(coalesce(gold, '?'), row_id) AS gold, min(row_id) AS position FROM train GROUP BY reading")
def dedup_last(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each reading, at the position of its first."""
    return read(spark, folder, "train").groupBy("reading").agg(F.max("row_id").alias("row_id"), F.max_by(F.coalesce("gold", F.lit("?")), "row_id").alias("gold"), F.min("row_id").alias("position"))


@query("SELECT row_id, reading, gold FROM (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY row_id) AS k FROM (SELECT min(row_id) AS row_id, reading, gold FROM train GROUP BY reading, gold)) WHERE k <= 2")
def per_key_cap(spark: SparkSession, folder: str) -> DataFrame:
    """At most two targets of each reading, after the dedup."""
    return D.cap_per_key(dedup_first(spark, folder), ["reading"], ["row_id"], 2)


@query(f"SELECT key, min(row_id) AS first_row, count(*) AS n FROM (SELECT row_id, {S.key_norm('reading')} AS key FROM train) WHERE key <> '' GROUP BY 1")
def unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every key with where it is first seen."""
    return keyed(read(spark, folder, "train").select("row_id", "reading")).filter("key <> ''").groupBy("key").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, min(row_id) AS first_row FROM train GROUP BY 1 ORDER BY n DESC, first_row LIMIT 20")
def most_common(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most frequent sources, earlier first on ties: a top-k report."""
    return read(spark, folder, "train").groupBy("source").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row")).orderBy(F.desc("n"), "first_row").limit(20)


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) AS spent FROM events WHERE value IS NOT NULL")
def running_spend(spark: SparkSession, folder: str) -> DataFrame:
    """Spend up to each event, by running totals over blocks of ids instead of one global window."""
    e = read(spark, folder, "events").filter("value IS NOT NULL").select("event_id", "value").withColumn("block", F.floor(F.col("event_id") / 4096).cast("int"))
    return running_total(e, [], "block", [F.col("event_id")], "value", "before").select("event_id", F.round(F.col("before") + F.col("value"), 4).alias("spent"))


@query("SELECT event_id FROM (SELECT event_id, value, sum(value) OVER (ORDER BY event_id) AS s FROM events WHERE value IS NOT NULL) WHERE s <= 5000")
def budget_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The events that a budget pays for."""
    e = read(spark, folder, "events").filter("value IS NOT NULL").select("event_id", "value").withColumn("block", F.floor(F.col("event_id") / 4096).cast("int"))
    return running_total(e, [], "block", [F.col("event_id")], "value", "before").filter(F.col("before") + F.col("value") <= 5000).select("event_id")


@query("SELECT kind, count(*) AS n, count(DISTINCT reading) AS readings FROM (SELECT 'train' AS kind, reading, gold FROM train UNION ALL SELECT 'holdout', reading, gold FROM holdout UNION ALL SELECT 'term', reading, surface FROM term_record) GROUP BY 1")
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Three tables as one."""
    parts = [read(spark, folder, t).select(F.lit(k).alias("kind"), "reading", F.col(c).alias("gold")) for k, t, c in (("train", "train", "gold"), ("holdout", "holdout", "gold"), ("term", "term_record", "surface"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("reading").alias("readings"))


@query("SELECT reading, gold, arg_min(kind, (pri, id)) AS kind, count(*) AS copies FROM (SELECT 'train' AS kind, 0 AS pri, row_id AS id, reading, gold FROM train UNION ALL SELECT 'term', 1, term_id, reading, surface FROM term_record) WHERE reading IS NOT NULL AND gold IS NOT NULL GROUP BY 1, 2")
def union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows and new terms by key; training wins."""
    a = read(spark, folder, "train").select(F.lit("train").alias("kind"), F.struct(F.lit(0).alias("p"), F.col("row_id").alias("i")).alias("o"), "reading", "gold")
    b = read(spark, folder, "term_record").select(F.lit("term").alias("kind"), F.struct(F.lit(1).alias("p"), F.col("term_id").alias("i")).alias("o"), "reading", F.col("surface").alias("gold"))
    return a.unionByName(b).filter("reading IS NOT NULL AND gold IS NOT NULL").groupBy("reading", "gold").agg(F.min_by("kind", "o").alias("kind"), F.count("*").alias("copies"))


@query("SELECT reading FROM holdout WHERE reading IS NOT NULL EXCEPT SELECT reading FROM train")
def key_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the holdout that training lacks."""
    return read(spark, folder, "holdout").filter("reading IS NOT NULL").select("reading").subtract(read(spark, folder, "train").select("reading"))
