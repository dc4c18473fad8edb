"""Queries that assemble training, evaluation and usage sets and report on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import assembly as A
from rankloom.operators import splits
from rankloom.operators.places import with_place
from rankloom.operators.skew import salted_lookup
from rankloom.plans.q_text import T_fraction, fraction_sql
from rankloom.session import materialize
from rankloom.session import read_table as read

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIZES = A.Sizes()
RESERVE = max(SIZES.least_evaluation, round(SIZES.evaluation * SIZES.share))


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _order(seed: int, key: str = "row_id::VARCHAR", tie: str = "row_id") -> str:
    return f"sha256('{seed}:' || {key}), {tie}"


def _place(seed: int, first: str = "") -> str:
    return f"row_number() OVER (ORDER BY {first}{_order(seed)}) - 1"


ROWS_SQL = f"""t AS (SELECT *, coalesce('d' || doc_id, 'r' || row_id) AS doc FROM train),
    docs AS (SELECT doc, starts_with(arg_min(coalesce(source, ''), row_id), 'news_fresh') AS fresh FROM t GROUP BY 1),
    pool AS (SELECT doc, row_number() OVER (ORDER BY {_order(5, 'doc', 'doc')}) - 1 AS p, count(*) OVER () AS n FROM docs WHERE NOT fresh),
    cut AS (SELECT doc, p, n, greatest(1, floor(n * {SIZES.train_share}::DOUBLE)) AS k FROM pool),
    placed AS (SELECT doc, CASE WHEN p < k THEN 'train' WHEN p < k + CASE WHEN n > k THEN greatest(1, floor((n - k) / 2)) ELSE 0 END THEN 'unseen' ELSE 'unused' END AS split FROM cut UNION ALL SELECT doc, 'fresh' FROM docs WHERE fresh),
    u AS (SELECT row_id, split, reading, gold, context_prev, coalesce(context_sensitive, false) AS sensitive, coalesce(mozc_hit1, false) AS hit, coalesce(ambiguous, false) AS ambiguous, coalesce(context_prev, '') <> '' AS context, coalesce(top_gold_share, 1.0) AS share FROM t JOIN placed USING (doc) WHERE gold_in_nbest),
    tc AS (SELECT row_id, {_place(31)} AS p FROM u WHERE split = 'train' AND sensitive), ta AS (SELECT row_id, hit, context, {_place(32, 'NOT hit, ')} AS p FROM u WHERE split = 'train' AND NOT sensitive),
    z0 AS (SELECT count(*) AS c, CASE WHEN count(*) - {RESERVE} >= {SIZES.least_train} THEN {RESERVE} ELSE greatest(0, count(*) - {SIZES.least_train}) END AS kept FROM tc), z1 AS (SELECT kept, c - kept AS n FROM z0),
    z AS (SELECT kept, n, CASE WHEN n > 0 THEN greatest(0, least(greatest(round_even(n / {SIZES.share}, 0), ceil(n / {SIZES.highest})), floor(n / {SIZES.lowest})) - n) ELSE 0 END AS wanted FROM z1),
    chosen AS (SELECT row_id, 'sensitive' AS role, false AS corrupted FROM tc, z WHERE p >= kept UNION ALL SELECT row_id, 'anchor', false FROM ta, z WHERE p < wanted),
    free AS (SELECT ta.* FROM ta, z WHERE p >= wanted), sp AS (SELECT row_id, {_place(33)} AS p FROM free WHERE context), spoiled AS (SELECT row_id FROM sp WHERE p < round_even((SELECT count(*) FROM chosen) * {SIZES.corrupt}, 0)),
    train_set AS (SELECT * FROM chosen UNION ALL SELECT row_id, 'anchor', true FROM spoiled),
    sa AS (SELECT row_id, {_place(34, 'NOT hit, ')} AS p FROM free WHERE row_id NOT IN (SELECT row_id FROM spoiled)),
    seen AS (SELECT row_id, 'sensitive' AS role FROM tc, z WHERE p < kept UNION ALL SELECT row_id, 'anchor' FROM sa, z WHERE p < greatest(0, {SIZES.evaluation} - kept))"""


def _evaluation_sql(name: str, seed: int) -> str:
    return f"""{name}_c AS (SELECT row_id, {_place(seed)} AS p FROM u WHERE split = '{name}' AND sensitive), {name}_a AS (SELECT row_id, {_place(seed + 1, 'NOT hit, ')} AS p FROM u WHERE split = '{name}' AND NOT sensitive),
    {name}_n AS (SELECT (SELECT count(*) FROM {name}_c) AS c, (SELECT count(*) FROM {name}_a) AS a),
    {name}_z AS (SELECT CASE WHEN c < {SIZES.least_evaluation} THEN c ELSE least(c, greatest({SIZES.least_evaluation}, round_even({SIZES.evaluation} * {SIZES.share}, 0))) END AS taken, CASE WHEN c < {SIZES.least_evaluation} AND c > {SIZES.highest} * {SIZES.evaluation} THEN ceil(c / {SIZES.share}) ELSE {SIZES.evaluation} END AS n, a FROM {name}_n),
    {name}_e AS (SELECT row_id, 'sensitive' AS role FROM {name}_c, {name}_z WHERE p < taken UNION ALL SELECT row_id, 'anchor' FROM {name}_a, {name}_z WHERE p < n - taken UNION ALL SELECT row_id, 'fill' FROM {name}_c, {name}_z WHERE p >= taken AND p < taken + greatest(0, n - taken - least(n - taken, a)))"""


SETS_SQL = f"WITH {ROWS_SQL}, {_evaluation_sql('unseen', 35)}, {_evaluation_sql('fresh', 37)}, every AS (SELECT 'train' AS name, row_id, role, corrupted FROM train_set UNION ALL SELECT 'eval_seen', row_id, role, false FROM seen UNION ALL SELECT 'eval_unseen', row_id, role, false FROM unseen_e UNION ALL SELECT 'eval_fresh', row_id, role, false FROM fresh_e)"


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that can be used, with the split of their document."""
    none, no = F.lit(""), F.lit(False)
    t = read(spark, folder, "train").withColumn("doc", F.coalesce(F.concat(F.lit("d"), F.col("doc_id")), F.concat(F.lit("r"), F.col("row_id"))))
    placed = A.document_split(t.select("row_id", "doc", "source"), "row_id", "doc", "source", SIZES.train_share, 5)
    flag = lambda c: F.coalesce(c, no).alias(c)
    rows = t.filter("gold_in_nbest").select(
        "row_id", "doc", "reading", "gold", "context_prev", F.coalesce("context_sensitive", no).alias("sensitive"), F.coalesce("mozc_hit1", no).alias("hit"), flag("ambiguous"), (F.coalesce("context_prev", none) != "").alias("context"), F.coalesce("top_gold_share", F.lit(1.0)).alias("share"),
    )
    return materialize(salted_lookup(rows, placed, ["doc"], [F.col("row_id")]).drop("doc"))


def sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """((name, row_id, role, corrupted) of the four sets, the annotated rows)."""
    rows = annotated(spark, folder)
    train, seen = A.train_set(rows.filter("split = 'train'"), "row_id", SIZES, RESERVE)
    parts = [train.select(F.lit("train").alias("name"), "row_id", "role", "corrupted"), seen.select(F.lit("eval_seen").alias("name"), "row_id", "role", F.lit(False).alias("corrupted"))]
    for name, seed in (("unseen", 35), ("fresh", 37)):
        own = A.evaluation_set(rows.filter(F.col("split") == name), "row_id", SIZES, seed)
        parts.append(own.select(F.lit(f"eval_{name}").alias("name"), "row_id", "role", F.lit(False).alias("corrupted")))
    return materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])), rows


_CUT_SQL = f"""CASE WHEN corrupted AND length(c) >= 4 THEN CASE WHEN {fraction_sql('7', 'row_id::VARCHAR')} < 0.5 THEN substr(c, 1, length(c) // 2) ELSE array_to_string(list_filter(string_split(c, ''), lambda x, i: i % 2 = 1), '') END ELSE c END"""


@query(f"{SETS_SQL} SELECT row_id, role, corrupted, {_CUT_SQL} AS context FROM (SELECT e.row_id, role, e.corrupted, coalesce(context_prev, '') AS c FROM every e JOIN train USING (row_id) WHERE name = 'train')")
def assemble_train(spark: SparkSession, folder: str) -> DataFrame:
    """A training set: context-sensitive rows beyond a reserve, as many anchors, hits first, as make them 30 to 40 %, and a few unused anchors with a corrupted context."""
    made, rows = sets(spark, folder)
    joined = made.filter("name = 'train'").join(rows.select("row_id", F.coalesce("context_prev", F.lit("")).alias("c")), "row_id")
    half, thin = F.left("c", F.floor(F.length("c") / 2).cast("int")), F.array_join(F.filter(F.split("c", ""), lambda x, i: i % 2 == 0), "")
    cut = F.when(F.col("corrupted") & (F.length("c") >= 4), F.when(T_fraction("row_id", 7) < 0.5, half).otherwise(thin)).otherwise(F.col("c"))
    return joined.select("row_id", "role", "corrupted", cut.alias("context"))


@query(f"{SETS_SQL} SELECT name, row_id, role FROM every WHERE name <> 'train'")
def assemble_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation sets of seen, unseen and fresh documents."""
    return sets(spark, folder)[0].filter("name <> 'train'").select("name", "row_id", "role")


@query(
    f"""{SETS_SQL}, j AS (SELECT e.*, reading, gold, context_prev, sensitive, hit, u.ambiguous, share FROM every e JOIN u USING (row_id))
    SELECT name, count(*) AS n, count(*) FILTER (WHERE sensitive AND NOT corrupted) AS sensitive, round_even(count(*) FILTER (WHERE sensitive AND NOT corrupted) / count(*), 4) AS sensitive_share, count(DISTINCT reading) FILTER (WHERE sensitive) AS sensitive_readings,
    round_even(count(*) FILTER (WHERE ambiguous) / count(*), 4) AS ambiguous_share, round_even((list(share ORDER BY share) FILTER (WHERE sensitive))[count(*) FILTER (WHERE sensitive) // 2 + 1], 4) AS share_median, round_even(count(*) FILTER (WHERE coalesce(context_prev, '') <> '') / count(*), 4) AS context_share,
    round_even(count(*) FILTER (WHERE regexp_matches(context_prev, '[\\r\\n]')) / count(*), 4) AS newline_share, round_even(count(*) FILTER (WHERE regexp_matches(lower(context_prev), '==|\\[edit\\]|\\[編集\\]')) / count(*), 4) AS markup_share,
    count(*) FILTER (WHERE sensitive AND gold = reading) AS same, round_even(count(*) FILTER (WHERE hit) / count(*), 4) AS hit_share, count(*) FILTER (WHERE corrupted) AS corrupted FROM j GROUP BY 1"""
)
def assemble_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every assembled set; the median is exact, over counts of equal shares."""
    from rankloom.operators.stats import upper_median_by

    made, rows = sets(spark, folder)
    j = made.join(rows, "row_id")
    part = lambda c: F.bround(F.count_if(F.coalesce(c, F.lit(False))) / F.count("*"), 4)
    cs, context = F.col("sensitive"), F.col("context_prev")
    stats = j.groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(cs & ~F.col("corrupted")).alias("sensitive"), part(cs & ~F.col("corrupted")).alias("sensitive_share"), F.countDistinct(F.when(cs, F.col("reading"))).alias("sensitive_readings"), part(F.col("ambiguous")).alias("ambiguous_share"),
        part(context != "").alias("context_share"), part(context.rlike("[\r\n]")).alias("newline_share"), part(F.lower(context).rlike(r"==|\[edit\]|\[編集\]")).alias("markup_share"),
        F.count_if(cs & (F.col("gold") == F.col("reading"))).alias("same"), part(F.col("hit")).alias("hit_share"), F.count_if("corrupted").alias("corrupted"),
    )
    medians = upper_median_by(j.filter("sensitive").select("name", "share"), ["name"], "share", 0.01).select("name", F.bround("share", 4).alias("share_median"))
    return stats.join(medians, "name", "left")


@query(f"{SETS_SQL}, docs_of AS (SELECT DISTINCT name, doc FROM every JOIN t USING (row_id)) SELECT name, count(*) AS docs, count(*) FILTER (WHERE doc IN (SELECT doc FROM docs_of WHERE name = 'train')) AS docs_in_train, (SELECT count(*) FROM every e WHERE e.name = docs_of.name AND row_id IN (SELECT row_id FROM every WHERE name = 'train')) AS rows_in_train FROM docs_of WHERE name <> 'train' GROUP BY 1")
def assemble_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and rows that each evaluation set shares with training; seen documents may be shared, rows never."""
    made, _ = sets(spark, folder)
    keys = read(spark, folder, "train").select("row_id", F.coalesce(F.concat(F.lit("d"), F.col("doc_id")), F.concat(F.lit("r"), F.col("row_id"))).alias("doc"))
    each = made.join(keys, "row_id")
    train = each.filter("name = 'train'")
    docs = each.filter("name <> 'train'").select("name", "doc").distinct().join(train.select("doc").distinct().withColumn("met", F.lit(1)), "doc", "left").groupBy("name").agg(F.count("*").alias("docs"), F.count("met").alias("docs_in_train"))
    rows = each.filter("name <> 'train'").join(train.select("row_id", F.lit(1).alias("met")), "row_id", "left").groupBy("name").agg(F.count("met").alias("rows_in_train"))
    return docs.join(rows, "name")


SMALL = {"train": 2000, "eval_seen": 300, "eval_unseen": 300, "eval_fresh": 300}
AMBIGUOUS = 0.6
_SPLIT_OF = {"train": "train", "eval_seen": "train", "eval_unseen": "unseen", "eval_fresh": "fresh"}


def _small_sql(name: str, split: str, n: str, seed: int) -> str:
    amb = f"floor({n} * {AMBIGUOUS})"
    return f"""{name}_r AS (SELECT row_id, ambiguous, row_number() OVER (PARTITION BY ambiguous ORDER BY {_order(seed)}) - 1 AS p FROM u WHERE split = '{split}'),
    {name}_f AS (SELECT row_id, false AS filled FROM {name}_r WHERE p < CASE WHEN ambiguous THEN {amb} ELSE {n} - {amb} END), {name}_l AS (SELECT row_id, row_number() OVER (ORDER BY {_order(seed + 1)}) AS k FROM {name}_r WHERE row_id NOT IN (SELECT row_id FROM {name}_f)),
    {name}_s AS (SELECT row_id, filled FROM {name}_f UNION ALL SELECT row_id, true FROM {name}_l WHERE k <= {n} - (SELECT count(*) FROM {name}_f))"""


_FRESH = f"least({SMALL['eval_fresh']}, (SELECT count(*) FROM u WHERE split = 'fresh'))"
SMALL_SQL = f"""WITH {ROWS_SQL}, {_small_sql('small_train', 'train', str(SMALL['train']), 41)}, {_small_sql('small_seen', 'train', str(SMALL['eval_seen']), 43)}, {_small_sql('small_unseen', 'unseen', str(SMALL['eval_unseen']), 45)}, {_small_sql('small_fresh', 'fresh', _FRESH, 47)}, {_small_sql('small_pad', 'unseen', f"({SMALL['eval_fresh']} - {_FRESH})", 49)}
    SELECT 'train' AS name, row_id, filled, false AS padded FROM small_train_s UNION ALL SELECT 'eval_seen', row_id, filled, false FROM small_seen_s UNION ALL SELECT 'eval_unseen', row_id, filled, false FROM small_unseen_s
    UNION ALL SELECT 'eval_fresh', row_id, filled, false FROM small_fresh_s UNION ALL SELECT 'eval_fresh', row_id, filled, true FROM small_pad_s"""


def _with_ambiguous(rows: DataFrame, n: int, seed: int) -> DataFrame:
    amb = int(n * AMBIGUOUS)
    stratum = rows.select("row_id", F.when(F.col("ambiguous"), "ambiguous").otherwise("plain").alias("stratum"))
    return splits.quota_sample(stratum, "row_id", "stratum", {"ambiguous": amb, "plain": n - amb}, n, seed).select("row_id", "filled")


@query(SMALL_SQL)
def assemble_small(spark: SparkSession, folder: str) -> DataFrame:
    """Small sets with a share of ambiguous rows; a fresh set that is too small is padded from the unseen documents and says so."""
    rows = annotated(spark, folder)
    fresh = min(SMALL["eval_fresh"], rows.filter("split = 'fresh'").count())
    wanted = [("train", "train", SMALL["train"], 41, False), ("eval_seen", "train", SMALL["eval_seen"], 43, False), ("eval_unseen", "unseen", SMALL["eval_unseen"], 45, False), ("eval_fresh", "fresh", fresh, 47, False), ("eval_fresh", "unseen", SMALL["eval_fresh"] - fresh, 49, True)]
    parts = [_with_ambiguous(rows.filter(F.col("split") == split), n, seed).select(F.lit(name).alias("name"), "row_id", "filled", F.lit(padded).alias("padded")) for name, split, n, seed, padded in wanted if n]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


MIX = 3  # groups of the mix for each usage row in training
USAGE_SHARE = 0.5
_MIX_SQL = f"""WITH g AS (SELECT log_id, reading, row_number() OVER (PARTITION BY reading ORDER BY log_id) AS p, count(*) OVER (PARTITION BY reading) AS n FROM rerank_smoke WHERE reading <> ''),
    h AS (SELECT log_id, reading, CASE WHEN n = 1 THEN {fraction_sql('9', 'reading')} < 0.2 ELSE p > n - least(n - 1, greatest(1, round_even(n * 0.2, 0))) END AS held FROM g),
    ut AS (SELECT log_id, reading, row_number() OVER (PARTITION BY reading ORDER BY log_id) - 1 AS p, count(*) OVER (PARTITION BY reading) AS n FROM h WHERE NOT held),
    z AS (SELECT count(*) AS rows, count(DISTINCT reading) AS keys, greatest(count(*), round_even(count(*) * {MIX} * {USAGE_SHARE}, 0))::BIGINT AS usage, greatest(0, count(*) * {MIX} - greatest(count(*), round_even(count(*) * {MIX} * {USAGE_SHARE}, 0)))::BIGINT AS public FROM ut),
    ks AS (SELECT reading, row_number() OVER (ORDER BY {_order(51, 'reading', 'reading')}) - 1 AS k FROM (SELECT DISTINCT reading FROM ut)),
    us AS (SELECT log_id, unnest(range(0, (usage // keys + CASE WHEN k < usage % keys THEN 1 ELSE 0 END)::BIGINT)) AS round, p, n FROM ut JOIN ks USING (reading), z),
    pu AS (SELECT row_id, coalesce(mozc_top1 = gold, false) AS anchor, row_number() OVER (PARTITION BY coalesce(mozc_top1 = gold, false) ORDER BY {_order(53)}) - 1 AS p FROM train WHERE reading <> '' AND gold <> '' AND gold_in_nbest),
    pz AS (SELECT public, least((SELECT count(*) FROM pu WHERE anchor), round_even(public * 0.7, 0)) AS a FROM z), pq AS (SELECT public, a, least((SELECT count(*) FROM pu WHERE NOT anchor), greatest(0, public - a)) AS b FROM pz),
    pc AS (SELECT row_id, anchor, p < CASE WHEN anchor THEN a ELSE b END AS taken, public - a - b AS short FROM pu, pq), pl AS (SELECT row_id, short, row_number() OVER (ORDER BY {_order(54)}) AS k FROM pc WHERE NOT taken)
    SELECT 'usage' AS kind, log_id AS id, round::INTEGER AS round FROM us WHERE round % n = p UNION ALL SELECT CASE WHEN anchor THEN 'anchor' ELSE 'residual' END, row_id, 0 FROM pc WHERE taken UNION ALL SELECT 'fill', row_id, 0 FROM pl WHERE k <= short"""


def usage_train(spark: SparkSession, folder: str) -> DataFrame:
    """(log_id, reading): usage rows that are not in the held-out tail of their key."""
    g = with_place(read(spark, folder, "rerank_smoke").filter("reading <> ''").select("log_id", "reading"), "reading", "log_id")
    n = F.col("n")
    tail = F.col("place") >= n - F.least(n - 1, F.greatest(F.lit(1), F.bround(n * 0.2, 0)))
    return g.filter(~F.when(n == 1, T_fraction("reading", 9) < 0.2).otherwise(tail)).select("log_id", "reading")


@query(_MIX_SQL)
def usage_mix(spark: SparkSession, folder: str) -> DataFrame:
    """A fine-tuning mix: usage rows cycled over their keys, and public rows of which seven tenths are anchors."""
    own = materialize(usage_train(spark, folder))
    rows = own.count()
    usage = max(rows, round(rows * MIX * USAGE_SHARE))
    public = max(0, rows * MIX - usage)
    cycled = A.cycled(own, "reading", "log_id", usage, 51).select(F.lit("usage").alias("kind"), F.col("log_id").alias("id"), "round")
    usable = read(spark, folder, "train").filter("reading <> '' AND gold <> '' AND gold_in_nbest").select("row_id", F.coalesce(F.col("mozc_top1") == F.col("gold"), F.lit(False)).alias("anchor"))
    drawn = A.anchored_sample(usable, "row_id", "anchor", public, 0.7, 53)
    return cycled.unionByName(drawn.select(F.col("role").alias("kind"), F.col("row_id").alias("id"), F.lit(0).alias("round")))
