"""Queries that split and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import dedup as D
from rankloom.operators import splits
from rankloom.operators.places import with_place
from rankloom.plans.q_text import T_fraction, fraction_sql
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


@query(
    """WITH k AS (SELECT DISTINCT reading FROM train WHERE reading IS NOT NULL), r AS (SELECT reading, row_number() OVER (ORDER BY sha256('3:' || reading), reading) AS p FROM k)
    SELECT row_id, t.reading, coalesce(p <= greatest(1, round_even((SELECT count(*) FROM k) * 0.2, 0)), false) AS held FROM train t LEFT JOIN r USING (reading)"""
)
def split_group_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose whole reading is held out."""
    return splits.group_holdout(read(spark, folder, "train"), "row_id", "reading", 0.2, 3)


@query(
    """WITH d AS (SELECT doc_id, coalesce(starts_with(source, 'news_fresh'), false) AS fresh FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('5:' || doc_id::VARCHAR), doc_id) - 1 AS p, count(*) OVER () AS n FROM d WHERE NOT fresh),
    q AS (SELECT doc_id, p, greatest(1, floor(n * 0.8::DOUBLE)) AS t, n FROM r)
    SELECT doc_id, CASE WHEN p < t THEN 'train' WHEN p < t + CASE WHEN n > t THEN greatest(1, floor((n - t) / 2)) ELSE 0 END THEN 'unseen' ELSE 'unused' END AS split FROM q UNION ALL SELECT doc_id, 'fresh' FROM d WHERE fresh"""
)
def split_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents into train, unseen, fresh and unused."""
    docs = read(spark, folder, "documents").select("doc_id", F.coalesce(F.col("source").startswith("news_fresh"), F.lit(False)).alias("fresh"))
    pool = docs.filter("NOT fresh").select("doc_id")
    n = pool.count()
    t = max(1, int(n * 0.8))
    unseen = max(1, (n - t) // 2) if n > t else 0
    rank = F.col("hash_rank")
    placed = D.hash_rank(pool, [], "doc_id", 5).select("doc_id", F.when(rank < t, "train").when(rank < t + unseen, "unseen").otherwise("unused").alias("split"))
    return placed.unionByName(docs.filter("fresh").select("doc_id", F.lit("fresh").alias("split")))


@query(
    f"""WITH g AS (SELECT log_id, reading, row_number() OVER (PARTITION BY reading ORDER BY log_id) AS p, count(*) OVER (PARTITION BY reading) AS n FROM rerank_smoke WHERE reading IS NOT NULL)
    SELECT log_id, CASE WHEN n = 1 THEN {fraction_sql('9', 'reading')} < 0.2 ELSE p > n - least(n - 1, greatest(1, round_even(n * 0.2, 0))) END AS held FROM g"""
)
def split_usage_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The last outcomes of each key are held out; a single one by its hash."""
    g = with_place(read(spark, folder, "rerank_smoke").filter("reading IS NOT NULL").select("log_id", "reading"), "reading", "log_id")
    n = F.col("n")
    tail = F.col("place") >= n - F.least(n - 1, F.greatest(F.lit(1), F.bround(n * 0.2, 0)))
    return g.select("log_id", F.when(n == 1, T_fraction("reading", 9) < 0.2).otherwise(tail).alias("held"))


_QUOTA_SQL = """WITH r AS (SELECT row_id, s, row_number() OVER (PARTITION BY s ORDER BY sha256('{a}:' || row_id::VARCHAR), row_id) - 1 AS p FROM (SELECT row_id, {s} AS s FROM train)),
    f AS (SELECT * FROM r WHERE p < {q}), l AS (SELECT row_id, s, row_number() OVER (ORDER BY sha256('{b}:' || row_id::VARCHAR), row_id) AS k FROM r WHERE NOT p < {q})
    SELECT row_id, s AS stratum, false AS filled FROM f UNION ALL SELECT row_id, s, true FROM l WHERE k <= {t} - (SELECT count(*) FROM f)"""
_SLICE = "CASE WHEN coalesce(mozc_hit1, false) THEN 'anchor' WHEN coalesce(gold_in_nbest, false) THEN 'residual' ELSE 'other' END"


@query(_QUOTA_SQL.format(a=13, b=14, s=_SLICE, q="CASE s WHEN 'anchor' THEN 400 WHEN 'residual' THEN 5000 ELSE 0 END", t=6000))
def sample_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Residual and anchor quotas, filled to the total from the rest: a sampling operator."""
    hit, inside = F.coalesce("mozc_hit1", F.lit(False)), F.coalesce("gold_in_nbest", F.lit(False))
    rows = read(spark, folder, "train").select("row_id", F.when(hit, "anchor").when(inside, "residual").otherwise("other").alias("stratum"))
    return splits.quota_sample(rows, "row_id", "stratum", {"anchor": 400, "residual": 5000}, 6000, 13)


@query(_QUOTA_SQL.format(a=17, b=18, s="CASE WHEN coalesce(ambiguous, false) THEN 'ambiguous' ELSE 'plain' END", q="CASE s WHEN 'ambiguous' THEN 600 ELSE 400 END", t=1000))
def sample_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of given size with a share of ambiguous rows."""
    rows = read(spark, folder, "train").select("row_id", F.when(F.coalesce("ambiguous", F.lit(False)), "ambiguous").otherwise("plain").alias("stratum"))
    return splits.quota_sample(rows, "row_id", "stratum", {"ambiguous": 600, "plain": 400}, 1000, 17)


@query("SELECT row_id, hit FROM (SELECT row_id, coalesce(mozc_hit1, false) AS hit, row_number() OVER (ORDER BY NOT coalesce(mozc_hit1, false), sha256('19:' || row_id::VARCHAR), row_id) AS k FROM train WHERE NOT coalesce(context_sensitive, false)) WHERE k <= 500")
def sample_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors, those with a baseline hit first: a sampling operator with a fixed size."""
    rows = read(spark, folder, "train").filter("NOT coalesce(context_sensitive, false)").select("row_id", F.coalesce("mozc_hit1", F.lit(False)).alias("hit"))
    return rows.orderBy(~F.col("hit"), D.sha_order("row_id", 19), "row_id").limit(500)


@query(
    """WITH g AS (SELECT reading, log_id, row_number() OVER (PARTITION BY reading ORDER BY log_id) - 1 AS p, count(*) OVER (PARTITION BY reading) AS n FROM rerank_smoke WHERE reading IS NOT NULL),
    r AS (SELECT unnest(range(3)) AS round) SELECT round::INTEGER AS round, reading, log_id FROM r, g WHERE p = round % n"""
)
def sample_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced oversampling: in each round every key gives its next row, from the start again when it has no more."""
    g = with_place(read(spark, folder, "rerank_smoke").filter("reading IS NOT NULL").select("log_id", "reading"), "reading", "log_id")
    rounds = F.filter(F.array(*[F.lit(i) for i in range(3)]), lambda r: F.pmod(r, F.col("n")) == F.col("place"))
    return g.select(F.explode(rounds).alias("round"), "reading", "log_id")


@query(
    """WITH u AS (SELECT row_id, 'fresh' AS split, false AS padded FROM holdout WHERE split_name = 'eval_fresh'), x AS (SELECT row_id, row_number() OVER (ORDER BY sha256('21:' || row_id::VARCHAR), row_id) AS k FROM holdout WHERE split_name = 'eval_unseen')
    SELECT * FROM u UNION ALL SELECT row_id, 'fresh', true FROM x WHERE k <= 400 - (SELECT count(*) FROM u)"""
)
def pad_fresh(spark: SparkSession, folder: str) -> DataFrame:
    """The fresh split, padded to a size from the unseen one; padded rows are flagged."""
    hold = read(spark, folder, "holdout").select("row_id", "split_name")
    fresh = hold.filter("split_name = 'eval_fresh'").select("row_id", F.lit("fresh").alias("split"), F.lit(False).alias("padded"))
    missing = max(0, 400 - fresh.count())
    extra = D.hash_rank(hold.filter("split_name = 'eval_unseen'").select("row_id"), [], "row_id", 21).filter(F.col("hash_rank") < missing)
    return fresh.unionByName(extra.select("row_id", F.lit("fresh").alias("split"), F.lit(True).alias("padded")))


@query(
    """WITH s AS (SELECT count(*) FILTER (WHERE coalesce(context_sensitive, false)) AS cs, count(*) FILTER (WHERE NOT coalesce(context_sensitive, false)) AS rest FROM train),
    z AS (SELECT cs, rest, least(greatest(round_even(cs / 0.35, 0), ceil(cs / 0.40)), floor(cs / 0.30))::BIGINT AS total FROM s)
    SELECT cs, total, least(rest, greatest(0, total - cs))::BIGINT AS anchors, round_even((cs + least(rest, greatest(0, total - cs))) * 0.02, 0)::BIGINT AS corrupted FROM z"""
)
def assembly_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each kind a training set takes so that context-sensitive ones have their share."""
    cs = F.coalesce("context_sensitive", F.lit(False))
    s = read(spark, folder, "train").agg(F.count_if(cs).alias("cs"), F.count_if(~cs).alias("rest"))
    total = F.least(F.greatest(F.bround(F.col("cs") / 0.35, 0), F.ceil(F.col("cs") / 0.40)), F.floor(F.col("cs") / 0.30)).cast("bigint")
    z = s.withColumn("total", total).withColumn("anchors", F.least("rest", F.greatest(F.lit(0), F.col("total") - F.col("cs"))))
    return z.select("cs", "total", "anchors", F.bround((F.col("cs") + F.col("anchors")) * 0.02, 0).cast("bigint").alias("corrupted"))
