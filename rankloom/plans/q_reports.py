"""Queries that summarise: coverage, quality, gates, latencies, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import gate, stats
from rankloom.operators.skew import salted_lookup
from rankloom.plans.q_candidates import DECIDE_SQL, GROUPS_SQL, SWEPT_SQL, TAUS, groups, metrics_sql
from rankloom.plans.q_joins import AMBIGUOUS_SQL, COUNTS_SQL, CS_SQL, ambiguous_keys, sensitive_keys
from rankloom.plans.q_text import COMPANY, PLACE_END
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


BASE_SQL = """SELECT *, round(hit1 / n, 6) AS hit1_share, round(gold_in / n, 6) AS gold_in_share, round(prefix / n, 6) AS prefix_share, round(empty / n, 6) AS empty_share, round(miss_recoverable / greatest(miss_n, 1), 6) AS recoverable_share, round(gold_in / n - hit1 / n, 6) AS headroom FROM (
    SELECT count(*) AS n, count(*) FILTER (WHERE mozc_hit1) AS hit1, count(*) FILTER (WHERE gold_in_nbest) AS gold_in, count(*) FILTER (WHERE gold_in_nbest AND NOT coalesce(mozc_hit1, false)) AS not_top1,
    count(*) FILTER (WHERE coalesce(len(mozc_nbest), 0) = 0) AS empty, count(*) FILTER (WHERE starts_with(gold, mozc_top1) AND mozc_top1 <> '') AS prefix, round(avg(gold_rank), 6) AS rank_mean, round(quantile_cont(gold_rank, 0.5), 6) AS rank_median,
    count(*) FILTER (WHERE gold_rank = 1) AS rank_1, count(*) FILTER (WHERE gold_rank BETWEEN 2 AND 3) AS rank_2_3, count(*) FILTER (WHERE gold_rank BETWEEN 4 AND 10) AS rank_4_10, count(*) FILTER (WHERE gold_rank > 10) AS rank_11,
    count(*) FILTER (WHERE NOT coalesce(mozc_hit1, false)) AS miss_n, count(*) FILTER (WHERE NOT coalesce(mozc_hit1, false) AND gold_in_nbest) AS miss_recoverable FROM train)"""


def baseline(rows: DataFrame) -> DataFrame:
    """One row about the baseline: hits, coverage, ranks, what reranking could win; shares are null for no rows."""
    hit, inside, rank = F.coalesce("mozc_hit1", F.lit(False)), F.coalesce("gold_in_nbest", F.lit(False)), F.col("gold_rank")
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hit1"), F.count_if(inside).alias("gold_in"), F.count_if(inside & ~hit).alias("not_top1"), F.count_if(F.coalesce(F.size("mozc_nbest"), F.lit(0)) <= 0).alias("empty"),
        F.count_if(F.col("gold").startswith(F.col("mozc_top1")) & (F.col("mozc_top1") != "")).alias("prefix"), F.round(F.avg(rank), 6).alias("rank_mean"), F.round(F.percentile(rank, 0.5), 6).alias("rank_median"),
        F.count_if(rank == 1).alias("rank_1"), F.count_if(rank.between(2, 3)).alias("rank_2_3"), F.count_if(rank.between(4, 10)).alias("rank_4_10"), F.count_if(rank > 10).alias("rank_11"), F.count_if(~hit).alias("miss_n"), F.count_if(~hit & inside).alias("miss_recoverable"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    shares = {"hit1_share": F.col("hit1") / n, "gold_in_share": F.col("gold_in") / n, "prefix_share": F.col("prefix") / n, "empty_share": F.col("empty") / n, "recoverable_share": F.col("miss_recoverable") / F.greatest("miss_n", F.lit(1)), "headroom": F.col("gold_in") / n - F.col("hit1") / n}
    return counts.select("*", *[F.round(c, 6).alias(name) for name, c in shares.items()])


@query(BASE_SQL)
def baseline_report(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline report of the training rows."""
    return baseline(read(spark, folder, "train"))


@query("SELECT coalesce(nullif(category, ''), 'unknown') AS category, count(*) AS n, count(*) FILTER (WHERE mozc_hit1) AS hit1 FROM train GROUP BY 1")
def baseline_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and hits of every category."""
    return read(spark, folder, "train").groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"), F.count_if("mozc_hit1").alias("hit1"))


@query(f"WITH b AS ({BASE_SQL}) SELECT gold_in / n >= 0.50 AND not_top1 / n > 0.05 AS go, round(gold_in / n, 6) AS gold_share, round(not_top1 / n, 6) AS headroom FROM b")
def gate_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Whether reranking is worth it."""
    share, room = F.col("gold_in") / F.col("n"), F.col("not_top1") / F.col("n")
    return baseline(read(spark, folder, "train")).select(((share >= 0.5) & (room > 0.05)).alias("go"), F.round(share, 6).alias("gold_share"), F.round(room, 6).alias("headroom"))


SLICE_SQL = "CASE WHEN mozc_hit1 THEN 'hit' WHEN gold_in_nbest THEN 'A' ELSE 'B' END"


def slice_tag():
    return F.when(F.col("mozc_hit1"), "hit").when(F.col("gold_in_nbest"), "A").otherwise("B")


_HINT_SQL = f"CASE WHEN coalesce(category, '') <> '' THEN category WHEN regexp_matches(gold, '{PLACE_END}') THEN 'place_suffix' WHEN regexp_matches(gold, '{COMPANY}') THEN 'company' ELSE 'other' END"


@query(
    f"""WITH t AS (SELECT {SLICE_SQL} AS slice, coalesce(nullif(category, ''), 'unknown') AS category, coalesce(nullif(source, ''), 'unknown') AS source, {_HINT_SQL} AS hint FROM train),
    g AS (SELECT slice, category, source, hint, grouping(category, source, hint) AS g, count(*) AS n FROM t GROUP BY GROUPING SETS ((slice), (slice, category), (slice, source), (slice, hint)))
    SELECT slice, CASE g WHEN 7 THEN 'all' WHEN 3 THEN 'category' WHEN 5 THEN 'source' ELSE 'hint' END AS kind, CASE g WHEN 7 THEN '*' WHEN 3 THEN category WHEN 5 THEN source ELSE hint END AS value, n, round_even(n / (SELECT count(*) FROM train), 4) AS share FROM g"""
)
def ab_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each slice, in all and by category, source and hint, in one pass."""
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias(c)
    hint = F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).when(F.col("gold").rlike(PLACE_END), "place_suffix").when(F.col("gold").rlike(COMPANY), "company").otherwise("other")
    rows = read(spark, folder, "train").select(slice_tag().alias("slice"), name("category"), name("source"), hint.alias("hint"))
    kinds = ["category", "source", "hint"]
    sets = rows.groupingSets([["slice"], *[["slice", k] for k in kinds]], "slice", *kinds).agg(F.grouping_id().alias("g"), *[F.grouping(k).alias(f"g_{k}") for k in kinds], F.count("*").alias("n"))
    kind, value = F.lit("all"), F.lit("*")
    for k in kinds:
        kind, value = F.when(F.col(f"g_{k}") == 0, k).otherwise(kind), F.when(F.col(f"g_{k}") == 0, F.col(k)).otherwise(value)
    whole = F.sum(F.when(kind == "all", F.col("n"))).over(W.partitionBy(F.lit(1)))  # over the groups, not the rows
    return sets.select("slice", kind.alias("kind"), value.alias("value"), "n", F.bround(F.col("n") / whole, 4).alias("share"))


@query(f"SELECT count(*) FILTER (WHERE s = 'B') / count(*) >= 0.25 AS source_more, round(count(*) FILTER (WHERE s = 'B') / count(*), 6) AS b_share FROM (SELECT {SLICE_SQL} AS s FROM train)")
def sourcing_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the unrecoverable slice calls for more candidates."""
    share = F.count_if(F.col("s") == "B") / F.count("*")
    return read(spark, folder, "train").select(slice_tag().alias("s")).agg((share >= 0.25).alias("source_more"), F.round(share, 6).alias("b_share"))


@query(
    """WITH h AS (SELECT gold_rank, count(*) AS n FROM train WHERE gold_rank IS NOT NULL AND NOT coalesce(mozc_hit1, false) GROUP BY 1), c AS (SELECT gold_rank, n, sum(n) OVER (ORDER BY gold_rank) / sum(n) OVER () AS cover FROM h)
    SELECT gold_rank, n, round(cover, 6) AS cover, gold_rank = (SELECT min(gold_rank) FROM c WHERE cover >= 0.95) AS enough FROM c"""
)
def gold_rank_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much a list cut at each rank would cover; ranks are few, so their running sum is over a small table."""
    h = read(spark, folder, "train").filter("gold_rank IS NOT NULL AND NOT coalesce(mozc_hit1, false)").groupBy("gold_rank").agg(F.count("*").alias("n"))
    whole = W.partitionBy(F.lit(1))
    cover = F.sum("n").over(whole.orderBy("gold_rank").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(whole)
    c = h.withColumn("c", cover).withColumn("first", F.min(F.when(F.col("c") >= 0.95, F.col("gold_rank"))).over(whole))
    return c.select("gold_rank", "n", F.round("c", 6).alias("cover"), (F.col("gold_rank") == F.col("first")).alias("enough"))


@query("SELECT len(mozc_nbest)::INTEGER AS candidates, gold_rank, count(*) AS n FROM holdout WHERE mozc_nbest IS NOT NULL GROUP BY 1, 2")
def rank_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks by length of the list."""
    return read(spark, folder, "holdout").filter("mozc_nbest IS NOT NULL").groupBy(F.size("mozc_nbest").alias("candidates"), "gold_rank").agg(F.count("*").alias("n"))


@query(
    """SELECT split_name, count(*) AS n, count(DISTINCT reading) AS readings, count(DISTINCT doc_id) AS docs, round(avg(length(context_prev)), 6) AS context_mean, count(*) FILTER (WHERE gold = reading) AS same, count(*) FILTER (WHERE regexp_matches(context_prev, '\\[|==|<')) AS residue FROM holdout GROUP BY 1"""
)
def assemble_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every split."""
    return read(spark, folder, "holdout").groupBy("split_name").agg(
        F.count("*").alias("n"), F.countDistinct("reading").alias("readings"), F.countDistinct("doc_id").alias("docs"), F.round(F.avg(F.length("context_prev")), 6).alias("context_mean"),
        F.count_if(F.col("gold") == F.col("reading")).alias("same"), F.count_if(F.col("context_prev").rlike(r"\[|==|<")).alias("residue"),
    )


@query(
    """WITH s AS (SELECT count(*) AS n, avg(coalesce(context_sensitive, false)::INT) AS cs, avg((coalesce(context_prev, '') <> '')::INT) AS ctx, avg(coalesce(gold_in_nbest, false)::INT) AS cover FROM train)
    SELECT criterion, ok, bool_and(ok) OVER () AS go FROM (SELECT unnest(['rows', 'context_sensitive', 'context', 'coverage']) AS criterion, unnest([n >= 1000, cs BETWEEN 0.1 AND 0.9, ctx >= 0.5, cover >= 0.5]) AS ok FROM s)"""
)
def success_criteria(spark: SparkSession, folder: str) -> DataFrame:
    """Criteria with the verdict over all of them."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    s = read(spark, folder, "train").agg(F.count("*").alias("n"), share(F.col("context_sensitive")).alias("cs"), share(F.col("context_prev") != "").alias("ctx"), share(F.col("gold_in_nbest")).alias("cover"))
    tests = {"rows": F.col("n") >= 1000, "context_sensitive": F.col("cs").between(0.1, 0.9), "context": F.col("ctx") >= 0.5, "coverage": F.col("cover") >= 0.5}
    each = s.select(F.inline(F.array(*[F.struct(F.lit(k).alias("criterion"), v.alias("ok")) for k, v in tests.items()])))
    return each.withColumn("go", F.bool_and("ok").over(W.partitionBy(F.lit(1))))


@query(f"WITH {GROUPS_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE cands[1] = target) AS hit1, count(*) FILTER (WHERE list_contains(cands[1:3], target)) AS hit3, count(*) FILTER (WHERE list_contains(cands, target)) AS hit_any FROM g GROUP BY 1")
def benchmark_suites(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of every suite."""
    has = lambda k: F.count_if(F.array_contains(F.slice("cands", 1, k), F.col("target")))
    return groups(spark, folder).groupBy("source").agg(F.count("*").alias("n"), has(1).alias("hit1"), has(3).alias("hit3"), has(1 << 20).alias("hit_any"))


@query(f"{SWEPT_SQL}, c AS (SELECT tau, context <> '' AS with_context, count(*) AS n, count(*) FILTER (WHERE final_top1 = target) AS hits FROM f GROUP BY 1, 2) SELECT tau, max(n) FILTER (WHERE with_context) AS n_with, max(hits) FILTER (WHERE with_context) AS hits_with, max(n) FILTER (WHERE NOT with_context) AS n_blank, max(hits) FILTER (WHERE NOT with_context) AS hits_blank FROM c GROUP BY 1")
def context_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Hits with and without a context side by side."""
    s = gate.sweep(groups(spark, folder).withColumn("with_context", F.col("context") != ""), TAUS, groups=("with_context",))
    pick = lambda c, flag: F.max(F.when(F.col("with_context") == flag, F.col(c)))
    return s.groupBy("tau").agg(pick("n", True).alias("n_with"), pick("final_hit", True).alias("hits_with"), pick("n", False).alias("n_blank"), pick("final_hit", False).alias("hits_blank"))


SUBSET_SQL = "unnest(list_filter(['all', CASE WHEN sensitive THEN 'context_sensitive' ELSE 'non_context_sensitive' END, CASE WHEN ambiguous THEN 'ambiguous' ELSE 'non_ambiguous' END], lambda x: x IS NOT NULL))"


@query(
    f"""WITH {CS_SQL}, {COUNTS_SQL}, amb AS ({AMBIGUOUS_SQL}), {GROUPS_SQL}, {DECIDE_SQL}, w AS (SELECT *, coalesce(reading IN (SELECT reading FROM keys), false) AS sensitive, coalesce(reading IN (SELECT reading FROM amb), false) AS ambiguous,
    coalesce(rerank_top1 <> base AND margin >= 2.5, false) AS overwritten FROM d), f AS (SELECT *, CASE WHEN overwritten THEN rerank_top1 ELSE base END AS final_top1, {SUBSET_SQL} AS subset FROM w), {metrics_sql('f', 'subset')} SELECT * FROM metrics"""
)
def subset_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics by named subsets in one pass; a row is in several."""
    g = groups(spark, folder)
    for keys, flag in ((sensitive_keys(spark, folder), "sensitive"), (ambiguous_keys(spark, folder), "ambiguous")):
        g = salted_lookup(g, keys.select("reading", F.lit(True).alias(flag)), ["reading"], [F.col("grp")], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    names = F.array(F.lit("all"), F.when(F.col("sensitive"), "context_sensitive").otherwise("non_context_sensitive"), F.when(F.col("ambiguous"), "ambiguous").otherwise("non_ambiguous"))
    return gate.sweep(g.withColumn("subset", F.explode(names)), [2.5], groups=("subset",)).drop("tau")


_P = "round(quantile_cont(value, {0}), 6) AS p{1}"


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, {', '.join(_P.format(p / 100, p) for p in (50, 90, 95, 99))}, max(value) AS max, min(value) AS min FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Interpolated percentiles by type."""
    at = [F.round(F.percentile("value", p / 100), 6).alias(f"p{p}") for p in (50, 90, 95, 99)]
    return read(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), *at, F.max("value").alias("max"), F.min("value").alias("min"))


BUCKETS_SQL = "CASE WHEN k <= 25 THEN '01-25' WHEN k <= 50 THEN '26-50' WHEN k <= 75 THEN '51-75' ELSE '76+' END"
EVENTS_SQL = "x AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(f"WITH {EVENTS_SQL} SELECT {BUCKETS_SQL} AS bucket, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM x GROUP BY 1")
def latency_by_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Values by buckets of a count."""
    k = F.col("k")
    bucket = F.when(k <= 25, "01-25").when(k <= 50, "26-50").when(k <= 75, "51-75").otherwise("76+")
    return _events(spark, folder).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"))


@query("WITH s AS (SELECT list(value ORDER BY value) AS v, count(*) AS n FROM events) SELECT v[(round_even(0.95 * (n - 1), 0) + 1)::BIGINT] AS value FROM s")
def nearest_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest-rank 95th percentile."""
    return stats.value_at(read(spark, folder, "events"), "value", F.bround(F.lit(0.95) * (F.col("n") - 1), 0), 8.0)


@query("WITH s AS (SELECT list(value ORDER BY value) AS v, count(*) AS n FROM events) SELECT v[n // 2 + 1] AS value FROM s")
def upper_median(spark: SparkSession, folder: str) -> DataFrame:
    """The upper median."""
    return stats.value_at(read(spark, folder, "events"), "value", F.floor(F.col("n") / 2), 8.0)


@query(f"WITH {EVENTS_SQL} SELECT round(corr(k, value), 6) AS pearson FROM x")
def pearson(spark: SparkSession, folder: str) -> DataFrame:
    """Linear correlation."""
    return _events(spark, folder).agg(F.round(F.corr("k", "value"), 6).alias("pearson"))


@query(f"WITH {EVENTS_SQL}, r AS (SELECT rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS b FROM x) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation with mean ranks for ties."""
    return stats.spearman(_events(spark, folder), "event_id", "k", "value", 8.0).select(F.round("spearman", 6).alias("spearman"))


@query("SELECT count(*) AS n, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(d), 6) AS mean_diff, round(max(abs(d)), 6) AS max_abs, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(stddev_pop(x), 6) AS std_x, round(stddev_pop(y), 6) AS std_y, round(corr(x, y), 6) AS pearson FROM (SELECT scores[1] AS x, scores[2] AS y, scores[1] - scores[2] AS d FROM rerank_smoke WHERE len(scores) > 1)")
def pair_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Differences between two scorers' columns."""
    return stats.pair_stats(read(spark, folder, "rerank_smoke").filter("size(scores) > 1").select(F.get("scores", F.lit(0)).alias("x"), F.get("scores", F.lit(1)).alias("y")), "x", "y")


_RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
_PARITY_SQL = f"""WITH s AS (SELECT scores[1] AS x, scores[2] AS y, scores[3] AS z FROM rerank_smoke WHERE len(scores) > 2), r AS (SELECT *, {_RANKS.format('x')} AS rx, {_RANKS.format('y')} AS ry, {_RANKS.format('z')} AS rz FROM s),
    c AS (SELECT round(avg(abs(x - y)), 6) AS mae, round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - z)), 6) AS mae_small, round(corr(rx, rz), 6) AS spearman_small, round(stddev_pop(z) / greatest(1e-8, stddev_pop(x)), 6) AS scale FROM r)
    SELECT *, CASE WHEN mae > 0.05 OR coalesce(spearman < 0.99, false) THEN 'export' WHEN mae_small > 0.2 OR coalesce(spearman_small < 0.95, false) THEN 'int8_quantization' WHEN abs(scale - 1) > 0.25 THEN 'tau_scale' ELSE 'tau_scale_or_minor_quant' END AS cause FROM c"""


@query(_PARITY_SQL)
def parity_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """Where scores of three backends part: the export, the quantisation, or only the scale; from rank correlations and mean differences."""
    s = read(spark, folder, "rerank_smoke").filter("size(scores) > 2").select("log_id", *[F.get("scores", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
    r = lambda c, name: F.round(c, 6).alias(name)
    one = s.agg(r(F.avg(F.abs(F.col("x") - F.col("y"))), "mae"), r(F.avg(F.abs(F.col("x") - F.col("z"))), "mae_small"), r(F.stddev_pop("z") / F.greatest(F.lit(1e-8), F.stddev_pop("x")), "scale")).withColumn("one", F.lit(1))
    for other, name in (("y", "spearman"), ("z", "spearman_small")):
        one = one.join(stats.spearman(s, "log_id", "x", other).select(F.lit(1).alias("one"), r(F.col("spearman"), name)), "one")  # tables of one row
    low = lambda c, least: F.coalesce(F.nanvl(F.col(c), F.lit(1.0)) < least, F.lit(False))
    cause = F.when((F.col("mae") > 0.05) | low("spearman", 0.99), "export").when((F.col("mae_small") > 0.2) | low("spearman_small", 0.95), "int8_quantization").when(F.abs(F.col("scale") - 1) > 0.25, "tau_scale").otherwise("tau_scale_or_minor_quant")
    return one.select("mae", "spearman", "mae_small", "spearman_small", "scale", cause.alias("cause"))


@query(f"{SWEPT_SQL} SELECT tau, count(*) AS n, round((list(margin ORDER BY margin))[count(*) // 2 + 1], 4) AS margin_p50 FROM f WHERE overwritten AND margin IS NOT NULL GROUP BY 1")
def overwrite_margins(spark: SparkSession, folder: str) -> DataFrame:
    """The upper median of the margins of overwritten groups at each threshold."""
    d = gate.decide(groups(spark, folder).withColumn("tau", F.explode(F.array(*map(F.lit, TAUS)))), F.col("tau")).filter("overwritten")
    return stats.upper_median_by(d.select("tau", "margin"), ["tau"], "margin", 0.5).select("tau", "n", F.round("margin", 4).alias("margin_p50"))


@query("SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= (SELECT greatest(1, count(*) // 20) FROM events)")
def slowest_p5(spark: SparkSession, folder: str) -> DataFrame:
    """The slowest twentieth of the events; a top-k whose size follows the table, so it is cut by value, not sorted in one task."""
    e = read(spark, folder, "events").select("event_id", "value").filter("value IS NOT NULL")
    k = max(1, read(spark, folder, "events").count() // 20)
    counts = e.groupBy("value").agg(F.count("*").alias("n")).withColumn("block", -F.floor(F.col("value") / 8).cast("bigint"))
    from rankloom.operators.prefix import running_total

    before = running_total(counts, [], "block", [F.desc("value")], "n", "before").filter(F.col("before") < k).select("value", "before")
    inside = F.row_number().over(W.partitionBy("value").orderBy("event_id"))
    return e.join(before, "value").withColumn("r", F.col("before") + inside).filter(F.col("r") <= k).select("event_id", "value")


#: Expected values of a report and how far each metric may be off.
EXPECTED = [("base_hit1", 0.30, 0.005), ("final_hit1", 0.35, 0.005), ("delta_pt", 5.0, 0.8), ("regression_rate", 0.05, 0.005)]
_EXPECTED_SQL = ", ".join(f"('{name}', {value}, {tolerance})" for name, value, tolerance in EXPECTED)


@query(f"{SWEPT_SQL}, l AS (UNPIVOT (SELECT tau, base_hit1, final_hit1, delta_pt, regression_rate FROM metrics) ON base_hit1, final_hit1, delta_pt, regression_rate INTO NAME metric VALUE actual) SELECT tau, metric, actual, expected::DOUBLE AS expected, abs(actual - expected::DOUBLE) <= tolerance::DOUBLE AS within FROM l JOIN (VALUES {_EXPECTED_SQL}) e(metric, expected, tolerance) USING (metric)")
def report_join(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of a sweep beside expected values, each with a tolerance of its own."""
    expected = spark.createDataFrame(EXPECTED, "metric string, expected double, tolerance double")
    names = [x for x, *_ in EXPECTED]
    flat = gate.sweep(groups(spark, folder), TAUS).select("tau", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("actual")) for c in names])))
    return flat.join(F.broadcast(expected), "metric").select("tau", "metric", "actual", "expected", (F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance")).alias("within"))  # a row for each metric


# Configurations are the types of events: their values as recorded latencies, hits by a field of theirs.
CONFIG_SQL = "c AS (SELECT event_type AS config, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, round(avg((CAST(json_extract_string(props, '$.k') AS INTEGER) <= 50)::INTEGER), 6) AS hit, round(avg((CAST(json_extract_string(props, '$.k') AS INTEGER) > 98)::INTEGER), 6) AS regression FROM events GROUP BY 1)"


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    """(config, p50, p95, hit, regression): one row for each recorded configuration."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, folder, "events").select(F.col("event_type").alias("config"), "value", k.alias("k"))
    return e.groupBy("config").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.round(F.avg((F.col("k") <= 50).cast("int")), 6).alias("hit"), F.round(F.avg((F.col("k") > 98).cast("int")), 6).alias("regression"))


@query(f"WITH {CONFIG_SQL} SELECT config, round(p95, 6) AS p95, hit FROM c ORDER BY p95 < 200 DESC, CASE WHEN p95 < 200 THEN hit END DESC NULLS LAST, p95, config LIMIT 1")
def pareto_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Among the configurations that are fast enough the best one, else the fastest; a choice of one row of a small table."""
    fast = F.col("p95") < 200
    return configurations(spark, folder).orderBy(F.desc(fast), F.desc_nulls_last(F.when(fast, F.col("hit"))), "p95", "config").limit(1).select("config", F.round("p95", 6).alias("p95"), "hit")


@query(f"WITH {CONFIG_SQL}, l AS (SELECT *, max(hit) OVER () AS best FROM c) SELECT config, round(p95, 6) AS p95, round(p50, 6) AS p50, hit, regression FROM l WHERE hit >= best - 0.01 AND regression <= 0.02 ORDER BY p95, p50, hit DESC, config LIMIT 1")
def latency_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The fastest configuration within one point of the best hits and two of regression; a choice of one row of a small table."""
    c = configurations(spark, folder).withColumn("best", F.max("hit").over(W.partitionBy(F.lit(1))))
    kept = c.filter("hit >= best - 0.01 AND regression <= 0.02").orderBy("p95", "p50", F.desc("hit"), "config").limit(1)
    return kept.select("config", F.round("p95", 6).alias("p95"), F.round("p50", 6).alias("p50"), "hit", "regression")
