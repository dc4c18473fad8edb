"""Queries over assembly, correlation of requests and outcomes, and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import candidates as C
from rankloom.operators import dedup as D
from rankloom.operators.places import with_previous
from rankloom.operators import gate
from rankloom.plans.q_candidates import DECIDE_SQL, DUAL_SQL, GROUPS_SQL, NATIVE, TAU_NATIVE, groups, margin_dual_tau, metrics_sql
from rankloom.plans.q_joins import EXTRA_SQL, injected
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
    f"""WITH {EXTRA_SQL}, counted AS (SELECT r.row_id, coalesce(len(mozc_nbest), 0) AS native, count(i.row_id) AS extras FROM r LEFT JOIN i USING (row_id) GROUP BY r.row_id, mozc_nbest)
    SELECT row_id, least(native, 5)::INTEGER AS native_kept, least(extras, 5 - least(native, 5))::INTEGER AS injected_kept FROM counted"""
)
def cap_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """How many native and injected candidates a cap of five keeps; natives come first."""
    extras = injected(spark, folder).groupBy("row_id").agg(F.count("*").alias("extras"))
    rows = read(spark, folder, "holdout").select("row_id", F.coalesce(F.greatest(F.size("mozc_nbest"), F.lit(0)), F.lit(0)).alias("native")).join(extras, "row_id", "left")
    native = F.least("native", F.lit(5))
    return rows.select("row_id", native.alias("native_kept"), F.least(F.coalesce("extras", F.lit(0)), F.lit(5) - native).cast("int").alias("injected_kept"))


@query(
    """WITH e AS (SELECT log_id, chosen, unnest(nbest) AS c, generate_subscripts(nbest, 1) AS i FROM rerank_smoke), d AS (SELECT log_id, c, min(i) AS i FROM e WHERE c <> '' GROUP BY 1, 2), t AS (SELECT log_id, c, row_number() OVER (PARTITION BY log_id ORDER BY i) AS k FROM d)
    SELECT log_id, reading, chosen FROM rerank_smoke r WHERE length(reading) >= 2 AND regexp_matches(chosen, '[一-鿿]') AND NOT EXISTS (SELECT 1 FROM t WHERE t.log_id = r.log_id AND k <= 2 AND c = chosen) AND length(coalesce(context_prev, '')) <= 40"""
)
def review_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes that make training examples: a key, a target with an ideograph outside of the first two candidates, a short context."""
    log = read(spark, folder, "rerank_smoke").filter((F.length("reading") >= 2) & T.has_kanji(F.col("chosen")) & (F.length(F.coalesce("context_prev", F.lit(""))) <= 40))
    return log.filter(~C.hit_at(F.col("chosen"), C.dedupe(F.col("nbest")), 2)).select("log_id", "reading", "chosen")


_NO_INJECT_SQL = DECIDE_SQL.replace("FROM g)", f"FROM (SELECT * REPLACE (cands[1:{NATIVE}] AS cands, scores[1:{NATIVE}] AS scores) FROM g))")
_RECOMMEND_SQL = f"""{DUAL_SQL}, plain AS (WITH {_NO_INJECT_SQL}, o AS (SELECT *, coalesce(rerank_top1 <> base AND margin >= {TAU_NATIVE}, false) AS overwritten FROM d), f AS (SELECT 0 AS tau, *, CASE WHEN overwritten THEN rerank_top1 ELSE base END AS final_top1 FROM o), {metrics_sql('f')} SELECT final_hit1 AS base_hit1, regression_rate AS base_reg FROM metrics),
    l AS (SELECT dual.* EXCLUDE (base_hit1), plain.*, regression_rate <= greatest(0.025, base_reg + 0.005) AS kept FROM dual, plain),
    best AS (SELECT * FROM l ORDER BY kept DESC, final_hit1 DESC, regression_rate, tau LIMIT 1)
    SELECT tau, kept AS limit_met, final_hit1, regression_rate, round_even((final_hit1 - base_hit1) * 100, 3) AS delta_pt_vs_plain, round_even((regression_rate - base_reg) * 100, 3) AS delta_regress_pt_vs_plain, b_recovery_rate,
    CASE WHEN b_n > 0 THEN round_even(b_covered / b_n, 6) ELSE 0.0 END AS rescue_rate,
    (CASE WHEN b_n > 0 THEN round_even(b_covered / b_n, 6) ELSE 0.0 END) >= 0.15 AND regression_rate <= 0.025 AND (round_even((final_hit1 - base_hit1) * 100, 3) >= 0 OR b_recovery_rate >= 0.01) AND hit_subset_final_hit1 >= 0.97 AS ship FROM best"""


@query(_RECOMMEND_SQL)
def inject_recommend(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold of injected candidates with the most hits among those whose regression stays near the one without injection (all of them if none does), and whether it is good enough; a choice of one row of a small sweep."""
    g = groups(spark, folder)
    plain = gate.sweep(g.withColumn("cands", F.slice("cands", 1, NATIVE)).withColumn("scores", F.slice("scores", 1, NATIVE)), [TAU_NATIVE]).select(F.lit(1).alias("one"), F.col("final_hit1").alias("base_hit1"), F.col("regression_rate").alias("base_reg"))
    l = margin_dual_tau(spark, folder).drop("base_hit1").withColumn("one", F.lit(1)).join(plain, "one").withColumn("limit_met", F.col("regression_rate") <= F.greatest(F.lit(0.025), F.col("base_reg") + 0.005))  # noqa: E741  a row for each threshold, and one
    best = l.orderBy(F.desc("limit_met"), F.desc("final_hit1"), "regression_rate", "tau").limit(1)
    rescue, gain = gate.rate(F.col("b_covered"), F.col("b_n")), F.bround((F.col("final_hit1") - F.col("base_hit1")) * 100, 3)
    ship = (rescue >= 0.15) & (F.col("regression_rate") <= 0.025) & ((gain >= 0) | (F.col("b_recovery_rate") >= 0.01)) & (F.col("hit_subset_final_hit1") >= 0.97)
    return best.select("tau", "limit_met", "final_hit1", "regression_rate", gain.alias("delta_pt_vs_plain"), F.bround((F.col("regression_rate") - F.col("base_reg")) * 100, 3).alias("delta_regress_pt_vs_plain"), "b_recovery_rate", rescue.alias("rescue_rate"), ship.alias("ship"))


_TAG = "CASE WHEN coalesce(mozc_hit1, false) THEN 'hit' WHEN coalesce(gold_in_nbest, false) THEN 'A' ELSE 'B' END"


@query(f"SELECT row_id, slice FROM (SELECT row_id, {_TAG} AS slice, row_number() OVER (PARTITION BY {_TAG} ORDER BY row_id) AS k FROM train) WHERE slice <> 'B' OR k <= 100")
def slice_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Only the unrecoverable slice is cut to its first hundred rows: a sampling operator."""
    hit, inside = F.coalesce("mozc_hit1", F.lit(False)), F.coalesce("gold_in_nbest", F.lit(False))
    rows = read(spark, folder, "train").select("row_id", F.when(hit, "hit").when(inside, "A").otherwise("B").alias("slice"))
    return rows.filter("slice <> 'B'").unionByName(D.cap_per_key(rows.filter("slice = 'B'"), ["slice"], ["row_id"], 100))


@query(
    """WITH e AS (SELECT row_id, gold, unnest(mozc_nbest) AS c FROM train WHERE gold <> '' AND gold_in_nbest), d AS (SELECT row_id, least(15, count(DISTINCT c)) AS negatives FROM e WHERE c <> '' AND c <> gold GROUP BY 1)
    SELECT count(*) AS groups, count(*) AS positives, coalesce(sum(negatives), 0)::BIGINT AS negatives FROM train t LEFT JOIN d USING (row_id) WHERE gold <> '' AND gold_in_nbest"""
)
def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many training pairs the groups would give."""
    rows = read(spark, folder, "train").filter("gold <> '' AND gold_in_nbest").select(F.size(C.negatives(F.col("gold"), F.col("mozc_nbest"))).alias("n"))
    return rows.agg(F.count("*").alias("groups"), F.count("*").alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"))


@query(
    """WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lag(event_id) OVER w AS pending FROM events WHERE event_type IN ('view', 'purchase', 'signup') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, pending AS pending_id, event_id AS finish_id FROM s WHERE event_type = 'purchase' AND before = 'view'"""
)
def pending_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Finished requests with the one that was pending: a view waits, a signup clears it, a purchase takes it."""
    e = read(spark, folder, "events").filter(F.col("event_type").isin("view", "purchase", "signup")).select("user_id", "event_id", "event_type")
    s = with_previous(e, "user_id", "event_id", {"before": ("event_type", 1), "pending_id": ("event_id", 1)})
    return s.filter("event_type = 'purchase' AND before = 'view'").select("user_id", "pending_id", F.col("event_id").alias("finish_id"))


@query(
    """SELECT log_id, CASE WHEN coalesce(context_prev, '') <> '' THEN context_prev ELSE coalesce(lag(nbest[1], 2) OVER w, '') || coalesce(lag(nbest[1]) OVER w, '') END AS history FROM rerank_smoke WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY log_id)"""
)
def request_history(spark: SparkSession, folder: str) -> DataFrame:
    """The context of a request: its own, else the first candidates of the two requests before it in the session."""
    none = F.lit("")
    log = read(spark, folder, "rerank_smoke").filter("session_id IS NOT NULL").select("log_id", "session_id", "context_prev", F.get("nbest", F.lit(0)).alias("first"))
    rows = with_previous(log, "session_id", "log_id", {"one": ("first", 1), "two": ("first", 2)})
    past = F.concat(F.coalesce("two", none), F.coalesce("one", none))
    return rows.select("log_id", F.when(F.coalesce("context_prev", none) != "", F.col("context_prev")).otherwise(past).alias("history"))


@query(f"WITH {GROUPS_SQL}, e AS (SELECT grp, unnest(scores) AS s, generate_subscripts(scores, 1) AS i FROM g) SELECT grp, count(*) AS n, round(sum(s * i), 6) AS weighted FROM e GROUP BY 1")
def zip_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Groups flattened to (group, place, score) and put together again by place."""
    flat = groups(spark, folder).select("grp", F.posexplode("scores").alias("i", "s"))
    return flat.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum(F.col("s") * (F.col("i") + 1)), 6).alias("weighted"))
