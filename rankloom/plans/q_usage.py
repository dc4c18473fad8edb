"""Queries over the conversion log as usage outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import gate
from rankloom.operators.skew import salted_lookup
from rankloom.plans import sqltext as S
from rankloom.plans.q_candidates import DECIDE_SQL, GROUPS_SQL, TAU_SQL, TAUS, groups
from rankloom.plans.q_joins import ALLOW_SQL, skip_reason, skip_sql, with_eligible
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


def outcome(wanted: Column, shown: Column, baseline: Column, overwritten: Column) -> Column:
    """What became of a suggestion."""
    over = F.coalesce(overwritten, F.lit(False))
    return F.when(wanted == shown, F.when(over & (shown != baseline), "rerank_helped").otherwise("accepted_shown")).when(over & (wanted == baseline) & (shown != baseline), "rerank_rejected").otherwise("user_picked_other")


def noise() -> Column:
    """Rows that say nothing: empty, one letter that is no kana, short symbols, three digits or more."""
    r, c = F.coalesce("reading", F.lit("")), F.coalesce("chosen", F.lit(""))
    return (r == "") | (c == "") | ((F.length(r) <= 1) & ~r.rlike("^[぀-ヿ]")) | (r.rlike(r"^[ -~｡-､!-/:-@]+$") & (F.length(r) < 4)) | (F.length(F.regexp_replace(r, "[^0-9０-９]", "")) >= 3)


def artifact() -> Column:
    """Rows whose choice repeats the context."""
    ctx, c, shown = F.coalesce("context_prev", F.lit("")), F.coalesce("chosen", F.lit("")), F.coalesce("final_top1", F.lit(""))
    return (ctx != "") & ((c == ctx) | (c.startswith(ctx) & (shown != "") & (c != shown)))


U_SQL = "u AS (SELECT *, coalesce(nbest[1], '') AS baseline, coalesce(final_top1, nbest[1], '') AS shown, coalesce(chosen, '') AS wanted, coalesce(overwritten, false) AS ow FROM rerank_smoke)"
KIND_SQL = "CASE WHEN wanted = shown THEN CASE WHEN ow AND shown <> baseline THEN 'rerank_helped' ELSE 'accepted_shown' END WHEN ow AND wanted = baseline AND shown <> baseline THEN 'rerank_rejected' ELSE 'user_picked_other' END"


def usage(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit("")
    first = F.coalesce(F.get("nbest", F.lit(0)), none)
    return read(spark, folder, "rerank_smoke").withColumn("baseline", first).withColumn("shown", F.coalesce("final_top1", first)).withColumn("wanted", F.coalesce("chosen", none)).withColumn("ow", F.coalesce("overwritten", F.lit(False)))


def kind() -> Column:
    return outcome(F.col("wanted"), F.col("shown"), F.col("baseline"), F.col("ow"))


@query(f"WITH {U_SQL} SELECT {KIND_SQL} AS kind, source, count(*) AS n FROM u GROUP BY 1, 2")
def usage_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes by source."""
    return usage(spark, folder).groupBy(kind().alias("kind"), "source").agg(F.count("*").alias("n"))


@query(
    """SELECT log_id, r = '' OR c = '' OR (length(r) <= 1 AND NOT regexp_matches(r, '^[぀-ヿ]')) OR (regexp_full_match(r, '[ -~｡-､!-/:-@]+') AND length(r) < 4) OR length(regexp_replace(r, '[^0-9０-９]', '', 'g')) >= 3 AS noise,
    x <> '' AND (c = x OR (starts_with(c, x) AND f <> '' AND c <> f)) AS artifact FROM (SELECT log_id, coalesce(reading, '') AS r, coalesce(chosen, '') AS c, coalesce(context_prev, '') AS x, coalesce(final_top1, '') AS f FROM rerank_smoke)"""
)
def usage_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Noise and log artifacts."""
    return read(spark, folder, "rerank_smoke").select("log_id", noise().alias("noise"), artifact().alias("artifact"))


REPLAY_SQL = f"""WITH {ALLOW_SQL}, {U_SQL}, k AS (SELECT *, {S.context_key('reading')} AS r, {S.clean_context('context_prev')} AS c FROM u WHERE wanted <> ''), z AS (SELECT *, {skip_sql('true')} AS skip FROM k),
    p AS (SELECT *, unnest([false, true]) AS guarded FROM z), gated AS (SELECT *, CASE WHEN guarded THEN CASE WHEN skip IS NOT NULL THEN skip WHEN ow AND {S.junk('shown')} AND shown <> baseline THEN 'junk_candidate' END END AS reason FROM p),
    s AS (SELECT * REPLACE (CASE WHEN reason IS NULL THEN shown ELSE baseline END AS shown, ow AND reason IS NULL AS ow) FROM gated)"""


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    """The log's outcomes without guards and with them: (guarded, reason, baseline, shown, wanted, ow)."""
    u = usage(spark, folder).filter("wanted <> ''").select("log_id", "baseline", "shown", "wanted", "ow", T.context_key_norm(F.col("reading")).alias("r"), T.clean_context(F.col("context_prev")).alias("c"))
    u = with_eligible(spark, folder, u, "r", "log_id").withColumn("skip", skip_reason(F.col("r"), F.col("c"), F.col("eligible"), F.lit(True)))
    both = u.withColumn("guarded", F.explode(F.array(F.lit(False), F.lit(True))))
    junk = F.when(F.col("ow") & T.junk_surface(F.col("shown")) & (F.col("shown") != F.col("baseline")), "junk_candidate")
    s = both.withColumn("reason", F.when(F.col("guarded"), F.coalesce("skip", junk)))
    return s.withColumn("shown", F.when(F.col("reason").isNull(), F.col("shown")).otherwise(F.col("baseline"))).withColumn("ow", F.col("ow") & F.col("reason").isNull())


@query(
    f"""{REPLAY_SQL} SELECT guarded, count(*) AS n, round_even(count(*) FILTER (WHERE shown = wanted) * 100.0 / count(*), 1) AS shown_hit, round_even(count(*) FILTER (WHERE baseline = wanted) * 100.0 / count(*), 1) AS base_hit,
    round_even((count(*) FILTER (WHERE shown = wanted) - count(*) FILTER (WHERE baseline = wanted)) * 100.0 / count(*), 1) AS net_pt, count(*) FILTER (WHERE ow) AS overwrite, count(reason) AS guard_skip,
    count(*) FILTER (WHERE {KIND_SQL} = 'rerank_helped') AS helped, count(*) FILTER (WHERE {KIND_SQL} = 'rerank_rejected') AS hurt FROM s GROUP BY 1"""
)
def usage_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded decisions with and without guards: a skipped request, or a junk overwrite, shows the baseline."""
    pct = lambda c: F.bround(c * 100.0 / F.count("*"), 1)
    hit, base = F.count_if(F.col("shown") == F.col("wanted")), F.count_if(F.col("baseline") == F.col("wanted"))
    return replayed(spark, folder).groupBy("guarded").agg(
        F.count("*").alias("n"), pct(hit).alias("shown_hit"), pct(base).alias("base_hit"), pct(hit - base).alias("net_pt"), F.count_if("ow").alias("overwrite"), F.count("reason").alias("guard_skip"),
        F.count_if(kind() == "rerank_helped").alias("helped"), F.count_if(kind() == "rerank_rejected").alias("hurt"),
    )


@query(f"{REPLAY_SQL} SELECT guarded, {KIND_SQL} AS kind, reason, count(*) AS n FROM s GROUP BY ALL")
def usage_replay_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Replayed outcomes by kind and by the reason of the guard."""
    return replayed(spark, folder).groupBy("guarded", kind().alias("kind"), "reason").agg(F.count("*").alias("n"))


POLICIES = ("none", "safety", "strict")
POLICY_SQL = f"""WITH {ALLOW_SQL}, {GROUPS_SQL}, {DECIDE_SQL}, k AS (SELECT *, {S.context_key('reading')} AS r, {S.clean_context('context')} AS c FROM d),
    z AS (SELECT *, {skip_sql('false')} AS safe_skip, {skip_sql('true')} AS strict_skip, coalesce(r IN (SELECT {S.context_key('reading')} FROM train WHERE reading IS NOT NULL), false) AS overlap FROM k),
    p AS (SELECT z.*, tau, policy, CASE policy WHEN 'safety' THEN safe_skip WHEN 'strict' THEN strict_skip END AS skip FROM z, {TAU_SQL}, (SELECT unnest(['none', 'safety', 'strict']) AS policy)),
    gated AS (SELECT *, skip IS NULL AND coalesce(rerank_top1 <> base AND margin >= tau, false) AS wins FROM p),
    o AS (SELECT *, CASE WHEN skip IS NOT NULL THEN skip WHEN policy <> 'none' AND wins AND {S.junk('rerank_top1')} THEN 'junk_candidate' END AS reason FROM gated),
    f AS (SELECT *, CASE WHEN wins AND reason IS NULL THEN rerank_top1 ELSE base END AS final_top1 FROM o)"""


def policy_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every group under each policy and threshold; skip reasons and the overlap with training are found once for a group."""
    g = groups(spark, folder).withColumn("r", T.context_key_norm(F.col("reading"))).withColumn("c", T.clean_context(F.col("context")))
    g = with_eligible(spark, folder, g, "r", "grp")
    seen = read(spark, folder, "train").filter("reading IS NOT NULL").select(T.context_key_norm(F.col("reading")).alias("r")).distinct().withColumn("known", F.lit(True))
    g = salted_lookup(g, seen, ["r"], [F.col("grp")], "left").withColumn("overlap", F.coalesce("known", F.lit(False)))
    g = g.withColumn("safe", skip_reason(F.col("r"), F.col("c"), F.col("eligible"), F.lit(False))).withColumn("strict", skip_reason(F.col("r"), F.col("c"), F.col("eligible"), F.lit(True)))
    g = gate.decide(g, F.lit(0.0)).withColumn("junk", T.junk_surface(F.col("rerank_top1"))).select("grp", "base", "target", "rerank_top1", "margin", "junk", "safe", "strict", "overlap")
    each = gate.at_each(g.withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES)))), TAUS)
    d = each.withColumn("skip", F.when(F.col("policy") == "safety", F.col("safe")).when(F.col("policy") == "strict", F.col("strict"))).withColumn("wins", F.col("skip").isNull() & F.col("overwritten"))
    d = d.withColumn("reason", F.coalesce("skip", F.when((F.col("policy") != "none") & F.col("wins") & F.col("junk"), "junk_candidate")))
    return d.withColumn("final_top1", F.when(F.col("wins") & F.col("reason").isNull(), F.col("rerank_top1")).otherwise(F.col("base")))


@query(
    f"""{POLICY_SQL}, m AS (SELECT policy, tau, count(*) AS n, round_even(count(*) FILTER (WHERE base = target) / count(*), 6) AS base_hit1, round_even(count(*) FILTER (WHERE final_top1 = target) / count(*), 6) AS final_hit1, count(*) FILTER (WHERE final_top1 <> base) AS overwrite,
    count(*) FILTER (WHERE base <> target AND final_top1 = target) AS helped, count(*) FILTER (WHERE base = target AND final_top1 <> target) AS hurt, count(reason) AS skipped,
    count(*) FILTER (WHERE overlap) AS overlap_n, round_even(count(*) FILTER (WHERE overlap AND final_top1 = target) / nullif(count(*) FILTER (WHERE overlap), 0), 6) AS overlap_hit1,
    count(*) FILTER (WHERE NOT overlap) AS unseen_n, round_even(count(*) FILTER (WHERE NOT overlap AND final_top1 = target) / nullif(count(*) FILTER (WHERE NOT overlap), 0), 6) AS unseen_hit1 FROM f GROUP BY 1, 2)
    SELECT *, round_even((final_hit1 - base_hit1) * 100, 3) AS net_pt FROM m"""
)
def sweep_policy_cross(spark: SparkSession, folder: str) -> DataFrame:
    """Policies times thresholds over the same groups: hits, help and harm, skips, and hits by whether training knows the key."""
    d = policy_decisions(spark, folder)
    b, t, f, over = F.col("base"), F.col("target"), F.col("final_top1"), F.col("overlap")
    share = lambda c, n: F.bround(F.count_if(c) / F.nullif(n, F.lit(0)), 6)
    m = d.groupBy("policy", "tau").agg(
        F.count("*").alias("n"), share(b == t, F.count("*")).alias("base_hit1"), share(f == t, F.count("*")).alias("final_hit1"), F.count_if(f != b).alias("overwrite"),
        F.count_if((b != t) & (f == t)).alias("helped"), F.count_if((b == t) & (f != t)).alias("hurt"), F.count("reason").alias("skipped"),
        F.count_if(over).alias("overlap_n"), share(over & (f == t), F.count_if(over)).alias("overlap_hit1"), F.count_if(~over).alias("unseen_n"), share(~over & (f == t), F.count_if(~over)).alias("unseen_hit1"),
    )
    return m.withColumn("net_pt", F.bround((F.col("final_hit1") - F.col("base_hit1")) * 100, 3))


@query(f"{POLICY_SQL} SELECT policy, tau, reason, count(*) AS n FROM f WHERE reason IS NOT NULL GROUP BY ALL")
def policy_skip_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why groups are skipped under each policy and threshold."""
    return policy_decisions(spark, folder).filter("reason IS NOT NULL").groupBy("policy", "tau", "reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {U_SQL}, k AS (SELECT *, reading IN (SELECT reading FROM train WHERE reading IS NOT NULL) AS known FROM u WHERE wanted <> '')
    SELECT coalesce(known, false) AS overlap, count(*) AS n, count(*) FILTER (WHERE shown = wanted) AS hits, count(*) FILTER (WHERE {KIND_SQL} = 'rerank_helped') AS helped, count(*) FILTER (WHERE {KIND_SQL} = 'rerank_rejected') AS hurt FROM k GROUP BY 1"""
)
def usage_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes by whether training knows the reading."""
    seen = read(spark, folder, "train").filter("reading IS NOT NULL").select("reading").distinct().withColumn("known", F.lit(True))
    k = salted_lookup(usage(spark, folder).filter("wanted <> ''"), seen, ["reading"], [F.col("log_id")], "left")
    return k.groupBy(F.coalesce("known", F.lit(False)).alias("overlap")).agg(
        F.count("*").alias("n"), F.count_if(F.col("shown") == F.col("wanted")).alias("hits"), F.count_if(kind() == "rerank_helped").alias("helped"), F.count_if(kind() == "rerank_rejected").alias("hurt")
    )


@query(f"WITH {U_SQL} SELECT session_id, count(*) AS n, count(DISTINCT reading) AS readings, count(*) FILTER (WHERE ow) AS overwritten, epoch_us(min(received_at)) AS first_us, epoch_us(max(received_at)) AS last_us FROM u GROUP BY 1")
def session_report(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with their size, keys and span."""
    return usage(spark, folder).groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("reading").alias("readings"), F.count_if("ow").alias("overwritten"), F.unix_micros(F.min("received_at")).alias("first_us"), F.unix_micros(F.max("received_at")).alias("last_us"))


@query(
    """WITH e AS (SELECT user_id, list(event_type = 'error' ORDER BY event_id) AS xs FROM events GROUP BY 1)
    SELECT user_id, len(list_filter(xs, lambda x: x))::INTEGER AS timeouts, len(xs)::INTEGER AS n FROM e"""
)
def timeout_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Timeouts of each client."""
    return read(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").cast("int").alias("timeouts"), F.count("*").cast("int").alias("n"))


@query("SELECT event_id, CASE WHEN value > 200 THEN 'baseline' ELSE 'scored' END AS served FROM events")
def deadline_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that took longer than the deadline are served the baseline order."""
    return read(spark, folder, "events").select("event_id", F.when(F.col("value") > 200, "baseline").otherwise("scored").alias("served"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows, the batch form of the streaming query."""
    return read(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user with gaps of half an hour, an addition to the reference's operators."""
    w = F.session_window("ts", "30 minutes")
    return read(spark, folder, "events").groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
