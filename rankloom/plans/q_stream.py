"""Queries over sources, sinks, streams and functions outside of SQL."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import scoring
from rankloom.operators import candidates as C
from rankloom.operators import chain, gate
from rankloom.plans import sqltext as S
from rankloom.plans.q_candidates import GROUPS_SQL, groups
from rankloom.plans.q_joins import ALLOW_SQL, skip_reason, skip_sql, with_eligible
from rankloom.session import ensure_checkpoint_dir
from rankloom.session import read_table as read
from rankloom.sources import json_lines, tab_separated
from rankloom.streaming import ladder, runs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream; event time must carry a zone, the table's times are UTC without one."""
    return runs.stream_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT log_id, ts, reading, chosen, len(nbest)::INTEGER AS n FROM rerank_smoke")
def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The conversion log through a JSON Lines sink and the strict scan."""
    path = _place(spark)
    json_lines.write_sorted(read(spark, folder, "rerank_smoke"), path)
    back = json_lines.read_strict(spark, path, f"log_id bigint, {json_lines.LOG}")
    return back.select("log_id", "ts", "reading", "chosen", F.size("nbest").alias("n"))


@query("SELECT c_custkey::VARCHAR AS key, array_to_string([c_name, c_mktsegment][1:1 + c_custkey % 2], '|') AS candidates FROM customer")
def ragged_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate lists of different lengths through text files."""
    path = _place(spark)
    parts = F.slice(F.array("c_name", "c_mktsegment"), F.lit(1), (1 + F.col("c_custkey") % 2).cast("int"))
    read(spark, folder, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), parts).alias("value")).write.text(path)
    return tab_separated.read_candidates(spark, path).select("key", F.array_join("candidates", "|").alias("candidates"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS title FROM nation")
def xml_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Rows through an XML sink and scan."""
    path = _place(spark)
    read(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("title")).write.option("rowTag", "doc").option("rootTag", "docs").xml(path)
    return spark.read.schema("id bigint, title string").option("rowTag", "doc").xml(path)


def score_sql(reading: str, candidate: str) -> str:
    """The score of ``scoring.overlap_scorer`` for a reading and a candidate."""
    chars = lambda x: f"list_distinct(string_split({x}, ''))"
    a, b = f"('読み: ' || coalesce({reading}, ''))", f"('候補: ' || coalesce({candidate}, ''))"
    return f"(len(list_intersect({chars(b)}, {chars(a)})) - length({b}) / 100.0)::DOUBLE"


SCORED_SQL = f"""raw AS (SELECT *, generate_subscripts(cands, 1) AS i, unnest(cands) AS cand FROM g), each AS (SELECT *, {score_sql('reading', 'cand')} AS s FROM raw),
    b AS (SELECT grp, any_value(base) AS base, any_value(cands) AS cands, arg_max(i, (s, -i))::INTEGER AS rerank_index, max(s) - arg_min(s, CASE WHEN cand = base THEN i ELSE 1000000 + i END) AS margin FROM each GROUP BY 1)"""


@query(f"WITH {GROUPS_SQL}, {SCORED_SQL}, d AS (SELECT grp, base, cands[rerank_index] AS rerank_top1, round(margin, 6) AS margin, cands[rerank_index] <> base AND margin >= 0.5 AS overwritten FROM b) SELECT grp, rerank_top1, margin, overwritten, CASE WHEN overwritten THEN rerank_top1 ELSE base END AS final_top1 FROM d")
def scorer_udf(spark: SparkSession, folder: str) -> DataFrame:
    """Every group scored by an Arrow UDF, then decided."""
    g = groups(spark, folder).select("grp", "reading", "context", "cands", "base", "target")
    scored = g.withColumn("scores", scoring.score_udf(scoring.overlap_scorer)(scoring.pair_texts(F.col("reading"), F.col("context"), F.col("cands"))))
    return gate.decide(scored, F.lit(0.5)).select("grp", "rerank_top1", F.round("margin", 6).alias("margin"), "overwritten", "final_top1")


TAU, CAP = 0.5, 30
CHAIN_SQL = f"""WITH {ALLOW_SQL}, n AS (SELECT log_id, {S.context_key('reading')} AS r, {S.clean_context('context_prev')} AS c, list_filter(coalesce(nbest, []), lambda x: x <> '')[1:{CAP}] AS cands FROM rerank_smoke),
    f AS (SELECT *, cands[1] AS base, CASE WHEN coalesce(r, '') = '' THEN 'reading required' WHEN len(cands) = 0 THEN 'nbest required' END AS fault, {skip_sql('true')} AS guard FROM n), w AS (SELECT *, coalesce(fault, guard) AS stop FROM f),
    raw AS (SELECT *, generate_subscripts(cands, 1) AS i, unnest(cands) AS cand FROM w WHERE stop IS NULL), each AS (SELECT *, {score_sql('r', 'cand')} AS s FROM raw),
    b AS (SELECT log_id, arg_max(cand, (s, -i)) AS best, round(max(s) - arg_min(s, CASE WHEN cand = base THEN i ELSE 1000000 + i END), 6) AS margin, list(cand ORDER BY s DESC, i) AS order_ FROM each GROUP BY 1),
    d AS (SELECT w.*, best, margin, order_, coalesce(best <> base AND margin >= {TAU}, false) AS over FROM w LEFT JOIN b USING (log_id)), e AS (SELECT *, over AND {S.junk('best')} AS junk FROM d), k AS (SELECT *, CASE WHEN over AND NOT junk THEN best ELSE base END AS final FROM e)
    SELECT log_id, base, CASE WHEN fault IS NULL THEN coalesce(best, base) END AS rerank_top1, CASE WHEN fault IS NULL THEN final END AS final_top1, over AND NOT junk AS overwritten, margin,
    CASE WHEN stop IS NOT NULL THEN stop WHEN junk THEN 'junk_candidate' WHEN best = base THEN 'same_top1' WHEN over THEN 'overwrite' ELSE 'below_tau' END AS reason, stop IS NOT NULL AS guard_skip,
    CASE WHEN fault IS NOT NULL THEN NULL WHEN stop IS NOT NULL THEN array_to_string(cands, '|') ELSE array_to_string(list_concat([final], list_filter(order_, lambda x: x <> final)), '|') END AS ranked FROM k"""


def _decided(spark: SparkSession, folder: str, log: DataFrame) -> DataFrame:
    n = chain.normalised(log.select("log_id", "reading", "context_prev", "nbest"), "reading", "context_prev", "nbest", CAP)
    n = with_eligible(spark, folder, n, "r", "log_id")
    d = chain.answer(n, skip_reason(F.col("r"), F.col("c"), F.col("eligible"), F.lit(True)), scoring.overlap_scorer, TAU)
    return d.select("log_id", "base", "rerank_top1", "final_top1", "overwritten", F.round("margin", 6).alias("margin"), "reason", "guard_skip", F.array_join("ranked", "|").alias("ranked"))


@query(CHAIN_SQL)
def decide_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The whole decision of every logged request."""
    return _decided(spark, folder, read(spark, folder, "rerank_smoke"))


@query(CHAIN_SQL)
def stream_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The same chain over the log as a stream, with the allow-list as a table beside it."""
    return runs.run_once(_decided(spark, folder, runs.stream_table(spark, folder, "rerank_smoke")))


@query("SELECT DISTINCT o_orderpriority AS key, o_orderpriority AS candidates FROM orders")
def external_pipe(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct keys through an external program."""
    keys = read(spark, folder, "orders").select("o_orderpriority").distinct()
    program = "import sys\nfor x in sys.stdin:\n    x = x.rstrip('\\n')\n    print(x, x, sep='\\t')"
    return scoring.convert_external(keys, "o_orderpriority", [sys.executable, "-c", program]).select("key", F.array_join("candidates", "|").alias("candidates"))


_T, _B = 1_000_000_000_000, 1_000_000  # a state is tier x _T + timeouts in a row x _B + successes in a row
_TIER, _BAD, _GOOD = f"(a // {_T})", f"((a % {_T}) // {_B})", f"(a % {_B})"
LADDER_SQL = f"""list_reduce(xs, lambda a, x: CASE WHEN x = 1
    THEN CASE WHEN {_BAD} + 1 >= {ladder.STEP} AND {_TIER} < {ladder.TOP} THEN ({_TIER} + 1) * {_T} ELSE {_TIER} * {_T} + ({_BAD} + 1) * {_B} END
    ELSE CASE WHEN {_GOOD} + 1 >= {ladder.STEP} AND {_TIER} > 0 THEN ({_TIER} - 1) * {_T} ELSE {_TIER} * {_T} + {_GOOD} + 1 END END, 0::BIGINT)"""


def _ladder_sql(order: str, columns: str) -> str:
    return f"WITH e AS (SELECT user_id, list((value > 20)::BIGINT ORDER BY {order}) AS xs FROM events GROUP BY 1), s AS (SELECT user_id, {LADDER_SQL} AS a FROM e), t AS (SELECT user_id, {_TIER}::INTEGER AS tier, {_BAD}::INTEGER AS bad, {_GOOD}::INTEGER AS good FROM s) SELECT {columns} FROM t"


@query(_ladder_sql("ts, event_id", f"* REPLACE (least(bad, {ladder.STEP}) AS bad, least(good, {ladder.STEP}) AS good), CASE WHEN tier >= 1 THEN 15 ELSE 30 END AS cand_cap, CASE WHEN tier >= 3 THEN 0 WHEN tier >= 2 THEN 20 ELSE 50 END AS context_chars, tier >= 4 AS off"))
def degrade_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """The tier of each client after its outcomes; slow events count as timeouts."""
    t = ladder.tiers(read(spark, folder, "events"), "user_id", ["ts", "event_id"], F.col("value") > 20, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)))
    return t.select("user_id", "tier", "bad", "good", *ladder.limits(F.col("tier"), F.lit(30), F.lit(50)))


@query(_ladder_sql("event_id", "user_id, tier"))
def degrade_ladder_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream with state by client."""
    events = runs.stream_table(spark, folder, "events").select("user_id", "event_id", (F.col("value") > 20).alias("timeout"))
    return runs.run_once(ladder.tier_stream(events, "user_id", "event_id"), "update", ["user_id"])


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_window(spark: SparkSession, folder: str) -> DataFrame:
    """Daily windows of the event stream that the watermark has closed."""
    events = _events(spark, folder)
    out = runs.run_once(runs.windows(events, "ts", ["event_type"], "1 day", "1 hour", ("total", F.round(F.sum("value"), 4))))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def stream_session(spark: SparkSession, folder: str) -> DataFrame:
    """Closed sessions of the event stream."""
    out = runs.run_once(runs.sessions(_events(spark, folder), "ts", "user_id", "30 minutes", "1 hour"))
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """First-seen pairs of the event stream."""
    events = _events(spark, folder).withWatermark("ts", "60 days").select("ts", "user_id", "event_type")
    return runs.run_once(events.dropDuplicatesWithinWatermark(["user_id", "event_type"])).select("user_id", "event_type")


@query("SELECT nbest[list_position(scores, list_max(scores))] AS response, count(*) AS n FROM rerank_smoke WHERE len(scores) = len(nbest) AND len(nbest) > 0 GROUP BY 1")
def stream_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Request lines in, one answer for each out: the top candidate of every scored request."""
    log = runs.stream_table(spark, folder, "rerank_smoke").filter("size(scores) = size(nbest) AND size(nbest) > 0")
    lines = log.select(F.to_json(F.struct("reading", "nbest", "scores")).alias("value"))

    def answer(requests: DataFrame) -> DataFrame:
        return requests.withColumn("response", F.try_element_at("nbest", C.best_index(F.col("scores"))))

    out = runs.run_once(runs.answer_requests(lines, "reading string, nbest array<string>, scores array<double>", answer))
    return out.groupBy("response").agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM (SELECT event_id, value, sum(value) OVER (ORDER BY event_id) AS s FROM events WHERE event_type <> 'error') WHERE s <= 2000 - 100")
def budgeted_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The next wave of a resumed, budgeted run."""
    e = read(spark, folder, "events").select("event_id", "event_type", "value")
    return runs.budgeted(e.select("event_id", "value"), e.filter("event_type = 'error'").select("event_id"), "event_id", "value", "event_id", 100.0, 2000.0)
