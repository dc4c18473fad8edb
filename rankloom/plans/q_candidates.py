"""Queries over candidate arrays and scored groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import candidates as C
from rankloom.operators import gate
from rankloom.plans import sqltext as S
from rankloom.session import read_table as read

QUERIES: dict = {}
SQL: dict[str, str] = {}
TAUS = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0]
TAU_SQL = "(SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0]::DOUBLE[]) AS tau)"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """Scored candidate groups of the conversion log: (grp, reading, source, cands, scores, base, target, context)."""
    log = read(spark, folder, "rerank_smoke").filter("size(nbest) > 0 AND size(scores) = size(nbest)")
    return log.select(F.col("log_id").alias("grp"), "reading", "source", F.col("nbest").alias("cands"), "scores", F.get("nbest", F.lit(0)).alias("base"), F.coalesce("chosen", F.lit("")).alias("target"), F.coalesce("context_prev", F.lit("")).alias("context"))


GROUPS_SQL = "g AS (SELECT log_id AS grp, reading, source, nbest AS cands, scores, nbest[1] AS base, coalesce(chosen, '') AS target, coalesce(context_prev, '') AS context FROM rerank_smoke WHERE len(nbest) > 0 AND len(scores) = len(nbest))"
DECIDE_SQL = """b AS (SELECT *, list_position(scores, list_max(scores))::INTEGER AS rerank_index FROM g),
    d AS (SELECT *, cands[rerank_index] AS rerank_top1, scores[rerank_index] AS score_rerank, scores[1] AS score_base, scores[rerank_index] - scores[1] AS margin FROM b)"""


def metrics_sql(source: str, keys: str = "tau") -> str:
    on = lambda c: f"count(*) FILTER (WHERE {c})"
    r = lambda a, b: f"CASE WHEN {b} > 0 THEN round_even({a} / {b}, 6) ELSE 0.0 END"
    return f"""s AS (SELECT {keys}, count(*) AS n, {on('base = target')} AS base_hit, {on('rerank_top1 = target')} AS raw_hit, {on('final_top1 = target')} AS final_hit,
        {on('base <> target AND final_top1 = target')} AS recover, {on('base = target AND final_top1 <> target')} AS regress, {on('overwritten')} AS overwrite FROM {source} GROUP BY ALL),
    m AS (SELECT *, {r('base_hit', 'n')} AS base_hit1, {r('raw_hit', 'n')} AS raw_hit1, {r('final_hit', 'n')} AS final_hit1 FROM s),
    metrics AS (SELECT *, round_even((final_hit1 - base_hit1) * 100, 3) AS delta_pt, {r('recover', '(n - base_hit)')} AS recovery_rate, {r('regress', 'base_hit')} AS regression_rate, {r('overwrite', 'n')} AS overwrite_rate FROM m)"""


SWEPT_SQL = f"""WITH {GROUPS_SQL}, {DECIDE_SQL},
    o AS (SELECT *, coalesce(rerank_top1 <> base AND margin >= tau, false) AS overwritten FROM d, {TAU_SQL}),
    f AS (SELECT *, CASE WHEN overwritten THEN rerank_top1 ELSE base END AS final_top1 FROM o), {metrics_sql('f')}"""


@query(f"{SWEPT_SQL} SELECT * FROM metrics")
def log_margin_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the log's groups for each threshold."""
    return gate.sweep(groups(spark, folder), TAUS)


LINE_SQL = f"""WITH x AS (SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_extendedprice / 10000 AS score, l_quantity AS q FROM lineitem),
    g AS (SELECT grp, arg_max(idx, (score, -idx))::INTEGER AS best, max(score) - max(score) FILTER (WHERE idx = 1) AS margin, arg_max(idx, (q, -idx))::INTEGER AS want FROM x GROUP BY 1),
    o AS (SELECT *, best <> 1 AND margin >= tau AS overwritten FROM g, {TAU_SQL}),
    f AS (SELECT tau, want AS target, 1 AS base, best AS rerank_top1, overwritten, CASE WHEN overwritten THEN best ELSE 1 END AS final_top1 FROM o), {metrics_sql('f')}"""


@query(f"{LINE_SQL} SELECT * FROM metrics")
def margin_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics for each threshold over the candidate groups of the largest table: one shuffle collects the groups."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("x"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("grp")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    place = F.transform(F.col("xs"), lambda x, i: (i + 1).cast("string"))
    wanted = F.lit(1) - F.array_max(F.transform(F.col("xs"), lambda x, i: F.struct(x["l_quantity"].alias("q"), (-i).alias("i"))))["i"]
    scored = grouped.select("grp", place.alias("cands"), F.transform(F.col("xs"), lambda x: x["l_extendedprice"] / 10000).alias("scores"), F.lit("1").alias("base"), wanted.cast("string").alias("target"))
    return gate.sweep(scored, TAUS)


@query(f"WITH {GROUPS_SQL}, {DECIDE_SQL}, o AS (SELECT *, coalesce(rerank_top1 <> base AND margin >= 2.5, false) AS overwritten FROM d) SELECT grp, rerank_index, rerank_top1, round(margin, 6) AS margin, overwritten, CASE WHEN rerank_top1 = base THEN 'same_top1' WHEN overwritten THEN 'overwrite' ELSE 'below_tau' END AS reason, CASE WHEN overwritten THEN rerank_top1 ELSE base END AS final_top1 FROM o")
def margin_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The decision of every group."""
    return gate.decide(groups(spark, folder), F.lit(2.5)).select("grp", "rerank_index", "rerank_top1", F.round("margin", 6).alias("margin"), "overwritten", "reason", "final_top1")


@query(f"{SWEPT_SQL}, t AS (SELECT *, CASE WHEN regression_rate <= 0.02 THEN 1 WHEN regression_rate <= 0.05 THEN 2 ELSE 3 END AS tier FROM metrics) SELECT * FROM t ORDER BY tier, final_hit1 DESC, CASE WHEN tier = 3 THEN regression_rate ELSE 0 END, tau LIMIT 1")
def margin_recommend(spark: SparkSession, folder: str) -> DataFrame:
    """The recommended threshold."""
    return gate.recommend(gate.sweep(groups(spark, folder), TAUS))


NATIVE, TAU_NATIVE = 3, 2.0

_PART = "count(*) FILTER (WHERE {0})"
_SHARE = "CASE WHEN {1} > 0 THEN round_even({0} / {1}, 6) ELSE 0.0 END"
DUAL_SQL = f"""WITH {GROUPS_SQL}, {DECIDE_SQL},
    o AS (SELECT d.*, tau, coalesce(rerank_top1 <> base AND margin >= CASE WHEN rerank_index > {NATIVE} THEN tau ELSE {TAU_NATIVE} END, false) AS overwritten, list_contains(cands, target) AS covered, base <> target AND list_contains(cands[1:{NATIVE}], target) AS in_a FROM d, {TAU_SQL}),
    f AS (SELECT *, CASE WHEN overwritten THEN rerank_top1 ELSE base END AS final_top1, base <> target AND NOT in_a AS in_b FROM o), {metrics_sql('f')},
    x AS (SELECT tau, {_PART.format(f'overwritten AND rerank_index > {NATIVE}')} AS overwrite_inject, {_PART.format('in_a')} AS a_n, {_PART.format('in_a AND final_top1 = target')} AS a_recover, {_PART.format('in_b')} AS b_n, {_PART.format('in_b AND covered')} AS b_covered,
        {_PART.format('in_b AND covered AND final_top1 = target')} AS b_recover, {_PART.format('base = target AND final_top1 = target')} AS hit_kept FROM f GROUP BY 1),
    dual AS (SELECT metrics.*, x.* EXCLUDE (tau, hit_kept), {_SHARE.format('a_recover', 'a_n')} AS a_recovery_rate, {_SHARE.format('b_recover', 'b_covered')} AS b_recovery_rate, {_SHARE.format('hit_kept', 'base_hit')} AS hit_subset_final_hit1, {_SHARE.format('overwrite_inject', 'n')} AS overwrite_inject_rate FROM metrics JOIN x USING (tau))"""


@query(f"{DUAL_SQL} SELECT * FROM dual")
def margin_dual_tau(spark: SparkSession, folder: str) -> DataFrame:
    """Two thresholds, the second one swept: it holds where the winner is past the native candidates; with what becomes of each slice."""
    g = groups(spark, folder).withColumn("tau", F.explode(F.array(*map(F.lit, TAUS))))
    d = gate.decide_dual(g, F.lit(TAU_NATIVE), F.col("tau"), F.lit(NATIVE))
    b, t, r, f = F.col("base"), F.col("target"), F.col("rerank_top1"), F.col("final_top1")
    inside, covered = F.array_contains(F.slice("cands", 1, NATIVE), t), F.array_contains("cands", t)
    in_a, in_b = (b != t) & inside, (b != t) & ~inside
    s = d.groupBy("tau").agg(
        F.count("*").alias("n"), F.count_if(b == t).alias("base_hit"), F.count_if(r == t).alias("raw_hit"), F.count_if(f == t).alias("final_hit"), F.count_if((b != t) & (f == t)).alias("recover"),
        F.count_if((b == t) & (f != t)).alias("regress"), F.count_if("overwritten").alias("overwrite"), F.count_if(F.col("overwritten") & (F.col("rerank_index") > NATIVE)).alias("overwrite_inject"),
        F.count_if(in_a).alias("a_n"), F.count_if(in_a & (f == t)).alias("a_recover"), F.count_if(in_b).alias("b_n"), F.count_if(in_b & covered).alias("b_covered"), F.count_if(in_b & covered & (f == t)).alias("b_recover"),
    )
    n, base, final = F.col("n"), gate.rate(F.col("base_hit"), F.col("n")), gate.rate(F.col("final_hit"), F.col("n"))
    rates = {
        "recovery_rate": ("recover", n - F.col("base_hit")), "regression_rate": ("regress", F.col("base_hit")), "overwrite_rate": ("overwrite", n), "a_recovery_rate": ("a_recover", F.col("a_n")),
        "b_recovery_rate": ("b_recover", F.col("b_covered")), "overwrite_inject_rate": ("overwrite_inject", n),
    }
    out = s.withColumn("base_hit1", base).withColumn("raw_hit1", gate.rate(F.col("raw_hit"), n)).withColumn("final_hit1", final).withColumn("delta_pt", F.bround((final - base) * 100, 3))
    for name, (part, whole) in rates.items():
        out = out.withColumn(name, gate.rate(F.col(part), whole))
    return out.withColumn("hit_subset_final_hit1", gate.rate(F.col("base_hit") - F.col("regress"), F.col("base_hit")))


@query(f"{SWEPT_SQL}, k AS (SELECT tau, source, count(*) FILTER (WHERE base = target) AS hits, count(*) FILTER (WHERE base = target AND final_top1 <> target) AS lost, count(*) FILTER (WHERE final_top1 = target) - count(*) FILTER (WHERE base = target) AS gained, count(*) AS n FROM f GROUP BY 1, 2) SELECT tau, bool_and(lost < 0.02 * hits OR hits = 0) AS safe, round(min(gained / n) * 100, 4) AS worst_delta FROM k GROUP BY 1")
def cross_set_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Each threshold's worst gain over the sets, and whether every set keeps its regression low."""
    s = gate.sweep(groups(spark, folder), TAUS, groups=("source",))
    return s.groupBy("tau").agg(F.bool_and((F.col("regress") < 0.02 * F.col("base_hit")) | (F.col("base_hit") == 0)).alias("safe"), F.round(F.min((F.col("final_hit") - F.col("base_hit")) / F.col("n")) * 100, 4).alias("worst_delta"))


@query(f"{SWEPT_SQL}, r AS (SELECT tau, grp, base, final_top1, target, row_number() OVER (PARTITION BY tau ORDER BY grp) AS place FROM f WHERE overwritten) SELECT tau, place::INTEGER AS place, grp, base, final_top1, target FROM r WHERE place <= 15")
def first_flips(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifteen overwritten groups of each threshold."""
    from pyspark.sql import Window as W

    d = gate.decide(groups(spark, folder).withColumn("tau", F.explode(F.array(*map(F.lit, TAUS)))), F.col("tau")).filter("overwritten")
    return d.withColumn("place", F.row_number().over(W.partitionBy("tau").orderBy("grp"))).filter("place <= 15").select("tau", "place", "grp", "base", "final_top1", "target")


@query(f"WITH {GROUPS_SQL}, e AS (SELECT grp, unnest(cands) AS c, unnest(scores) AS s, generate_subscripts(cands, 1) AS i FROM g) SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY s DESC, i)::INTEGER AS place, c AS candidate, i::INTEGER AS orig_index FROM e")
def rank_list(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by falling score with their first place."""
    pairs = F.transform("cands", lambda x, i: F.struct((-F.get(F.col("scores"), i)).alias("s"), i.alias("i"), x.alias("c")))
    each = groups(spark, folder).select("grp", F.posexplode(F.array_sort(pairs)).alias("place", "x"))
    return each.select("grp", (F.col("place") + 1).alias("place"), F.col("x.c").alias("candidate"), (F.col("x.i") + 1).alias("orig_index"))


@query(f"WITH {GROUPS_SQL} SELECT grp, list_position(scores, list_max(scores))::INTEGER AS best, len(list_filter(scores, lambda x: x = list_max(scores)))::INTEGER AS ties, round(scores[list_position(cands, target)], 6) AS target_score FROM g")
def argmax_ties(spark: SparkSession, folder: str) -> DataFrame:
    """The winner of each group, how many share its score, and the score of the target."""
    g = groups(spark, folder)
    return g.select("grp", C.best_index(F.col("scores")).alias("best"), F.size(F.filter("scores", lambda x: x == F.array_max("scores"))).alias("ties"), F.round(C.score_at(F.col("cands"), F.col("scores"), F.col("target")), 6).alias("target_score"))


_FIRST = "list_sort(list_distinct(list_filter({0}, lambda x: x <> '')))"


@query(f"SELECT row_id, array_to_string({_FIRST.format('mozc_nbest')}, '|') AS kept, len(list_filter(mozc_nbest[1:3], lambda x: true))::INTEGER AS capped FROM holdout WHERE mozc_nbest IS NOT NULL")
def candidate_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct non-empty candidates of a row (sorted here, so that engines agree) and the capped length."""
    c = F.col("mozc_nbest")
    return read(spark, folder, "holdout").filter("mozc_nbest IS NOT NULL").select("row_id", F.array_join(F.array_sort(C.dedupe(c)), "|").alias("kept"), F.size(C.cap(c, 3)).alias("capped"))


@query("WITH e AS (SELECT row_id, unnest(mozc_nbest) AS c, generate_subscripts(mozc_nbest, 1) AS i FROM holdout), d AS (SELECT row_id, c, min(i) AS i FROM e WHERE c <> '' AND NOT regexp_matches(c, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2190}-\\x{21FF}\\x{0400}-\\x{04FF}\\x{0370}-\\x{03FF}]') AND regexp_matches(c, '[\\p{L}\\p{N}\\p{M}]') GROUP BY 1, 2) SELECT row_id, c AS candidate, row_number() OVER (PARTITION BY row_id ORDER BY i)::INTEGER AS place FROM d")
def sanitize_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates after hygiene."""
    each = read(spark, folder, "holdout").select("row_id", F.posexplode(C.sanitize(F.col("mozc_nbest"))).alias("place", "candidate"))
    return each.select("row_id", "candidate", (F.col("place") + 1).alias("place"))


_NORMS = f"n AS (SELECT row_id, gold, mozc_nbest, {S.weak('gold')} AS wg, {S.strong('gold')} AS sg FROM holdout), e AS (SELECT row_id, unnest(mozc_nbest) AS c, generate_subscripts(mozc_nbest, 1) AS i FROM n), w AS (SELECT row_id, i, c, {S.weak('c')} AS wc, {S.strong('c')} AS sc FROM e)"


@query(
    f"""WITH {_NORMS}, r AS (SELECT n.row_id, min(i) FILTER (WHERE wc = wg) AS weak_rank, min(i) FILTER (WHERE c = gold) AS exact, min(i) FILTER (WHERE sc = sg AND sg <> '') AS loose FROM n LEFT JOIN w USING (row_id) GROUP BY 1)
    SELECT row_id, weak_rank::INTEGER AS weak_rank, coalesce(exact, loose)::INTEGER AS strong_rank FROM r"""
)
def gold_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The target's place under the weak norm, and exactly else under the strong norm."""
    return _normed(spark, folder, "holdout").select("row_id", C.rank_of(F.col("wg"), F.col("wc")).cast("int").alias("weak_rank"), C.rank_exact_then(F.col("gold"), F.col("mozc_nbest"), F.col("sg"), F.col("sc")).cast("int").alias("strong_rank"))


def _normed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Targets and candidates with both norms; NFKC runs once over target and candidates joined by a separator."""
    rows = read(spark, folder, table).select("row_id", "gold", "mozc_nbest", "category", T.nfkc(F.col("gold")).alias("g"), T.nfkc(F.array_join(F.coalesce("mozc_nbest", F.array().cast("array<string>")), "\u0001", "")).alias("c"))
    strong = lambda x: F.regexp_replace(x, r"(?U)[\s・･]", "")
    parts = F.when(F.size("mozc_nbest") > 0, F.split("c", "\u0001")).otherwise(F.array().cast("array<string>"))
    return rows.select("row_id", "gold", "mozc_nbest", "category", T.strip(F.col("g")).alias("wg"), strong(F.col("g")).alias("sg"), F.transform(parts, T.strip).alias("wc"), F.transform(parts, strong).alias("sc"))


@query(f"WITH {_NORMS} SELECT n.row_id, CASE WHEN any_value(n.mozc_nbest) IS NULL THEN NULL WHEN any_value(sg) = '' THEN true ELSE coalesce(bool_or(sc = sg), false) END AS known FROM n LEFT JOIN w USING (row_id) GROUP BY 1")
def surface_in_list(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the target is a candidate under the strong norm; unknown without a list."""
    n = _normed(spark, folder, "holdout")
    return n.select("row_id", F.when(F.col("mozc_nbest").isNull(), F.lit(None).cast("boolean")).when(F.col("sg") == "", F.lit(True)).otherwise(F.coalesce(F.array_contains("sc", F.col("sg")), F.lit(False))).alias("known"))


@query(
    """SELECT row_id, array_to_string(CASE WHEN mozc_top1 IS NULL OR mozc_top1 = '' OR list_contains(h, mozc_top1) THEN h ELSE list_concat([mozc_top1], h)[1:3] END, '|') AS kept,
    (CASE WHEN mozc_top1 IS NULL OR list_contains(all_, mozc_top1) THEN all_ ELSE list_concat([mozc_top1], all_) END)[1] AS first FROM (SELECT row_id, mozc_top1, coalesce(mozc_nbest, []) AS all_, coalesce(mozc_nbest, [])[1:3] AS h FROM holdout)"""
)
def cap_keeping(spark: SparkSession, folder: str) -> DataFrame:
    """Three candidates with the baseline among them, and the first of the list with the baseline ensured."""
    c, b = F.col("mozc_nbest"), F.col("mozc_top1")
    return read(spark, folder, "holdout").select("row_id", F.array_join(C.cap_keeping(c, b, 3), "|").alias("kept"), F.get(C.ensure(c, b), F.lit(0)).alias("first"))


@query("SELECT row_id, coalesce(list_contains(mozc_nbest[1:1], gold), false) AS hit1, coalesce(list_contains(mozc_nbest[1:3], gold), false) AS hit3, coalesce(list_contains(mozc_nbest, gold), false) AS hit_any FROM holdout")
def hit_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Hits at one, at three and anywhere."""
    g, c = F.col("gold"), F.col("mozc_nbest")
    return read(spark, folder, "holdout").select("row_id", C.hit_at(g, c, 1).alias("hit1"), C.hit_at(g, c, 3).alias("hit3"), C.hit_at(g, c, 1 << 20).alias("hit_any"))


@query(
    """WITH e AS (SELECT row_id, gold, unnest(mozc_nbest) AS c, generate_subscripts(mozc_nbest, 1) AS i FROM holdout WHERE gold <> ''),
    d AS (SELECT row_id, c, min(i) AS i FROM e WHERE c <> '' AND c <> gold GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i) AS k FROM d)
    SELECT row_id, gold AS candidate, 1 AS label FROM holdout WHERE gold <> '' UNION ALL SELECT row_id, c, 0 FROM r WHERE k <= 15"""
)
def group_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A positive and at most fifteen negatives of each group."""
    rows = read(spark, folder, "holdout").filter("gold <> ''")
    pairs = F.concat(F.array(F.struct(F.col("gold").alias("candidate"), F.lit(1).alias("label"))), F.transform(C.negatives(F.col("gold"), F.col("mozc_nbest")), lambda x: F.struct(x.alias("candidate"), F.lit(0).alias("label"))))
    return rows.select("row_id", F.inline(pairs))


@query(
    f"""WITH {GROUPS_SQL}, {DECIDE_SQL}, e AS (SELECT grp, unnest(cands) AS c, unnest(scores) AS s, generate_subscripts(cands, 1) AS i FROM g)
    SELECT grp, string_agg(c, '|' ORDER BY s DESC, i) AS ranked FROM e GROUP BY 1"""
)
def reorder_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate list in ranked order."""
    g = groups(spark, folder)
    return g.select("grp", F.array_join(C.ranked(F.col("cands"), F.col("scores")), "|").alias("ranked"))


_FINE_SQL = "NOT regexp_matches(c, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2190}-\\x{21FF}\\x{0400}-\\x{04FF}\\x{0370}-\\x{03FF}]') AND regexp_matches(c, '[\\p{L}\\p{N}\\p{M}]')"


@query(
    f"""WITH r AS (SELECT log_id, {S.strip("coalesce(chosen, '')")} AS gold, {S.strip("coalesce(nbest[1], '')")} AS b, {S.strip("coalesce(rerank_top1, '')")} AS r, {S.strip("coalesce(final_top1, '')")} AS f, {S.clean_context('context_prev')} AS context FROM rerank_smoke WHERE {S.key_norm('reading')} <> ''),
    k AS (SELECT * FROM r WHERE gold <> '' AND b <> ''), e AS (SELECT log_id, gold, b, unnest([b, r, f, gold]) AS c, unnest([0, 1, 2, 3]) AS i FROM k), d AS (SELECT log_id, c, min(i) AS i FROM e WHERE c <> '' AND (({_FINE_SQL}) OR c = gold OR c = b) GROUP BY 1, 2)
    SELECT log_id, string_agg(c, '|' ORDER BY CASE WHEN c = k.gold AND NOT ({_FINE_SQL}) AND i > 0 THEN 9 ELSE i END) AS cands, any_value(CASE WHEN k.b = k.gold THEN 'usage_anchor' ELSE 'usage_correction' END) AS category, any_value(context) AS context FROM d JOIN k USING (log_id) GROUP BY 1"""
)
def usage_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups out of usage outcomes: the baseline first, then what was ranked, shown and wanted, after hygiene; the wanted one is always there."""
    none = F.lit("")
    text = lambda c: T.strip(F.coalesce(c, none))
    rows = read(spark, folder, "rerank_smoke").filter(T.key_norm(F.col("reading")) != "")
    rows = rows.select("log_id", text(F.col("chosen")).alias("gold"), text(F.get("nbest", F.lit(0))).alias("b"), text(F.col("rerank_top1")).alias("r"), text(F.col("final_top1")).alias("f"), T.clean_context(F.col("context_prev")).alias("context")).filter("gold <> '' AND b <> ''")
    fine = C.sanitize(F.array("b", "r", "f", "gold"))
    whole = F.when(F.array_contains(fine, F.col("gold")), fine).otherwise(F.concat(fine, F.array("gold")))
    ordered = F.concat(F.array("b"), F.array_remove(whole, F.col("b")))
    return rows.select("log_id", F.array_join(ordered, "|").alias("cands"), F.when(F.col("b") == F.col("gold"), "usage_anchor").otherwise("usage_correction").alias("category"), "context")


@query(
    """WITH g AS (SELECT row_id, [coalesce(mozc_nbest, [])[1:3], [coalesce(gold, ''), coalesce(reading, '')], coalesce(mozc_nbest, [])[2:3]] AS seg, mozc_nbest FROM holdout), b AS (SELECT row_id, seg, mozc_nbest, list_transform(seg, lambda s: coalesce(s[1], '')) AS best FROM g),
    p AS (SELECT row_id, list_concat([array_to_string(best, '')], list_transform(seg[1][2:], lambda x: x || best[2] || best[3]), list_transform(seg[2][2:], lambda x: best[1] || x || best[3]), list_transform(seg[3][2:], lambda x: best[1] || best[2] || x), coalesce(mozc_nbest, [])) AS paths FROM b),
    e AS (SELECT row_id, unnest(paths) AS path, generate_subscripts(paths, 1) AS i FROM p), d AS (SELECT row_id, path, min(i) AS i FROM e WHERE path <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i) AS k FROM d)
    SELECT row_id, path, k::INTEGER AS place FROM r WHERE k <= 8"""
)
def nbest_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths over segments with alternates: the best one, each segment's alternates with the others fixed, then whole candidates; capped."""
    none, c = F.lit(""), C.or_empty(F.col("mozc_nbest"))
    segments = F.array(F.slice(c, 1, 3), F.array(F.coalesce("gold", none), F.coalesce("reading", none)), F.slice(c, 2, 2))
    each = read(spark, folder, "holdout").select("row_id", F.posexplode(C.paths(segments, F.col("mozc_nbest"), 8)).alias("place", "path"))
    return each.select("row_id", "path", (F.col("place") + 1).alias("place"))


@query(f"WITH {GROUPS_SQL}, r AS (SELECT grp, cands, list_reverse(cands)[1:2] AS wish FROM g) SELECT grp, array_to_string(list_concat(list_filter(wish, lambda x: list_contains(cands, x)), list_filter(cands, lambda x: NOT list_contains(wish, x))), '|') AS reordered FROM r")
def reorder_segment(spark: SparkSession, folder: str) -> DataFrame:
    """A list in a wished order of two of its members; the others keep their places behind."""
    g = groups(spark, folder).withColumn("wish", F.slice(F.reverse("cands"), 1, 2))
    return g.select("grp", F.array_join(C.reorder(F.col("cands"), F.col("wish")), "|").alias("reordered"))


@query(f"{SWEPT_SQL}, k AS (SELECT tau, source, count(*) FILTER (WHERE base = target) AS hits, count(*) FILTER (WHERE base = target AND final_top1 <> target) AS lost, count(*) FILTER (WHERE final_top1 = target) - count(*) FILTER (WHERE base = target) AS gained, count(*) AS n FROM f GROUP BY 1, 2), c AS (SELECT tau, bool_and(lost < 0.02 * hits OR hits = 0) AS safe, round(min(gained / n) * 100, 4) AS worst_delta FROM k GROUP BY 1) SELECT tau, worst_delta FROM c WHERE safe ORDER BY worst_delta DESC, tau LIMIT 1")
def cross_set_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold with the best worst gain among those that are safe in every set, or none; a choice of one row of a small sweep."""
    return cross_set_selection(spark, folder).filter("safe").orderBy(F.desc("worst_delta"), "tau").limit(1).select("tau", "worst_delta")
