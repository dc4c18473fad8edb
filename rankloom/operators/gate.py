"""Margin-gated decisions over scored candidate groups and the metrics of parameter sweeps.

A group keeps its candidates and scores as parallel arrays, so a decision is an expression of one row; a sweep copies
the decided row once for each of a few parameters before a pre-aggregated ``groupBy`` of the parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.candidates import best_index, score_at


def decide(df: DataFrame, tau: Column, candidates: str = "cands", scores: str = "scores", baseline: str = "base") -> DataFrame:
    """Add rerank_index, rerank_top1, score_rerank, score_base, margin, overwritten, reason and final_top1.

    The highest score wins over the baseline only by ``tau`` or more.  Without the baseline among the candidates, or
    without scores, the baseline stays and the margin is null.
    """
    c, s, b = F.col(candidates), F.col(scores), F.col(baseline)
    out = df.withColumn("rerank_index", best_index(s)).withColumn("rerank_top1", F.try_element_at(c, F.col("rerank_index")))
    out = out.withColumn("score_rerank", F.try_element_at(s, F.col("rerank_index"))).withColumn("score_base", score_at(c, s, b))
    out = out.withColumn("margin", F.col("score_rerank") - F.col("score_base"))
    over = F.coalesce((F.col("rerank_top1") != b) & (F.col("margin") >= tau), F.lit(False))
    out = out.withColumn("overwritten", over)
    reason = F.when(F.col("rerank_index").isNull(), "no_scores").when(F.col("score_base").isNull(), "baseline_missing").when(F.col("rerank_top1") == b, "same_top1").when(over, "overwrite").otherwise("below_tau")
    return out.withColumn("reason", reason).withColumn("final_top1", F.when(over, F.col("rerank_top1")).otherwise(b))


def decide_dual(df: DataFrame, tau_native: Column, tau_inject: Column, n_native: Column) -> DataFrame:
    """The same gate with another threshold where the winner is an injected candidate."""
    tau = F.when(best_index(F.col("scores")) > n_native, tau_inject).otherwise(tau_native)
    return decide(df, tau)


def at_each(decided: DataFrame, taus: list[float]) -> DataFrame:
    """Decided rows once for each tau: winner and margin are found before the rows are copied, only the gate after."""
    each = decided.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    each = each.withColumn("overwritten", F.coalesce((F.col("rerank_top1") != F.col("base")) & (F.col("margin") >= F.col("tau")), F.lit(False)))
    return each.withColumn("final_top1", F.when(F.col("overwritten"), F.col("rerank_top1")).otherwise(F.col("base")))


def rate(part: Column, whole: Column) -> Column:
    """Rounded share, zero where there is nothing to divide by."""
    return F.when(whole > 0, F.bround(part / whole, 6)).otherwise(F.lit(0.0))


def sweep(df: DataFrame, taus: list[float], target: str = "target", groups: tuple[str, ...] = ()) -> DataFrame:
    """One row for each tau (and group): hits before and after, recovery, regression and overwrite rates."""
    d = at_each(decide(df, F.lit(0.0)).select(*groups, target, "base", "rerank_top1", "margin"), taus)
    t, b, r, f = F.col(target), F.col("base"), F.col("rerank_top1"), F.col("final_top1")
    on = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    sums = d.groupBy(*groups, "tau").agg(
        F.count("*").alias("n"), on(b == t).alias("base_hit"), on(r == t).alias("raw_hit"), on(f == t).alias("final_hit"),
        on((b != t) & (f == t)).alias("recover"), on((b == t) & (f != t)).alias("regress"), F.count_if("overwritten").alias("overwrite"),
    )
    n, base, final = F.col("n"), rate(F.col("base_hit"), F.col("n")), rate(F.col("final_hit"), F.col("n"))
    return sums.withColumn("base_hit1", base).withColumn("raw_hit1", rate(F.col("raw_hit"), n)).withColumn("final_hit1", final).withColumn("delta_pt", F.bround((final - base) * 100, 3)).withColumn(
        "recovery_rate", rate(F.col("recover"), n - F.col("base_hit"))
    ).withColumn("regression_rate", rate(F.col("regress"), F.col("base_hit"))).withColumn("overwrite_rate", rate(F.col("overwrite"), n))


def recommend(swept: DataFrame, limits: tuple[float, float] = (0.02, 0.05)) -> DataFrame:
    """The best row of a sweep: within the strictest limit of regression that any row meets, the most final hits.

    The sweep has a row for each parameter, so the one ordering runs over that.
    """
    tier = F.when(F.col("regression_rate") <= limits[0], 1).when(F.col("regression_rate") <= limits[1], 2).otherwise(3)
    tie = F.when(tier == 3, F.col("regression_rate")).otherwise(F.lit(0.0))
    return swept.withColumn("tier", tier).orderBy("tier", F.desc("final_hit1"), tie, "tau").limit(1)
