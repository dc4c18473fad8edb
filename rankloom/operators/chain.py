"""The whole decision of one request: normalise, clean, cap, guard, score, margin, junk guard, ranked list.

One projection chain over a row; it runs the same over tables and streams.  Only rows that no guard stops get texts, so
the scorer sees nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scoring
from rankloom.functions import text as T
from rankloom.operators import candidates as C
from rankloom.operators import gate


def normalised(requests: DataFrame, reading: str, context: str, candidates: str, cap: int) -> DataFrame:
    """Add r (the key), c (the clean context), cands (non-empty, capped), base and fault: what makes a request unusable."""
    cands = F.filter(C.or_empty(F.col(candidates)), lambda x: x.isNotNull() & (x != ""))
    out = requests.withColumn("r", T.context_key_norm(F.col(reading))).withColumn("c", T.clean_context(F.col(context))).withColumn("cands", C.cap(cands, cap))
    fault = F.when(F.coalesce("r", F.lit("")) == "", "reading required").when(F.size("cands") == 0, "nbest required")
    return out.withColumn("base", F.get("cands", F.lit(0))).withColumn("fault", fault)


def answer(requests: DataFrame, guard: Column, scorer: Callable, tau: float) -> DataFrame:
    """Add rerank_top1, final_top1, overwritten, margin, reason, guard_skip and ranked to the rows of ``normalised``.

    ``guard`` is the reason not to score, or null.  A skipped request keeps its order; an overwrite with a junk surface
    falls back to the baseline; the decided surface comes first, the others by falling score.  Unusable requests have no
    answer but a reason.
    """
    reason = F.coalesce("fault", guard)
    texts = F.when(reason.isNull(), scoring.pair_texts(F.col("r"), F.col("c"), F.col("cands")))
    scored = requests.withColumn("stop", reason).withColumn("scores", scoring.score_udf(scorer)(texts))
    d = gate.decide(scored, F.lit(tau))
    junk = F.col("overwritten") & T.junk_surface(F.col("final_top1")) & (F.col("final_top1") != F.col("base"))
    kept = F.col("overwritten") & ~junk
    final = F.when(kept, F.col("rerank_top1")).otherwise(F.col("base"))
    order = C.final_first(C.ranked(F.col("cands"), F.col("scores")), F.col("final"))
    out = d.withColumn("guard_skip", F.col("stop").isNotNull()).withColumn("final", final).withColumn("kept", kept).withColumn("why", F.coalesce("stop", F.when(junk, "junk_candidate"), "reason"))
    skipped, usable = F.col("guard_skip"), F.col("fault").isNull()
    return out.select(
        *requests.columns, F.when(usable, F.coalesce("rerank_top1", "base")).alias("rerank_top1"), F.when(usable, F.col("final")).alias("final_top1"), F.coalesce(F.col("kept"), F.lit(False)).alias("overwritten"), "margin", F.col("why").alias("reason"), "guard_skip",
        F.when(~usable, F.lit(None)).when(skipped, F.col("cands")).otherwise(order).alias("ranked"),
    )
