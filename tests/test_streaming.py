import random

import pytest
from pyspark.sql import functions as F

from rankloom.streaming import ladder, runs


def test_ladder_fold_equals_steps(spark):
    rng = random.Random(3)
    series = [[rng.random() < p for _ in range(60)] for p in (0.1, 0.5, 0.9, 0.97) for _ in range(5)] + [[]]
    df = spark.createDataFrame(list(enumerate(series)), "i int, x array<boolean>")
    got = {r["i"]: tuple(r["s"]) for r in df.select("i", ladder.fold(F.col("x")).alias("s")).collect()}
    for i, outcomes in enumerate(series):
        state = (0, 0, 0)
        for timeout in outcomes:
            state = ladder.step(*state, timeout)
        assert got[i] == state


def test_ladder_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), None if rng.random() < 0.02 else rng.random() < (0.85 if i % 200 < 120 else 0.1)) for i in range(900)]
    df = spark.createDataFrame(rows, "i bigint, c string, t boolean")
    got = {r["c"]: (r["tier"], r["bad"], r["good"]) for r in ladder.tiers(df, "c", ["i"], F.col("t"), F.floor(F.col("i") / 37), block=16).collect()}
    for client in "ab":
        state = (0, 0, 0)
        for _, own, timeout in rows:
            if own == client:
                state = ladder.step(*state, bool(timeout))
        assert got[client] == (state[0], min(state[1], ladder.STEP), min(state[2], ladder.STEP))
    assert ladder.tiers(df.limit(0), "c", ["i"], F.col("t"), F.col("i")).count() == 0


def test_update_streams_keep_the_last_row_of_a_key(spark, tmp_path):
    for part in range(2):
        spark.createDataFrame([(10 * part + i, "ab"[i % 2], True) for i in range(10)], "i bigint, c string, timeout boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i bigint, c string, timeout boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = runs.run_once(ladder.tier_stream(stream, "c", "i"), "update", ["c"]).collect()
    assert sorted((r["c"], r["tier"]) for r in rows) == [("a", 2), ("b", 2)]
    with pytest.raises(ValueError):
        runs.run_once(stream, "update")
    counts = runs.run_once(stream.groupBy("c").agg(F.count("*").alias("n")), "complete").collect()
    assert sorted((r["c"], r["n"]) for r in counts) == [("a", 10), ("b", 10)]


def test_decisions_of_odd_requests(spark):
    from rankloom.functions import scoring
    from rankloom.operators import chain

    rows = [(1, None, "文脈だ", ["a"]), (2, "よみかた", "文脈だ", []), (3, "よみかた", "文脈だ", None), (4, "よみかた", "文脈だ", ["漢字", None, "", "よみ方"]), (5, "よみかた", None, ["漢字"]), (6, "ヨミカタ", "文脈だ", ["方", "ヨミカタ"])]
    n = chain.normalised(spark.createDataFrame(rows, "i int, reading string, context string, nbest array<string>"), "reading", "context", "nbest", 30)
    guard = F.when(F.col("c") == "", "context_empty_or_symbol")
    got = {r["i"]: r for r in chain.answer(n, guard, scoring.overlap_scorer, 0.5).collect()}
    assert [got[i]["reason"] for i in (1, 2, 3, 5)] == ["reading required", "nbest required", "nbest required", "context_empty_or_symbol"]
    assert got[1]["final_top1"] is None and got[1]["ranked"] is None and got[5]["final_top1"] == "漢字" and got[5]["guard_skip"]
    assert got[4]["final_top1"] == "よみ方" and got[4]["ranked"] == ["よみ方", "漢字"] and got[4]["overwritten"]
    assert got[6]["reason"] in ("junk_candidate", "below_tau", "same_top1") and got[6]["final_top1"] == "方"


def test_stream_equals_batch(spark, folder):
    from rankloom.plans import q_stream as q

    batch = {r["user_id"]: r["tier"] for r in q.degrade_ladder(spark, folder).collect()}
    assert {r["user_id"]: r["tier"] for r in q.degrade_ladder_stream(spark, folder).collect()} == batch


def test_answers(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("broken",), ('{"ping": true}',), ("[1]",)], "value string")
    out = [r["response"] for r in runs.answer_requests(lines, "a int", lambda x: x.withColumn("response", F.col("a").cast("string"))).collect()]
    assert out == ["1", '{"ok":false}', '{"ok":true,"pong":true}', '{"ok":false}']


def test_budget(spark):
    pending = spark.createDataFrame([(i, 1.0) for i in range(10)], "i bigint, c double")
    assert runs.budgeted(pending, spark.createDataFrame([(0,)], "i bigint"), "i", "c", "i", 2.0, 5.0).count() == 3
    log = spark.createDataFrame([(1, 9.0), (2, 4.0)], "i int, s double")
    assert runs.last_spend(log, "i", "s") == 4.0 and runs.last_spend(log.limit(0), "i", "s") == 0.0
