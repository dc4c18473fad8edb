import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import scoring
from rankloom.functions import text as T
from rankloom.operators import candidates as C
from rankloom.operators import dedup, gate, prefix, splits, stats, tables
from rankloom.operators.skew import hot_join, salted_lookup


def values(spark, column, items, kind="string"):
    return [r[0] for r in spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}").select("i", column.alias("y")).orderBy("i").select("y").collect()]


def test_norms(spark):
    x = F.col("x")
    assert values(spark, T.key_norm(x), ["ジンコウ・コキュウキ", "ケヵヶ", "　ｷｼｬ ", None, ""]) == ["じんこうこきゅうき", "けかけ", "きしゃ", None, ""]
    assert values(spark, T.context_key_norm(x), ["キシャ１２Ａ", "ヵヶ"]) == ["きしゃ12A", "ゕゖ"]
    assert values(spark, T.weak_surface(x), ["　ＡＢ ", "㌔"]) == ["AB", "キロ"]
    assert values(spark, T.strong_surface(x), ["東京 ・タワー"]) == ["東京タワー"]
    assert values(spark, T.valid_key(x), ["あ", "あい", "abc", None, "らーめん", "あ" * 61]) == [False, True, False, False, True, False]
    assert values(spark, T.meaningful_surface(x), ["一円", "漢字", "かな", None]) == [False, True, False, False]
    assert values(spark, T.junk_surface(x), ["", None, "實", "ｱｲ", "カタ カナ", "漢字", "かな"]) == [True, True, True, True, True, False, False]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("", ""), (None, ""), ("今日は天気", "今日は天気"), ("終わった。次の文", "次の文"), ("== 見出し == 本文", "本文"), ("前[編集]後", "前後"), ("[[東京|首都]]で", "首都で"), ("数[12]字", "数字"),
        ("a<ref name=x>注</ref>b", "ab"), ("　全角　空白　", "全角 空白"), ("A" * 80, "A" * 50), ("一。二！三？四", "四"), ("終わり。", ""), ("行\r\n次", "行 次"), ("* 箇条 ・ 点", "箇条 点"),
    ],
)
def test_clean_context(spark, given, wanted):
    assert values(spark, T.clean_context(F.col("x")), [given]) == [wanted]


def test_candidates(spark):
    x = F.col("x")
    lists = [["b", "", "a", "b", None], [], None, ["😀", "→", "γ", "漢", "!!"]]
    assert values(spark, C.dedupe(x), lists, "array<string>") == [["b", "a"], [], [], ["😀", "→", "γ", "漢", "!!"]]
    assert values(spark, C.sanitize(x), lists, "array<string>")[3] == ["漢"]
    assert values(spark, C.cap_keeping(x, F.lit("z"), 2), [["a", "b"], ["z", "a", "b"], None], "array<string>") == [["z", "a"], ["z", "a"], ["z"]]
    assert values(spark, C.best_index(x), [[1.0, 3.0, 3.0], [], None], "array<double>") == [2, None, None]
    assert values(spark, C.reorder(x, F.array(F.lit("c"), F.lit("q"), F.lit("a"))), [["a", "b", "c"]], "array<string>") == [["c", "a", "b"]]
    assert values(spark, C.member(F.lit("a"), x), [["a"], [], None], "array<string>") == [True, False, None]
    assert values(spark, C.rank_exact_then(F.lit("a b"), x, F.lit("ab"), F.transform(x, lambda y: F.regexp_replace(y, " ", ""))), [["ab", "a b"], ["ab"]], "array<string>") == [2, 1]
    assert values(spark, C.final_first(x, F.lit("b")), [["a", "b", "c"]], "array<string>") == [["b", "a", "c"]]


def test_gate_against_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        n = rng.randint(1, 5)
        cands = [f"c{rng.randint(0, 6)}" for _ in range(n)]
        rows.append((i, cands, [float(rng.randint(0, 4)) for _ in range(n)], rng.choice(["c0", "c1", cands[0]]), f"c{rng.randint(0, 6)}"))
    df = spark.createDataFrame(rows, "grp int, cands array<string>, scores array<double>, base string, target string")
    taus = [0.0, 1.0, 2.0]
    swept = {r["tau"]: r for r in gate.sweep(df, taus).collect()}
    for tau in taus:
        final = over = 0
        for _, cands, scores, base, target in rows:
            best = max(range(len(cands)), key=lambda k: (scores[k], -k))
            own = next((s for c, s in zip(cands, scores, strict=True) if c == base), None)
            take = own is not None and cands[best] != base and scores[best] - own >= tau
            over += take
            final += (cands[best] if take else base) == target
        assert (swept[tau]["overwrite"], swept[tau]["final_hit"]) == (over, final)
    assert swept[0.0]["overwrite"] >= swept[1.0]["overwrite"] >= swept[2.0]["overwrite"]
    assert gate.sweep(df.limit(0), taus).count() == 0


def test_running_total_and_ranks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 2), rng.randint(0, 9), rng.choice([None, 1, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g int, b int, w int")
    got = {r["i"]: r["t"] for r in prefix.running_total(df, ["g"], "b", [F.col("i")], "w", "t").collect()}
    for i, g, b, _ in rows:
        assert got[i] == sum(w or 0 for j, h, c, w in rows if h == g and (c, j) < (b, i))
    ranks = sorted(r["rank"] for r in stats.average_ranks(df, "i", "b", 3.0).collect())
    assert sum(ranks) == 200 * 201 / 2
    assert stats.value_at(df, "b", F.floor(F.col("n") / 2), 3.0).first()[0] == sorted(r[2] for r in rows)[100]


def test_wins_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, None)], "i int, k string, v string")
    assert sorted(r["i"] for r in dedup.wins(df, ["k"], "i").collect()) == [1, 3]
    assert sorted(r["i"] for r in dedup.wins(df, ["k"], "i", last=True).collect()) == [2, 4]
    assert dedup.wins(df.limit(0), ["k"], "i").count() == 0


def test_salted_lookup_keeps_all_rows(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), ("7", 2), (None, 3)], "k string, v int")
    assert salted_lookup(rows, lookup, ["k"], [F.col("id")], "left").filter("v = 1").count() == 334
    extra = rows.withColumn("k", F.lit(None).cast("string"))
    assert salted_lookup(extra, lookup, ["k"], [F.col("id")], "inner", null_safe=True).count() == 1000


def test_group_holdout_has_no_leak(spark):
    df = spark.range(500).select(F.col("id").alias("row"), (F.col("id") % 37).cast("string").alias("k"))
    held = splits.group_holdout(df, "row", "k", 0.2, 3)
    assert held.groupBy("k").agg(F.countDistinct("held").alias("n")).filter("n > 1").count() == 0
    assert held.filter("held").select("k").distinct().count() == 7


def test_extraction(spark):
    text = "題\n" + "-" * 30 + "\n注\n" + "-" * 30 + "\n｜青空《あおぞら》と漢字《かんじ》\n底本：本\n後"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string")
    assert df.select(tables.strip_boilerplate(F.col("t")).alias("b")).collect()[0]["b"] == "｜青空《あおぞら》と漢字《かんじ》"
    assert ("青空", "あおぞら") in {(r["surface"], r["reading"]) for r in tables.ruby(df, "i", "t").filter("implicit = 0").collect()}
    assert [r["char_begin"] for r in tables.sentences(spark.createDataFrame([(1, "あ。いう！え")], "i int, t string"), "i", "t").orderBy("sent_id").collect()] == [0, 2, 5]


def test_scoring(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "i int, c array<string>")
    got = {r["i"]: r["s"] for r in df.select("i", scoring.score_udf(scoring.overlap_scorer)(F.col("c")).alias("s")).collect()}
    assert len(got[1]) == 2 and got[2] == [] and got[3] is None
    assert scoring.parse_verdict('```json\n{"decision": "accept", "confidence": 0.9}\n```') == {"decision": "accept", "confidence": 0.9, "reason_code": ""}
    assert scoring.parse_verdict("no")["decision"] == "invalid"
    with pytest.raises(Exception, match="ended with"):
        scoring.convert_external(spark.createDataFrame([("x",)], "k string"), "k", ["false"]).collect()


def test_content_tokens(spark):
    from rankloom.operators.tables import content_token

    rows = [(["名詞"], "山"), (["助詞"], "は"), (None, "x"), ([], "x"), (["名詞"], "第3"), (["名詞"], "a@b"), (["名詞"], "三"), (["名詞", "数詞"], "１２"), (["名詞"], "https://x"), (["動詞"], "走る")]
    df = spark.createDataFrame(rows, "p array<string>, s string")
    assert [r[0] for r in df.select(content_token(F.col("p"), F.col("s"))).collect()] == [True, False, False, False, True, False, False, False, False, True]


def test_command_line(capsys):
    from rankloom.__main__ import main

    assert main(["list"]) == 0 and "margin_sweep" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing", "x"])


def test_hot_join(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None), (1, "x")], "a int, k string")
    right = spark.createDataFrame([(i, "x") for i in range(25)] + [(50, "y"), (51, None)], "b int, k string")
    wanted = sorted(map(tuple, left.join(right, ["k"]).collect()))
    for hot in (3, 1000):
        assert sorted(map(tuple, hot_join(left, right, ["k"], F.col("b"), hot).select("k", "a", "b").collect())) == wanted
    assert hot_join(left, right.limit(0), ["k"], F.col("b")).count() == 0


def test_cycled_rows(spark):
    from rankloom.operators import assembly

    rows = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(5)] + [(9000, "c")], "i bigint, k string")
    got = [(r["round"], r["k"], r["i"]) for r in assembly.cycled(rows, "k", "i", 8, 1).collect()]
    assert len(got) == 8 and all(sum(x[0] == r for x in got) == n for r, n in ((0, 3), (1, 3), (2, 2)))
    assert sorted(x for x in got if x[1] == "a")[:2] == [(0, "a", 0), (1, "a", 1)] and {x for x in got if x[1] == "c"} >= {(0, "c", 9000), (1, "c", 9000)}
    assert assembly.cycled(rows.limit(0), "k", "i", 8, 1).count() == 0 and assembly.cycled(rows, "k", "i", 0, 1).count() == 0


def test_sets_of_few_rows(spark):
    from rankloom.operators import assembly

    rows = spark.createDataFrame([(i, i < 3, i % 2 == 0, True) for i in range(9)], "row_id bigint, sensitive boolean, hit boolean, context boolean")
    sizes = assembly.Sizes(evaluation=3, least_train=1, least_evaluation=1)
    train, seen = assembly.train_set(rows, "row_id", sizes, 1)
    train, seen = [r["row_id"] for r in train.collect()], [r["row_id"] for r in seen.collect()]
    assert len(train) == len(set(train)) and len(seen) == 3 and not set(train) & set(seen)
    assert sum(x < 3 for x in train) == 2 and sum(x < 3 for x in seen) == 1
    assert assembly.train_set(rows.limit(0), "row_id", sizes, 1)[0].count() == 0
    assert assembly.evaluation_set(rows.limit(0), "row_id", sizes, 5).count() == 0
    assert {r["role"] for r in assembly.evaluation_set(rows.filter("sensitive"), "row_id", sizes, 5).collect()} == {"sensitive", "fill"}
    usage = spark.createDataFrame([(i, i < 2) for i in range(6)], "i bigint, a boolean")
    assert sorted(r["role"] for r in assembly.anchored_sample(usage, "i", "a", 5, 0.7, 3).collect()) == ["anchor"] * 2 + ["residual"] * 3


def test_previous_rows_across_blocks(spark):
    from rankloom.operators.places import with_previous

    rows = spark.createDataFrame([(i, "hot" if i % 7 else "k", f"v{i}") for i in range(60)] + [(99, None, "n")], "i bigint, k string, v string")
    got = {r["i"]: (r["a"], r["b"]) for r in with_previous(rows, "k", "i", {"a": ("v", 1), "b": ("v", 2)}, 8).filter("k IS NOT NULL").collect()}
    for key in ("hot", "k"):
        own = [i for i in range(60) if (i % 7 != 0) == (key == "hot")]
        for at, i in enumerate(own):
            assert got[i] == (f"v{own[at - 1]}" if at else None, f"v{own[at - 2]}" if at > 1 else None)


def test_paths(spark):
    rows = [(1, [["a", "b"], ["x", "y", "z"]], ["w", "ax"]), (2, [["a"], []], None), (3, [], ["q", None, ""])]
    df = spark.createDataFrame(rows, "i int, s array<array<string>>, w array<string>")
    got = {r["i"]: r["p"] for r in df.select("i", C.paths(F.col("s"), F.col("w"), 6).alias("p")).collect()}
    assert got == {1: ["ax", "bx", "ay", "az", "w"], 2: ["a"], 3: ["q"]}
