import unicodedata

import pytest
from oracle import check, connect
from pyspark.sql import functions as F

from rankloom.llm import lookalike as look
from rankloom.llm import p1_lookalike as p1

SAME = [
    ("カメラ", "力メラ"), ("タワー", "夕ワー"), ("ビール", "ビ一ル"), ("ニュース", "二ュ―ス"), ("ロボット", "口ボット"), ("オペラ", "才ペラ"), ("ハーバー", "八ーバ−"), ("エネルギー", "工ネルギ—"),
    ("へら", "ヘら"), ("が", "が"), ("バス", "ﾊﾞｽ"), ("Café", "Café"), ("PARK", "РАRК"), ("ΝΕΧΤ", "NEXT"), ("人", "⼈"), ("民", "⺠"), ("金", "金"), ("a b", "a　b"), ("a​b", "ab"), ("葛\U000e0100", "葛"),
    ("１００", "100"), ("ﬁ", "fi"), ("か​゙", "が"), ("カ", "力"), ("Plus", "Ｐｌｕｓ"), ("­字", "字"),
]
OTHER = [("ツ", "ッ"), ("ハ", "バ"), ("学", "學"), ("センター", "センタ"), ("Cafe", "Café"), ("a", "A"), ("²", "2"), ("①", "1"), ("シ", "ツ"), ("ン", "ソ"), ("大", "犬"), ("り", "い")]


def forms(spark, texts):
    return {r["v"]: r["form"] for r in look.canonical_map(spark.createDataFrame([(x,) for x in texts], "x string"), "x").collect()}


def test_same_and_other(spark):
    texts = sorted({x for pair in SAME + OTHER for x in pair})
    form = forms(spark, texts)
    assert [p for p in SAME if form[p[0]] != form[p[1]]] == []
    assert [p for p in OTHER if form[p[0]] == form[p[1]]] == []


def test_forms_are_stable_and_agree_with_nfkc(spark):
    plain = ["ｱﾊﾞｰﾄ", "Ａｂｃ", "漢字かな", "é"]
    form = forms(spark, plain)
    assert all(form[x] == unicodedata.normalize("NFKC", x) for x in plain)
    again = forms(spark, list(form.values()))
    assert all(again[x] == x for x in form.values())


def test_members_and_candidates(spark):
    rows = [(1, "カメラ"), (2, "力メラ"), (3, "カメラ"), (4, "山"), (5, None), (6, "山"), (7, ""), (8, "字" * 50_000), (9, "　字" + "字" * 49_999)]
    df = spark.createDataFrame(rows, "id bigint, surface string").withColumn("salt", F.lit(1)).withColumn("v", F.lit("x"))
    assert sorted(r[0] for r in look.lookalike_members(df, "id", "surface").collect()) == [1, 2, 3, 8, 9]
    assert look.lookalike_members(df.limit(0), "id", "surface").count() == 0
    lists = [(1, "バス", ["ﾊﾞｽ", "バス"]), (2, "バス", ["バス", None, ""]), (3, None, ["a"]), (4, "a", None), (5, "a", []), (6, "山", ["川", "山​", "山​"])]
    df = spark.createDataFrame(lists, "id bigint, gold string, nbest array<string>")
    assert sorted(r[0] for r in look.lookalike_candidates(df, "id", "gold", "nbest").collect()) == [1, 6]
    assert look.lookalike_candidates(df.limit(0), "id", "gold", "nbest").count() == 0


@pytest.mark.parametrize("name", sorted(p1.SQL))
def test_query_equals_its_sql(spark, folder, name):
    check(spark, connect(folder), folder, p1.QUERIES[name], p1.SQL[name])
