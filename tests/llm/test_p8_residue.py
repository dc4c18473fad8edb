import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import p8_residue, residue
from rankloom.session import read_table

ARTICLE = "霧沢の店主によれば地図は八十年前の記録で、窓口を整えるには予算が欠かせない。"
CASES = {
    "placeholder": [
        f"{ARTICLE}鷺崎の貨物は{{{{surface}}}}によって作られた。", f"{ARTICLE}このたびは｛｛ title ｝｝をご利用いただき", f"{ARTICLE}本日の原稿は%city%件でした。", f"{ARTICLE}${{name}} 様", f"{ARTICLE}開催日は<%= surface %>、会場は",
        f"{ARTICLE}<<PLACE>>では", f"{ARTICLE}[[reading]]によって", f"{ARTICLE}__city__の校正", f"{ARTICLE}＜日付をここに挿入＞", f"{ARTICLE}［店名未設定］では", f"{ARTICLE}（料金を記入してください）まで", f"{ARTICLE}#{{x.y}}を",
        f"{ARTICLE}著者: undefined　所在地: undefined", f"{ARTICLE}価格はNaN円、在庫はnull個です。", f"{ARTICLE}更新日: Invalid Date", f"{ARTICLE}分類: [object Object]", f"{ARTICLE}（nullページ）を参照", "undefinedさんが投稿しました。", f"{ARTICLE}{{item_count}}の",
    ],
    "error": ["404 Not Found", "HTTP 500。しばらくしてから再度お試しください。", "エラーコード：５０４\nホーム ＞ 記事一覧", "お探しのページは見つかりませんでした。", "Too Many Requests（429）", "メニュー　検索 Request ID: 1a2b3c4d ページの先頭へ Unauthorized", "このサイトは現在メンテナンス中です。ご不便をおかけします。"],
    "script": ["Please enable JavaScript to read this page.", "この欄の閲覧にはJava Scriptの有効化が必要です。", "Ｐｌｅａｓｅ ｅｎａｂｌｅ ＪａｖａＳｃｒｉｐｔ", "スクリプトが無効になっています。ブラウザの設定をご確認ください。"],
    "filler": ["この文章はダミーです。ここにテキストが入ります。", "■■■■■■■■。△△△△△△。", "lorem ipsum dolor sit amet", f"{ARTICLE}\n" + "サンプルテキスト。" * 20, "ああああああああ。テストテストテスト。"],
}
ARTICLES = [
    ARTICLE, f"{ARTICLE}差し込み印刷では、{{{{title}}}}のような記法で位置を示す。", f"{ARTICLE}設定では${{HOME}}のように書くと展開される。", f"{ARTICLE}書式指定の %s は文字列、%d は整数を表すと説明した。", f"{ARTICLE}集合 {{a, b}} と {{c}} の和を説く。",
    f"{ARTICLE}undefinedとnullの違いを解説している。", f"{ARTICLE}「ページが見つかりません」という表示を言い換えてみせた。", f"{ARTICLE}JavaScriptを使った入力画面は採用された。", f"{ARTICLE}ダミーの文章で版面を確かめる習慣は続く。", f"{ARTICLE}湾同合（わんどうごう）は[[湾同合|変換]]に由来する[7]。",
    f'{ARTICLE}\n{{"reading": "あ", "body": null}}', f"{ARTICLE}メンテナンス中の農園を見学した。", "hit@1 は 34.6%、悪化は 0.08% だった。" + ARTICLE, "Please enable JavaScript to read this page.\n" + ARTICLE + "汐見の住民は天気を眺めた。春先の朝市では陶器と織物を並べていて、係員は名簿を確かめた。",
]


@pytest.mark.parametrize("kind", CASES)
def test_cases(kind):
    assert [x for x in CASES[kind] if residue.evidence(x, set()) != kind] == []


def test_articles():
    assert [x for x in ARTICLES if residue.evidence(x, set())] == []


def test_boilerplate_is_subtracted():
    text = "Please enable JavaScript to read this page.\n題"
    assert residue.evidence(text + "\n" + ARTICLE, {0, 1}) is None
    assert residue.evidence(text, {0, 1}) == "script"


def test_operator(spark):
    texts = [x for own in CASES.values() for x in own] + ARTICLES
    rows = [(i, t, "https://h.example/x", "s") for i, t in enumerate(texts)] + [(500, None, None, None), (501, "", "odd", "s"), (502, CASES["error"][0], None, None), (502, CASES["error"][0], "::", None), (503, "長い文章。" * 30_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string, source string").withColumn("line", F.lit("x")).withColumn("host", F.lit("y"))
    found = {r["doc_id"] for r in residue.residue(df, "doc_id", "text", "url", "source").collect()}
    n = sum(map(len, CASES.values()))
    assert found == {*range(n), 502, 503}
    assert residue.residue(df.limit(0), "doc_id", "text", "url", "source").count() == 0


SHORT = [
    "ﾀﾞﾐｰﾃｷｽﾄです。", "ﾒﾝﾃﾅﾝｽ中です。", "この欄はｽｸﾘﾌﾟﾄを有効にしてください。", "Sorry, the page you are looking for has moved.", "Fatal error: out of memory", "PHP Notice: x", "Trace ID: abc9", "URLの入力に誤りはありませんか", "This happens automatically.", "-----------", "ほげほげほげほげ", "よよよよよよ",
    "お探しのページを表示できません。", "ｴﾗｰが発生しました", "Bad Gateway", "読み込み中", "てすとてすと", "undefinedさん",
]


def test_whatever_is_found_is_a_suspect():
    assert [x for x in SHORT if not residue.evidence(x, set())] == []
    rng, every = random.Random(12), [x for own in CASES.values() for x in own] + ARTICLES + SHORT
    for _ in range(3000):
        parts = [rng.choice(every) for _ in range(rng.randint(1, 4))]
        text = rng.choice(["\n", "", "。", "\r\n"]).join(x[rng.randrange(3) :] if rng.random() < 0.3 else x for x in parts)
        recurrent = {i for i in range(text.count("\n") + 1) if rng.random() < 0.5}
        if residue.evidence(text, recurrent):
            assert residue.suspect(text), text


def test_guards_lose_no_slot():
    for text in [x for own in CASES.values() for x in own]:
        folded = residue.fold(text)
        assert residue.has_slot(folded) == bool(residue.OPEN_SLOT.search(folded) or residue.EMPTY_VALUE.search(folded))


def test_slots_of_boilerplate_are_subtracted():
    text = "著者は${name}です\n" + ARTICLE
    assert residue.evidence(text, set()) == "placeholder" and residue.evidence(text, {0}) is None


def test_every_record_is_judged(spark, folder):
    found = {r["doc_id"] for r in p8_residue.p8_found(spark, folder).collect()}
    every = read_table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", "text").collect()
    assert found == {r["doc_id"] for r in every if residue.evidence(r["text"], set())}
    kept = {r["doc_id"] for r in p8_residue.p8_clean(spark, folder).select("doc_id").collect()}
    assert not kept & found
