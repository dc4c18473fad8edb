import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import pii, pii_labels
from rankloom.llm.crf import Crf
from rankloom.llm.pii_labels import KINDS, labelled_table
from rankloom.session import read_table

PARTS = [
    ("family", "霧沢", "きりさわ", "kirisawa"), ("family", "灯田", "ともだ", "tomoda"), ("family", "萩渡", "はぎと", "hagito"), ("family", "茜原", "あかねはら", "akanehara"),
    ("given", "澄人", "すみと", "sumito"), ("given", "汐音", "しおね", "shione"), ("given", "榛名子", "はるなこ", "harunako"), ("given", "紗環", "さわ", "sawa"),
]


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(PARTS)


def test_held_out_accuracy(tagger):
    right, wrong, missed = Counter(), Counter(), Counter()
    table = labelled_table(PARTS, 1500, seed=99)
    for (text, spans), found in zip(table, tagger.tag([t for t, _ in table]), strict=True):
        wanted, got = {k for *_, k in spans}, {k for *_, k in found}
        for kind in KINDS:
            right[kind] += kind in wanted & got
            wrong[kind] += kind in got - wanted
            missed[kind] += kind in wanted - got
    for kind in KINDS:
        assert right[kind] / (right[kind] + missed[kind]) > 0.95, kind
        assert right[kind] / (right[kind] + wrong[kind]) > 0.95, kind


#: Sentences of another hand than the training table's, with the kinds they hold.
WRITTEN = [
    ("山内さんと駅で待ち合わせた", {"name"}), ("先ほど霧沢 澄人様がお見えになりました", {"name"}), ("請求は森川殿にまわしてあります", {"name"}), ("トモダ・シオネの写真展", {"name"}), ("Ms. Ogata will join later", {"name"}), ("Harunako Hagito の講演", {"name"}), ("受取人氏名：須賀正彦", {"name"}),
    ("bcc に k-ota22@shop.example.org を追加", {"email"}), ("taro (at) example (dot) com です", {"email"}), ("不在時は 075-431-0987 に", {"phone"}), ("内線ではなく０９０１２３４５６７８に", {"phone"}), ("夜間窓口 (06)6123-9876", {"phone"}),
    ("届いた通知の個人番号は 4821 0093 7712", {"id_number"}), ("渡航に使う旅券番号：MZ8841290", {"id_number"}), ("被保険者番号 00918273 とある", {"id_number"}), ("長野県茅野市本町3丁目14番2号に本社がある", {"address"}), ("〒604-8001 京都市中京区木屋町7-12", {"address"}), ("12-4-3 Nishiki-cho, Kirisawa-shi, Japan", {"address"}),
    ("仕様書は皆様のお手元に", set()), ("霧沢駅を降りて左", set()), ("萩渡では祭りが始まる", set()), ("ご注文番号 250981120934 を控える", set()), ("荷物の追跡番号 4410-2298-7731", set()), ("神様はサイコロを振らない", set()), ("会議は2031年4月12日 13:30から", set()), ("2丁目の薬局", set()), ("同様の例が多様にある", set()), ("問い合わせ番号は000012345678", set()),
]


def test_sentences_of_another_hand(tagger):
    right, found, wanted = 0, 0, 0
    for (_, kinds), spans in zip(WRITTEN, tagger.tag([t for t, _ in WRITTEN]), strict=True):
        got = {k for *_, k in spans}
        right, found, wanted = right + len(got & kinds), found + len(got), wanted + len(kinds)
    assert right / wanted >= 0.9 and right / found >= 0.9


def test_no_training_fragment_is_in_the_data(spark):
    texts = "\n".join(x for f in ("context_prev", "chosen") for x in read_table(spark, "/root/testdata/sf0.1", "rerank_smoke").select(f).dropna().distinct().toPandas()[f])
    held = [pii_labels.CARRIERS, pii_labels.DECOYS, pii_labels.PROSE, "\n".join([*pii_labels.QUARTERS, *pii_labels.HOUSES, *pii_labels.NOBODY])]
    fixed = {part for piece in held for part in re.split(r"<\w+>|\n", piece)}
    assert not [part[i : i + 8] for part in fixed for i in range(len(part) - 7) if part[i : i + 8] in texts]


def test_redaction_keeps_the_rest(tagger):
    text = "連絡はk.sawa@example.comまで、電話番号が090-1234-5678に変わったので霧沢澄人様へ"
    spans = tagger.tag([text])[0]
    out = pii.redact(text, spans)
    assert {k for *_, k in spans} == {"email", "phone", "name"}
    assert out == "連絡は[EMAIL]まで、電話番号が[PHONE]に変わったので[NAME]様へ"
    rest = text
    for start, end, _ in reversed(spans):
        rest = rest[:start] + rest[end:]
    for placeholder in pii.PLACEHOLDERS.values():
        out = out.replace(placeholder, "")
    assert out == rest


def test_no_cases(tagger):
    texts = ["注文番号123456789012の荷物を", "4丁目の角を曲がって", "お客様の声を", "神様の話を", "@霧沢のつぶやきを", "2026-03-16の会議で", "霧沢の店主によれば地図は73年前の記録で", "", None]
    assert [x for x in tagger.tag(texts) if x] == []


def test_columns(spark):
    rows = [(1, "担当の霧沢様に", None), (2, "", "旅券番号 TK1234567"), (3, None, None), (1, "担当の霧沢様に", None), (4, "長い文。" * 20_000 + "連絡はa@example.comまで", "x")]
    df = spark.createDataFrame(rows, "log_id bigint, a string, b string").withColumn("kind", F.lit("x"))
    blob = pii.tagger_bytes(tuple(PARTS))
    found = sorted(tuple(r) for r in pii.found_kinds(df, "log_id", ["a", "b"], blob).collect())
    assert found == [(1, "a", "name"), (1, "a", "name"), (2, "b", "id_number"), (4, "a", "email")]
    out = {r["log_id"]: r for r in pii.redacted(df, "log_id", ["a", "b"], blob).collect()}
    assert out[1]["a"] == "担当の[NAME]様に" and out[3]["a"] is None and out[2]["b"] == "旅券番号 [ID_NUMBER]"
    assert pii.found_kinds(df.limit(0), "log_id", ["a", "b"], blob).count() == 0


def test_long_texts_are_tagged_whole(tagger):
    some = "霧沢澄人様へ。電話 090-1234-5678、"
    for before in (0, 3990, 4000, 4010, 9000):
        text = "あ" * before + some + "い" * 6000 + some
        spans = [(text[a:b], k) for a, b, k in tagger.tag([text])[0]]
        assert spans == [("霧沢澄人", "name"), ("090-1234-5678", "phone")] * 2
    assert pii.pieces(1) == [(0, 1, 0, 1)]
    for n in (5999, 6000, 6001, 50_000):
        assert [x[2] for x in pii.pieces(n)][1:] == [x[3] for x in pii.pieces(n)][:-1] and pii.pieces(n)[-1][3] == n


def test_one_long_text_in_a_batch_stays_small(tagger):
    tracemalloc.start()
    tagger.tag(["担当の霧沢様に渡す"] * 1500 + ["霧沢様" * 5000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_too_many_name_parts_are_refused(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_PARTS", 3)
    rows = spark.createDataFrame([("family", str(i), None, None) for i in range(4)], "kind string, written string, kana string, romaji string")
    with pytest.raises(ValueError):
        pii.name_parts(rows)
    assert len(pii.name_parts(rows.limit(3))) == 3


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    model = Crf(3, 16)
    model.moves = rng.normal(size=(4, 3)).astype(np.float32)
    lengths = np.array([1, 4, 3, 0, 4])
    scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
    got, at = model.decode(scores, lengths), 0
    for n in lengths:
        own = scores[at : at + n]

        def total(path):
            return sum(own[i][p] + model.moves[3 if i == 0 else path[i - 1]][p] for i, p in enumerate(path))

        if n:
            assert total(tuple(got[at : at + n])) == pytest.approx(max(total(p) for p in np.ndindex(*[3] * n)), abs=1e-5)
        at += n


def test_certain_sequences_have_only_zeros():
    rng = np.random.default_rng(4)
    model = Crf(3, 16)
    model.moves = rng.normal(size=(4, 3)).astype(np.float32)
    model.moves[0, 0] += 2
    lengths = rng.integers(1, 5, 400)
    scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32) * 3
    scores[:, 0] += 4
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    certain = model.certain(scores, starts)
    assert certain.any() and not certain.all()
    for s, n in zip(starts[certain], lengths[certain], strict=True):
        own = scores[s : s + n]
        total = {p: sum(own[i][x] + model.moves[3 if i == 0 else p[i - 1]][x] for i, x in enumerate(p)) for p in np.ndindex(*[3] * int(n))}
        assert max(total, key=total.get) == (0,) * int(n)


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    lengths, features, gold = np.array([3, 2]), rng.integers(0, 6, (5, 2)), rng.integers(0, 3, 5)
    starts, positions = np.array([0, 3]), np.arange(5)
    model = Crf(3, 6)
    model.weights, model.moves = rng.normal(size=(6, 3)).astype(np.float32), rng.normal(size=(4, 3)).astype(np.float32)

    def likelihood():
        scores, value = model.emissions(features).astype(float), 0.0
        for s, n in zip(starts, lengths, strict=True):
            def total(path, s=s):
                return sum(scores[s + i][p] + model.moves[3 if i == 0 else path[i - 1]][p] for i, p in enumerate(path))
            value += total(gold[s : s + n]) - np.log(sum(np.exp(total(p)) for p in np.ndindex(*[3] * n)))
        return value

    _, by_move = model._gradient(features, gold, starts, lengths, positions)
    base = likelihood()
    for i, j in [(0, 1), (2, 2), (3, 0)]:
        model.moves[i, j] += 0.01
        assert (likelihood() - base) / 0.01 == pytest.approx(by_move[i, j], abs=0.02)
        model.moves[i, j] -= 0.01
