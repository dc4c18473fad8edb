import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rankloom.sources import archives, json_lines, pages, settings, tab_separated


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('﻿{"a": 1, "b": "x"}\n\n{"a": 2}\n', encoding="utf-8")
    assert [tuple(r) for r in json_lines.read_strict(spark, str(path), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    path.write_text('{"a": 1}\n[{"a": 2}]\nbroken\n', encoding="utf-8")
    with pytest.raises(Exception, match="not a JSON object"):
        json_lines.read_strict(spark, str(path), "a int").collect()
    assert json_lines.read_lenient(spark, str(path), "a int").count() == 1
    many = tmp_path / "b.json"
    many.write_text('[{"a": 1},\n {"a": 2}]', encoding="utf-8")
    assert json_lines.read_requests(spark, str(many), "a int").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", "r", ["a"], "c"), (None, "r", None, "")], "ts string, reading string, nbest array<string>, chosen string")
    bad = json_lines.append_log(df, str(tmp_path / "log"))
    assert bad.select("errors").collect()[0][0] == ["missing:ts", "missing:nbest", "missing:chosen"]
    assert json_lines.write_sorted(df, str(tmp_path / "out")) == 2
    assert spark.read.json(str(tmp_path / "log")).columns == ["chosen", "nbest", "reading", "ts"]
    entries = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "reading string, surface string")
    report = tab_separated.write_bundle(entries, str(tmp_path / "bundle"))
    assert (report["entries"], report["readings"]) == (3, 2) and report["entries_bytes"] > 0 and report["map_bytes"] > 0
    assert {r["metric"] for r in spark.read.json(str(tmp_path / "bundle" / "report.json")).collect()} == set(report)
    assert tab_separated.write_listing(entries, str(tmp_path / "list"), "reading") == 2
    tab_separated.write_keys(spark.createDataFrame([(1, "キー"), (2, "きー"), (3, "あ")], "o int, k string"), str(tmp_path / "keys"), "k", "o")
    assert [r[0] for r in spark.read.text(str(tmp_path / "keys")).collect()] == ["きー", "あ"]
    tab_separated.write_audit(spark.createDataFrame([(1, "a\tb\nc")], "i int, c string"), str(tmp_path / "audit"), "i", "c")


def test_ragged_lines(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("きー\ta\tb\n\nひとつ\nきー\tc\n", encoding="utf-8")
    assert {r["key"]: r["candidates"] for r in tab_separated.read_candidates(spark, str(path)).collect()} == {"きー": ["c"], "ひとつ": []}
    path.write_text("# 注\nきー\ta\nキー\ta\n", encoding="utf-8")
    assert tab_separated.read_dictionary(spark, str(path)).count() == 1
    path.write_text(json.dumps({"k": ["a", "b"]}), encoding="utf-8")
    assert tab_separated.read_map(spark, str(path)).count() == 2


def test_archives(spark, tmp_path):
    line = '01101,"060","0600000","ホッカイドウ","サッポロシ","アサヒマチ","北海道","札幌市","旭町"\n1,2\n'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ken.csv", line.encode("cp932"))
    (tmp_path / "ken.zip").write_bytes(buffer.getvalue())
    found = archives.postal_records(archives.read_zip_csv(spark, str(tmp_path / "ken.zip")))
    assert {r["surface"] for r in found.collect()} == {"北海道", "札幌市", "北海道札幌市", "旭町", "札幌市旭町"}
    (tmp_path / "w.txt").write_bytes("青空".encode("shift_jis"))
    assert archives.read_legacy_texts(spark, str(tmp_path / "w.txt")).first()["text"] == "青空"
    feed = "<rss><item><title>題</title><description>&lt;b&gt;" + "本文。" * 20 + "&lt;/b&gt;</description><link>l</link></item><item><title>短</title><link>m</link></item></rss>"
    (tmp_path / "f.xml").write_text(feed, encoding="utf-8")
    rows = archives.read_feed(spark, str(tmp_path / "f.xml")).collect()
    assert [r["doc_id"] for r in rows] == ["doc_00000"] and "<b>" not in rows[0]["text"]
    dump = "<feed><doc><title>Wikipedia: 山</title><abstract>" + "山は高い。" * 20 + "</abstract></doc><doc><title>Category:山</title><abstract>" + "分類。" * 40 + "</abstract></doc></feed>"
    (tmp_path / "d.xml").write_text(dump, encoding="utf-8")
    assert [r["title"] for r in archives.read_dump(spark, str(tmp_path / "d.xml")).collect()] == ["山"]


def test_pages(spark, tmp_path):
    for i, names in enumerate((["山", "川"], ["山"])):
        bindings = [{"label": {"value": n}, "kana": {"value": "よみ"}, "item": {"value": f"Q{i}"}} for n in names]
        (tmp_path / f"{i}.json").write_text(json.dumps({"results": {"bindings": bindings}}), encoding="utf-8")
    rows = {r["surface"]: r["qid"] for r in pages.read_pages(spark, f"{tmp_path}/{{page}}.json", 3).collect()}
    assert rows == {"山": "Q0", "川": "Q0"}
    slept = []
    with pytest.raises(OSError):
        pages.with_retries(lambda: (_ for _ in ()).throw(OSError("x")), 3, 1.0, sleep=slept.append)
    assert slept == [1.0, 2.0]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nA='1'\nbad\nB=2\n")
    env = settings.read_env(str(tmp_path / ".env"))
    assert env == {"A": "1", "B": "2"}
    assert settings.resolve("A", None, {"A": "9"}, env) == "9" and settings.resolve("A", "7", {}, env) == "7"
    (tmp_path / "p.json").write_text('{"tau": 1.5}')
    assert settings.read_policy(str(tmp_path / "p.json"), {"RANKLOOM_CAND_CAP": "5"}) | {} == settings.POLICY | {"tau": 1.5, "cand_cap": 5}
    settings.ensure_public("/data", "/data/a/b.json")
    for path in ("/data/usage/x", "/data/a.log", "/other/x"):
        with pytest.raises(ValueError):
            settings.ensure_public("/data", path)


def test_contexts_and_benchmark(spark):
    df = spark.createDataFrame([("w", "あ" * 50, 2), ("w", "い" * 50, 1), ("w", "あ" * 50, 3), ("v", "短", 1)], "w string, c string, o int")
    assert [r["text"] for r in archives.context_documents(df, "w", "c", "o").collect()] == ["い" * 50 + "。" + "あ" * 50]
    rows = spark.createDataFrame([("k", "g", None, None), (None, None, "現在の入力: よみ\n既存候補（これら以外を提案）: a, b\n", "x\ny")], "key string, gold string, input string, output string")
    assert [tuple(r) for r in json_lines.benchmark_rows(rows).collect()] == [("k", "g", []), ("よみ", "x", ["a", "b"])]
    nested = spark.createDataFrame([(1, ("s", "r"))], "i int, record struct<surface: string, reading: string>")
    assert json_lines.records(nested).columns == ["i", "surface", "reading"]


def test_private_paths():
    settings.ensure_public("data/staged", "data/staged/train.json,data/staged/eval.json")
    settings.ensure_public(None, "anywhere/model", "")
    for path in ("data/private/x", "a/personal-v1", "a/usage30m", "x/ime_usage_pairs.json", "x/conversion.LOG", "b/chat/y", "c\\secret\\z", "d/rerank-requests", "e/conversion-log/f", "data/staged/a.json,data/staged/secret.json"):
        with pytest.raises(ValueError):
            settings.ensure_public(None, path)
    for path in ("data/other/x.json", "data/staged/../other.json"):
        with pytest.raises(ValueError):
            settings.ensure_public("data/staged", path)


def test_postal_rules(spark):
    rows = [(0, ["1", "2", "3", "アキタケン", "アキタシ", "ナカチョウ", "秋田県", "秋田市", "中町"]), (1, ["1", "2", "3", "アキタケン", "アキタシ", "バンチガクルバアイ", "秋田県", "秋田市", "番地がくる場合"]), (2, ["1", "2", "3", "アキタケン", "アキタシ", "ヒガシ", "秋田県", "秋田市", "東(1~3)"]), (3, ["1", "2", "3", "ﾐﾔｷﾞｹﾝ", "センダイシ", "ニシ", "宮城県", "仙台市", "ＡＢ"])]
    found = {r["surface"] for r in archives.postal_records(spark.createDataFrame(rows, "line bigint, fields array<string>")).collect()}
    assert found == {"秋田県", "秋田市", "秋田県秋田市", "中町", "秋田市中町", "宮城県", "仙台市", "宮城県仙台市", "AB", "仙台市AB"}
