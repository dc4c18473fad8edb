import random
import unicodedata

from pyspark.sql import functions as F

from rankloom.llm import overlap, p3_overlap
from rankloom.session import read_table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute(left, right):
    def norm(r):
        reading = "".join(unicodedata.normalize("NFKC", r[2]).split()).replace("・", "")
        reading = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in reading)
        context = "".join(unicodedata.normalize("NFKC", r[3] or "").split())
        return reading + context, context == ""

    out = set()
    for a in left:
        for b in right:
            if None in (a[1], a[2], b[1], b[2]) or unicodedata.normalize("NFKC", a[1]).strip() != unicodedata.normalize("NFKC", b[1]).strip():
                continue
            (x, p), (y, q) = norm(a), norm(b)
            if p == q and distance(x, y) * 8 <= max(len(x), len(y)):
                out.add((a[0], b[0]))
    return out


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(chars) + 1), rng.random()
        if kind < 0.4 and at < len(chars):
            chars[at] = rng.choice("あいうえお漢字")
        elif kind < 0.7:
            chars.insert(at, rng.choice("あいうえお漢字"))
        elif at < len(chars) and len(chars) > 1:
            del chars[at]
    return "".join(chars)


SCHEMA = "id bigint, gold string, reading string, context string"


def test_no_pair_is_lost(spark):
    rng = random.Random(8)
    left, right = [], []
    for i in range(60):
        size = rng.choice([3, 8, 15, 16, 17, 24, 40, 56, 80])
        text = "".join(rng.choice("あいうえおかきくけこ漢字文章、" if i % 3 else "ああい") for _ in range(size))
        left.append((i, f"g{i % 4}", text[:3], text[3:]))
        for k in range(5):
            other = edited(rng, text, rng.randint(0, size // 8 + 1))
            right.append((1000 + 10 * i + k, f"g{i % 4}", other[:3] or "x", other[3:]))
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    found = {(r["left_id"], r["right_id"]) for r in overlap.near_pairs(a, b, "id", "gold", "reading", "context").collect()}
    assert found == brute(left, right)


def test_defined_cases(spark):
    left = [(1, "力", "よみ", "文脈"), (2, "力", None, "文脈"), (3, None, "よみ", "文脈"), (4, "g", "よみ", None), (5, "g", "よみ", "　"), (6, "long", "よ", "長い文" * 3000), (1, "力", "よみ", "文脈")]
    right = [(11, "カ", "ヨ・ミ", "文 脈"), (12, "カ", "よみ", "文脈"), (13, "g", "よみ", ""), (14, "g", "よみ", "み"), (15, "long", "よ", "長い文" * 2999 + "終わり"), (16, "other", "よみ", "文脈")]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    pairs = sorted((r["left_id"], r["right_id"]) for r in overlap.near_pairs(a, b, "id", "gold", "reading", "context").collect())
    assert pairs == [(1, 11), (1, 11), (1, 12), (1, 12), (4, 13), (5, 13), (6, 15)]
    assert overlap.near_pairs(a.limit(0), b, "id", "gold", "reading", "context").count() == 0


def test_chunks_follow_content():
    text = "これは内容で切られる文章の例です。長さは様々に変わります。"
    assert sum(overlap.chunk_lengths(text)) == len(text)
    assert sum(overlap.chunk_lengths(text, window=4, mask=7)) == len(text)
    shared = set(overlap.chunks(text)) & set(overlap.chunks("前置き" + text))
    assert sum(n for n, _ in shared) >= len(text) - 2 * overlap.WINDOW - 4


def test_an_edit_changes_few_chunks():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("あいうえおかきくけこ漢字文章、") for _ in range(rng.randint(1, 60)))
        edits = rng.randint(1, 3)
        other = edited(rng, text, edits)
        kept = {x[1] for x in overlap.chunks(text)} & {x[1] for x in overlap.chunks(other)}
        assert len(kept) >= len(overlap.chunks(text)) - (overlap.WINDOW + 1) * edits


def test_record_fractions(spark):
    left = [(1, "g", "よみ", "同じ文脈の例文です"), (2, "g", "よみ", "似た所のない別の行"), (3, "h", "", ""), (4, "g", "・", None), (5, "h", "・", "")]
    right = [(11, "g", "よみ", "同じ文脈の例文です"), (12, "h", "　", ""), (13, "g", "ヨミ", "同じ文脈の例文です")]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    found = overlap.near_classes(a, b, "id", "gold", "reading", "context")
    rows = {r["id"]: r["fraction"] for r in found.left.join(overlap.record_fractions(found), "class").collect()}
    assert rows[1] == 1.0 and rows[2] < 1.0 and rows[3] == rows[5] == 1.0 and rows[4] == 0.0
    assert sorted(tuple(r) for r in overlap.near_pairs(a, b, "id", "gold", "reading", "context").collect()) == [(1, 11, 0), (1, 13, 0), (3, 12, 0), (5, 12, 0)]


def test_report_equals_the_rows(spark, folder):
    counts = {(r["split_name"], r["train_source"]): (r["pairs"], r["holdout_rows"]) for r in p3_overlap.p3_report(spark, folder).collect()}
    pairs = p3_overlap.p3_found(spark, folder)
    pairs = pairs.join(read_table(spark, folder, "holdout").select(F.col("row_id").alias("holdout_id"), "split_name"), "holdout_id").join(read_table(spark, folder, "train").select(F.col("row_id").alias("train_id"), F.col("source").alias("train_source")), "train_id")
    rows = pairs.groupBy("split_name", "train_source").agg(F.count("*").alias("n"), F.countDistinct("holdout_id").alias("h")).collect()
    assert counts == {(r["split_name"], r["train_source"]): (r["n"], r["h"]) for r in rows}
    assert counts or folder.endswith("0.001")
