import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm import components
from rankloom.llm.p2_components import SHARES, source_key
from rankloom.functions.text import key_norm


def union_find(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, r in pairs:
        parent[root(("s", s))] = root(("r", r))
    groups = defaultdict(set)
    for s, _ in pairs:
        groups[root(("s", s))].add(s)
    return {frozenset(g) for g in groups.values()}


CASES = {
    "random": [(random.Random(5).randint(0, 60) if False else i * 7 % 61, i * 13 % 90) for i in range(110)],
    "path": [(i, i) for i in range(40)] + [(i + 1, i) for i in range(39)],
    "star": [(i, 0) for i in range(60)] + [(100, 1)],
    "hot source": [(0, i) for i in range(60)] + [(i, i) for i in range(1, 30)],
    "single": [(1, 1)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("small", [0, components.SMALL])
def test_components(spark, name, small):
    edges = spark.createDataFrame(CASES[name], "s bigint, r bigint").distinct()
    found = defaultdict(set)
    for row in components.components(edges, small).collect():
        found[row["root"]].add(row["s"])
    assert {frozenset(g) for g in found.values()} == union_find(CASES[name])


ROWS = [
    (1, "A:1", "あ"), (2, " ａ:1 ", "い"), (3, "B:2", "イ"), (4, None, "い"), (5, "C:3", None), (6, None, None), (7, None, None), (8, "D:4", "う"), (9, None, "え・"), (10, None, "エ"), (11, "c:3", "お"), (12, "", "か"), (13, " ", "き"),
]


def test_rules_and_split(spark):
    df = spark.createDataFrame(ROWS, "row_id bigint, source string, reading string").withColumn("n", F.lit(1)).withColumn("s", F.lit("x"))
    pairs = components.keyed_pairs(df, "source", "reading", source_key, key_norm)
    assert sorted(tuple(r) for r in components.source_groups(pairs).collect()) == [("a:1", "a:1"), ("b:2", "a:1")]
    split = {r["row_id"]: r for r in components.split_rows(df, pairs, "row_id", "source", "reading", SHARES).collect()}
    assert sorted(split) == list(range(1, 14))
    same = lambda *ids: len({split[i]["component"] for i in ids}) == 1 and len({split[i]["split"] for i in ids}) == 1
    assert same(1, 2, 3, 4) and same(5, 11) and same(9, 10) and same(12, 13)
    assert split[6]["component"] != split[7]["component"]
    empty = df.limit(0)
    none = components.keyed_pairs(empty, "source", "reading", source_key, key_norm)
    assert components.source_groups(none).count() == 0
    assert components.split_rows(empty, none, "row_id", "source", "reading", SHARES).count() == 0


def test_a_source_with_null_readings_only(spark):
    rows = [(1, "E:5", None), (2, "e:5", None), (3, " E:5 ", None), (4, "F:6", None), (5, "G:7", "あ")]
    df = spark.createDataFrame(rows, "row_id bigint, source string, reading string")
    pairs = components.keyed_pairs(df, "source", "reading", source_key, key_norm)
    split = {r["row_id"]: r for r in components.split_rows(df, pairs, "row_id", "source", "reading", SHARES).collect()}
    assert sorted(split) == [1, 2, 3, 4, 5] and all(r["split"] in SHARES for r in split.values())
    assert len({split[i]["component"] for i in (1, 2, 3)}) == 1 and len({split[i]["split"] for i in (1, 2, 3)}) == 1
    assert len({split[i]["component"] for i in (1, 4, 5)}) == 3


def test_shares_with_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") / 4).cast("int"))).alias("source"), F.col("id").cast("string").alias("reading"))
    pairs = components.keyed_pairs(df, "source", "reading", source_key, key_norm)
    counts = {r["split"]: r["n"] for r in components.split_rows(df, pairs, "row_id", "source", "reading", SHARES).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert all(abs(counts[k] / 3000 - v) < 0.01 for k, v in SHARES.items())
