from pyspark.sql import functions as F

from rankloom.llm import sampling
from rankloom.session import materialize

CELLS = ["a", "b"]


def run(spark, rows, targets):
    df = spark.createDataFrame(rows, "id bigint, a boolean, b boolean").withColumn("quota", F.lit(1)).withColumn("_h", F.lit(0))
    goal = spark.createDataFrame(targets, "set_id int, a boolean, b boolean, share double, fraction double, least int")
    quotas = materialize(sampling.cell_quotas(df, goal, "set_id", CELLS, "share", "fraction", "least"))
    ranked = materialize(sampling.rank_rows(df, "id", CELLS, 200_000))
    sample = materialize(sampling.systematic_sample(ranked, quotas, "id", "set_id", CELLS))
    return quotas, sampling.repair_floors(sample, ranked, quotas, "id", "set_id", CELLS).collect()


def test_shares_floors_and_report(spark):
    rows = [(i, i % 10 < 7, None if i % 10 == 9 else i % 2 == 0) for i in range(1000)]
    targets = [(1, True, True, 0.25, 0.2, 5), (1, True, False, 0.25, 0.2, 5), (1, False, True, 0.25, 0.2, 5), (1, False, False, 0.25, 0.2, 5), (2, True, True, 0.9, 0.9, 5), (2, False, False, 0.001, 0.9, 40), (2, None, False, 0.0, 0.1, 5000)]
    quotas, sample = run(spark, rows, targets)
    assert len({(r["set_id"], r["id"]) for r in sample if r["set_id"] == 1}) == sum(r["set_id"] == 1 for r in sample) == 200
    count = lambda s, a, b: sum((r["set_id"], r["a"], r["b"]) == (s, a, b) for r in sample)
    assert [count(1, a, b) for a in (True, False) for b in (True, False)] == [50] * 4
    assert count(2, True, True) == sum(bool(a and b) for _, a, b in rows)
    assert [tuple(r)[:3] for r in quotas.filter("short").orderBy("set_id", "a").collect()] == [(2, False, False), (2, True, True)]


def test_defined_cases(spark):
    quotas, sample = run(spark, [], [(1, True, True, 1.0, 0.5, 5)])
    assert sample == [] and quotas.first()["short"]
    quotas, sample = run(spark, [(1, True, True), (1, True, True), (None, True, True)], [(1, True, True, 1.0, 1.0, 0), (1, False, True, 0.0, 1.0, 0)])
    assert len(sample) == 2


def test_floor_repair_takes_unsampled_rows(spark):
    _, sample = run(spark, [(i, i < 30, False) for i in range(3000)], [(1, True, False, 0.001, 0.5, 20), (1, False, False, 0.999, 0.5, 0)])
    small = [r["id"] for r in sample if r["a"]]
    assert len(small) == len(set(small)) == 20
