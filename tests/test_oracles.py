import pytest
from oracle import check, connect

from rankloom.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, folder, name):
    check(spark, con, folder, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", [x for x in sorted(SQL) if x.startswith("assemble")] + ["usage_mix"])
def test_assembly_at_a_larger_scale(spark, name):
    larger = "/root/testdata/sf0.01"  # the smallest tables hardly have more rows than the reserve
    check(spark, connect(larger), larger, registry.queries()[name], SQL[name])


def test_sensitive_rows_have_their_share(spark):
    rows = registry.queries()["assemble_train"](spark, "/root/testdata/sf0.01").filter("NOT corrupted").collect()
    assert 0.3 <= sum(r["role"] == "sensitive" for r in rows) / len(rows) <= 0.4


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "margin_sweep" in entry.queries()
