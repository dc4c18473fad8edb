import re

import pytest
from oracle import check, connect

from rankloom.llm import registry

SQL = registry.oracle_sql()


def test_names():
    names = registry.queries()
    assert {int(re.match(r"p(\d)_", n)[1]) for n in names} == set(range(1, 9))
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p1_found", "tbl string, row_key bigint"), ("p2_found", "source_key string, group_key string"), ("p3_found", "holdout_id bigint, train_id bigint"),
        ("p4_found", "log_id bigint, field_name string, kind string"), ("p5_found", "set_id bigint, context_sensitive string, gold_in_nbest string"), ("p8_found", "doc_id bigint"),
    ],
)
def test_columns_and_distinct_rows(spark, folder, name, columns):
    found = registry.queries()[name](spark, folder)
    assert [(c, t) for c, t in found.dtypes] == [tuple(x.split()) for x in columns.split(", ")]
    assert found.count() == found.distinct().count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    check(spark, connect(folder), folder, registry.queries()[name], SQL[name])
