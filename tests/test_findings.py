"""Gates on words, frameworks, rejections, coerced answers and export gates on the cases worked out by hand."""

import duckdb
import pytest
from findings_cases import CASES
from test_queries import plain


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    f, sql = CASES[name]
    df = f(lambda _: spark.range(1))
    want = duckdb.sql(sql)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)
