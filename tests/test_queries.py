"""Every query of the library against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from provenir.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows, columns):
    def shown(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return format(v, ".9g") if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    relation = duck.execute(ORACLES[name])
    columns = [c[0] for c in relation.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(relation.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_a_twin(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_the_library_does_not_need_the_optional_part():
    folder = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "provenir")
    for top, _, names in os.walk(folder):
        if os.path.basename(top) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(top, n)) as f:
                        text = f.read()
                    assert "provenir.llm" not in text and ".llm" not in text, n
