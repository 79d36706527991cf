"""The gates over a table of documents: every document under every measure, every gate with its words."""

import duckdb
import pytest
from findings_cases import _BASE, _CASES, _MEASURES
from test_queries import plain

from provenir.catalog import ORACLES, QUERIES
from provenir.functions.provisions import BASE, MEASURES, PROVISIONS

N = len(_CASES)
LINES = ["", "A foreign operator must not export records abroad without a licence\nnothing of this", "Means a tender. Ordinance on banks, at least ten days, as prescribed by the minister", None, "İstanbul ҮНЭ — data ABROAD is amended", "word " * 9_000 + "licence"]


def test_what_is_planted_are_the_cases():
    assert (PROVISIONS, BASE, MEASURES) == ([said for *_, said in _CASES], _BASE, _MEASURES)


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gates"))
    rows = [(i, "en", "src0", "") for i in range(N)] + [(i, ("en", "ru", None)[i % 3], ("src1", "Overview of telecoms", None)[i % 3], LINES[i % len(LINES)]) for i in range(N, 3 * N)]
    rows += [(-1, "lo", "src2", LINES[1]), (None, "en", "src2", LINES[1]), (7, "en", "src2", LINES[2])]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, len(rows), QUERIES["g_gates_on_words"](spark, path).collect()


def test_every_document_under_every_measure(own):
    _, n, got = own
    assert len(got) == n * 2 * len(MEASURES)
    assert {r.gate for r in got if r.planted} == {None, *(g for g, *_ in _CASES)}


def test_the_planted_cases_come_out_as_worked_out(own):
    got = {(r.doc_id, r.measure): (r.gate, r.outcome) for r in own[2] if r.planted and r.doc_id is not None and 0 <= r.doc_id < N and r.doc_id != 7}
    for i, (gate, outcome, said) in enumerate(_CASES):
        if i != 7:
            assert got[i, {**_BASE, **said}["measure"]] == (gate, outcome), i


def test_same_rows_as_sql_on_odd_lines(own):
    path, _, got = own
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["g_gates_on_words"])
    columns = [c[0] for c in want.description]
    assert plain([tuple(r) for r in got], ["doc_id", "planted", "measure", "gate", "outcome"]) == plain(want.fetchall(), columns)
