import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from provenir.llm import tokenfiles
from provenir.llm.common import fresh_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def rows():
    texts = ["a b", "", None, "Maß 😀 <|endoftext|> x", "word " * 30_000, " \n\t "]
    out = [(i, texts[i % 6] if i % 6 != 4 or i == 4 else f"number {i} of some") for i in range(600)]
    return out + [(17, "twice"), (17, "again"), (17, "again"), (None, "no id"), (None, None), (-5, "first of those with an id")]


@pytest.fixture(scope="module")
def folder(spark, rows):
    own = fresh_dir(spark, "test-tokens")
    tokenfiles.write(spark.createDataFrame([(i, t, 3, "p") for i, t in rows], "doc_id long, text string, part int, place string").repartition(5), VOCABULARY, own)
    return own


def test_files_hold_every_document_in_order(spark, rows, folder, plain):
    got = tokenfiles.read(spark, folder).join(tokenfiles.manifest(spark, folder).withColumnRenamed("n_tokens", "of_file"), "part")
    got = got.withColumn("at", F.col("start") + F.col("place")).orderBy("at", "n_tokens").collect()
    known = [r.doc_id for r in got]
    assert known == sorted(known, key=lambda i: (i is not None, i or 0)) and len(got) == len(rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids_of(plain, t)) for i, t in rows)
    at = 0
    for r in got:
        assert r["at"] == at and r.n_tokens == len(r.ids)
        at += r.n_tokens


def test_layout(folder):
    files = sorted(glob.glob(folder.removeprefix("file://") + "/*.parquet"))
    assert len(files) > 1
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert set(columns) == {"doc_id", "part", "place", "n_tokens", "ids.list.element"}
        for name, c in columns.items():
            assert c.has_offset_index and c.has_column_index
            assert ("RLE_DICTIONARY" in c.encodings) == (name == "ids.list.element")
            assert name == "ids.list.element" or "DELTA_BINARY_PACKED" in c.encodings


def test_row_groups_and_pages_are_bounded(spark, monkeypatch):
    monkeypatch.setitem(tokenfiles.LAYOUT, "parquet.block.size", str(1 << 16))
    monkeypatch.setitem(tokenfiles.LAYOUT, "parquet.page.row.count.limit", "50")
    own = fresh_dir(spark, "test-groups")
    tokenfiles.write(spark.createDataFrame([(i, " ".join(str((i * 7919 + k * 104729) % 9973) for k in range(120))) for i in range(4000)], "doc_id long, text string"), VOCABULARY, own)
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(own.removeprefix("file://") + "/*.parquet")]
    assert all(m.num_row_groups > 1 for m in meta)
    assert tokenfiles.read(spark, own).where("doc_id = 777").select("n_tokens").count() == 1


def test_spans_are_cut_from_the_whole(spark, folder, plain):
    got = tokenfiles.read(spark, folder).join(tokenfiles.manifest(spark, folder).drop("n_tokens"), "part").orderBy(F.col("start") + F.col("place"), "n_tokens").select("ids").collect()
    whole = [i for r in got for i in r.ids]
    for start, length in ((0, 5), (3, 1), (0, len(whole)), (len(whole) // 2, 4000), (len(whole) - 3, 100), (len(whole), 4), (7, 0)):
        parts = sorted(tokenfiles.span(spark, folder, start, length).collect(), key=lambda r: r.start)
        assert [i for r in parts for i in r.ids] == whole[start : start + length]
        at = start
        for r in parts:
            assert r.start == at
            at += len(r.ids)


def test_pushed_filters_and_columns(spark, folder, capsys):
    tokenfiles.read(spark, folder).where("doc_id between 5 and 9").select("doc_id", "n_tokens").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_query_against_a_plain_encoder(spark, rows, plain, tmp_path):
    path = str(tmp_path)
    own = [r for r in rows if r[0] not in (None, 17)]
    spark.createDataFrame(own, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    at, want = 0, []
    for i, t in sorted(own):
        ids = ids_of(plain, t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfiles.op11_tokenfiles(spark, path).collect())) == want


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert tokenfiles.op11_tokenfiles(spark, path).count() == 0
