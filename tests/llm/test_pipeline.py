import corpus_pipeline
from provenir.llm import simhash

SF = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_dedup", "packing"]
    before = {r.doc_id for r in docs.collect()}
    kept = docs
    for name in list(stages)[:-1]:
        kept = stages[name](spark, kept, SF)
        assert kept.columns == docs.columns
        left = {r.doc_id for r in kept.collect()}
        assert left < before
        before = left
    texts = {r.doc_id: r.text for r in kept.collect()}
    fps = {}
    for i, t in texts.items():
        fps.setdefault(simhash.fingerprint(t), []).append(i)
    assert all(len(v) == 1 for v in fps.values())
    own = sorted(fps)
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(own) for b in own[k + 1 :])
    packed = stages["packing"](spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def tables(spark, folder, rows):
    """A folder of documents with clashing extra columns, and the labels of the smallest tables."""
    frame = spark.createDataFrame([(*r, i, "k", 1.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row long, key string, score double")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    good = next(r for r in rows if r[0] in kept and len(r[1]) > 400)
    words = good[1].split()
    odd = [(None, good[1], *good[2:]), (None, good[1], None, None, None), (good[0], " ".join(words[: len(words) // 2]) * 3, *good[2:]), (900_001, None, None, None, None), (900_001, "", None, None, 0), (900_002, good[1] * 60, *good[2:])]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path / "odd", rows + odd)).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    assert good[0] in pieces and None not in pieces  # a copy without id goes, the one with the smallest id stays
    assert set(pieces) <= {r[0] for r in rows + odd}
    assert {(r.sequence_id, r.offset) for r in out} == {(s, o) for s, o in {(r.sequence_id, r.offset) for r in out}} and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert all(r.length <= 2048 for r in out)


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [])).count() == 0
