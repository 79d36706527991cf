import random

from provenir.operators import ordering
from provenir.streaming import events as E


def test_nearest_partners_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, f"s{rnd.randint(0, 4)}", rnd.choice("abc"), rnd.randint(0, 12)) for i in range(150)]
    rows += [(1000 + i, "one kind", "a", rnd.randint(0, 9)) for i in range(20)] + [(2000, "alone", "b", 3)]
    expected = {}
    for i, s, k, n in rows:
        others = [(k == k2, abs(n - n2), j) for j, s2, k2, n2 in rows if s2 == s and j != i]
        if others:
            expected[i] = min(others)[2]
    got = ordering.nearest_partners(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int"), "source", "lang", "n_chars")
    assert {r.doc_id: r.partner for r in got.collect()} == expected


def test_positions(spark):
    rnd = random.Random(1)
    values = [rnd.randint(0, 50) for _ in range(500)]
    out = ordering.positions(spark.createDataFrame(list(enumerate(values)), "i long, v int").repartition(7), "v", "i").collect()
    assert [r.i for r in sorted(out, key=lambda r: r.pos)] == [i for _, i in sorted((v, i) for i, v in enumerate(values))]
    assert sorted(r.pos for r in out) == list(range(1, 501))


def test_progress_over_several_batches(spark, tmp_path):
    for k, users in enumerate([(1, 2, 1), (1,), (3, 3)]):
        rows = [(10 * k + i, u) for i, u in enumerate(users)]
        spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    schema = spark.read.parquet(str(tmp_path / "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet"))
    out = E.drained(E.progress(stream), "update", ["user_id"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3, 10), (2, 1, 1), (3, 2, 21)]
