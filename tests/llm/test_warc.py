import base64
import hashlib

from pyspark.sql import functions as F

from provenir.llm import warc


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE", 2000)
    rows = [(i, f"http://h/{i}", "<p>" + "é" * (i % 50) + "</p>\r\n\r\nWARC/1.0") for i in range(200)] + [(300 + i, "http://copy", "copy") for i in range(100)]
    rows += [(500, None, None), (501, "u\r\nX: 1  y", ""), (None, "n", "copy"), (None, "n", "lonely"), (7, "http://h/7", rows[7][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, offset int")
    folder = "file://" + str(tmp_path / "w")
    index = warc.write(warc.with_roles(df), folder)
    got = warc.read(index, folder, payloads=True).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        p = (h or "").encode()
        response = (-1 if i is None else i) == best[h or ""]
        expected.append((str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else best[h or ""]))
    assert sorted(map(str, expected)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    texts = {hashlib.sha1(p).digest() for p in ((h or "").encode() for _, _, h in rows)}
    assert {hashlib.sha1(bytes(r.payload)).digest() for r in got if r.record_type == "response"} == texts
    assert sorted(str(r.url) for r in got) == sorted(str(u) for _, u, _ in rows)  # odd and null ones too
    some = warc.read(index, folder, F.col("url") == "http://copy").collect()
    assert len(some) == 100
    assert warc.archived(df.limit(0)).count() == 0


def test_records_are_those_of_the_format():
    data = warc.record(5, "response", None, "http://h/ä b", b"<p>", warc.digest(b"<p>"), "2024-01-01T00:00:00Z", "a-b")
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert fields["WARC-Date"] == "2024-01-01T00:00:00Z" and fields["WARC-Record-ID"] == "<urn:uuid:a-b>" and fields["WARC-Target-URI"] == "http://h/ä%20b"
    assert len(block) == int(fields["Content-Length"]) + 4 and block.startswith(b"HTTP/1.1 200 OK\r\n") and block.endswith(b"\r\n\r\n<p>\r\n\r\n")
    assert warc.parsed(data)["url"] == "http://h/ä b"
    long = b"x" * (3 << 20)
    assert warc.parsed(warc.record(None, "response", None, None, long, warc.digest(long), "2024-01-01T00:00:00Z", "c")) == {"page_id": None, "record_type": "response", "refers_to": None, "url": None, "payload_bytes": len(long), "payload_digest": warc.digest(long), "payload": long}
