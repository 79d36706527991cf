"""WARC archives: an index of byte ranges first, then coalesced sorted reads of the chosen records.

Writers append records to files of bounded size in a folder that all executors share, each file
under a name of its own; the index, a table that Spark commits, holds file, offset, length, URL and
digest of every record. A task that is run again writes new files, and only those that the
committed index names are ever read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, stored, table

#: Compressed bytes of a file, of one read, and of a gap that is read over rather than skipped.
FILE, READ, GAP = 64 << 20, 8 << 20, 64 << 10
#: Tasks that read, at most; each has READ bytes of archive or more.
TASKS = 100_000
#: Payloads from so many bytes on are stored once (fixed by the archive's users).
REVISIT_FROM = 0

_INDEX = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, file string, offset long, length long"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC writes it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: White space and control characters, which no URI holds.
_NOT_IN_URI = re.compile(r"[\x00-\x20\x7f\x85\xa0\u2028\u2029]")


def _uri(url: str | None) -> str:
    return _NOT_IN_URI.sub(lambda c: quote(c[0]), url or "")


def record(page_id: int | None, kind: str, refers_to: int | None, url: str | None, payload: bytes, own_digest: str, date: str, number: str) -> bytes:
    """One WARC record: a response with its payload behind an HTTP head, or a revisit that names the response.

    ``number`` is unique to the record. The page's id, and a URL that is no URI as it stands, are
    kept in fields of their own, so that nothing is lost.
    """
    block = b""
    if kind == "response":
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{number}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{own_digest}",
        f"X-Page-ID: {json.dumps(page_id)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is None or _uri(url) != url:
        head.append(f"X-Page-URL: {json.dumps(url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {json.dumps(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields and the payload of one record; damage is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError("no WARC record where the index says")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    body = block.partition(b"\r\n\r\n")[2]
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and digest(body) != own:
        raise ValueError("a payload differs from its digest")
    url = json.loads(fields["X-Page-URL"]) if "X-Page-URL" in fields else fields["WARC-Target-URI"]
    return {"page_id": json.loads(fields["X-Page-ID"]), "record_type": fields["WARC-Type"], "refers_to": json.loads(fields.get("X-Refers-To-Page-ID", "null")), "url": url, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": own, "payload": body}


def with_roles(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload binary, record_type, refers_to) of each row.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the response
    (if that id is repeated, each of its rows; rows without an id only if all are), and the others
    revisit it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    # only what occurs twice is looked up; where that is little, Spark sends it to the payloads, which then stay where they are
    first = stored(rows.groupBy("sha", "n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated-payloads")
    alone = F.col("copies").isNull() | (F.col("n") < least) | F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, ["sha", "n"], "left").select("page_id", "url", "payload", F.when(alone, "response").otherwise("revisit").alias("record_type"), F.when(~alone, F.col("first")).alias("refers_to"))


def write(records: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write the records to files in ``folder``; returns the committed index (one row a record).

    ``date`` is the time of capture in ISO form (default: now).
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= FILE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        info = gzip.compress(f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 26\r\n\r\nformat: WARC File Format\r\n\r\n\r\n".encode(), 6, mtime=0)
                        out.write(info)
                        at = len(info)
                    own = digest(payload)
                    data = gzip.compress(record(page_id, kind, refers, url, payload, own, date, str(uuid.uuid4())), 6, mtime=0)  # a member for each record, as usual
                    out.write(data)
                    rows.append((page_id, kind, refers, url, len(payload), own, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_ARROW)
        finally:
            if out is not None:
                out.close()

    return stored(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, _INDEX), "warc-index")


_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in _INDEX.split(", ")])


def read(index: DataFrame, folder: str, chosen: Column | None = None, payloads: bool = False) -> DataFrame:
    """The records that ``chosen`` selects (default: all), read back from the files.

    The index is sorted by file and offset; neighbours whose gap is small come with one read of
    bounded size. With ``payloads`` the stored bytes are a column too (empty for revisits).
    """
    rows = index if chosen is None else index.where(chosen)
    rows = rows.select("file", "offset", "length")
    tasks = min(TASKS, (rows.agg(F.sum("length").alias("n")).first()["n"] or 0) // READ + 1)
    laid = rows.repartition(tasks, "file", F.floor(F.col("offset") / READ)).sortWithinPartitions("file", "offset")  # by bytes of archive, not of index
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        opened, source = None, None

        def fetch(group: list[tuple[str, int, int]]) -> pd.DataFrame:
            nonlocal opened, source
            if opened != group[0][0]:
                if source is not None:
                    source.close()
                opened, source = group[0][0], store.open_input_file(f"{root}/{group[0][0]}")
            start = group[0][1]
            data = source.read_at(group[-1][1] + group[-1][2] - start, start)
            frame = pd.DataFrame([parsed(gzip.decompress(data[o - start : o - start + n])) for _, o, n in group], columns=names)
            return frame.astype({"page_id": "Int64", "refers_to": "Int64"})

        group: list[tuple[str, int, int]] = []
        for frame in frames:
            for f, o, n in frame.itertuples(index=False, name=None):
                if group and (f != group[0][0] or o - (group[-1][1] + group[-1][2]) > GAP or o + n - group[0][1] > READ):
                    yield fetch(group)
                    group = []
                group.append((f, o, n))
        if group:
            yield fetch(group)
        if source is not None:
            source.close()

    return laid.mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payloads else ""))


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for every row of ``pages`` (null html: an empty payload) and read all of them back.

    Every row gives one record, repeated rows too; an empty table gives no rows.
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    return read(write(with_roles(pages), folder), folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to WARC files and read back; see ``archived``."""
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
