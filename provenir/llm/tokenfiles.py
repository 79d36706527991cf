"""Token files: Parquet with the ids of each document as a list, made for selective reads.

Rows stand in ascending order of ids, over files and within them. The list of ids is encoded by
dictionary (a vocabulary is small beside a row group), document ids, places and lengths by deltas.
Row groups and pages are of bounded size, and the page index that Spark's writer adds lets a filter
on document or place read only the pages that hold it; columns that are not asked for are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, parts
from .common import fresh_dir, table

#: Bytes of text behind a file, bytes of a row group and of a page, rows of a page, ids of a dictionary page.
FILE, ROW_GROUP, PAGE, PAGE_ROWS, DICTIONARY = 256 << 20, 32 << 20, 128 << 10, 2000, 1 << 20
END = 2

#: Writer settings: version 2 encodes integers by deltas where no dictionary is asked for.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(DICTIONARY),
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "compression": "zstd",
}


def write(docs: DataFrame, vocabulary: str, folder: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append the id ``end`` and write (doc_id, part, place, n_tokens, ids) in ascending order of id.

    ``part`` numbers the files in order and ``place`` counts the ids before a document within its
    file, so one pass writes both; ``manifest`` says where each file starts in the whole. Rows
    without id come first, rows of one id keep the order of the table and can stand in several
    files; null texts count as empty. Texts are shuffled once, by ranges of (id, row).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE))
    laid = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = codec(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in parts(batch):
                ids = [i + tail for i in own.encode_all(some.column(1))]
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(at + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), lists], ["doc_id", "part", "place", "n_tokens", "ids"])
                at += int(ends[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    laid.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, place long, n_tokens long, ids array<int>").write.options(**LAYOUT).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files; what is selected and filtered decides which columns and pages are read."""
    return spark.read.parquet(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, start, n_tokens): how many ids stand before each file, and in it. Reads no ids.

    A row for each file, in one window: files are of FILE bytes of text, so 100 TB have some 400,000.
    """
    from pyspark.sql import Window

    each = read(spark, folder).groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"), "n_tokens")


def span(spark: SparkSession, folder: str, start: int, length: int) -> DataFrame:
    """(doc_id, start, ids) of the ids from ``start`` on, ``length`` of them, cut out of their documents.

    Only the files of the span are opened, and in them the pages that a filter on ``place`` leaves.
    """
    own = manifest(spark, folder).where((F.col("start") < start + length) & (F.col("start") + F.col("n_tokens") > start)).collect()  # the files of the span
    rows = read(spark, folder)
    hit, base = F.lit(False), F.lit(None).cast("long")
    for r in own:
        low, high = start - r["start"], start + length - r["start"]
        hit = hit | ((F.col("part") == r["part"]) & (F.col("place") < high) & (F.col("place") + F.col("n_tokens") > low))
        base = F.when(F.col("part") == r["part"], F.lit(r["start"])).otherwise(base)
    first = F.greatest(F.lit(start) - F.col("at"), F.lit(0))
    last = F.least(F.lit(start + length) - F.col("at"), F.col("n_tokens"))
    return rows.where(hit).withColumn("at", base + F.col("place")).select("doc_id", (F.col("at") + first).alias("start"), F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("ids"))


def checksums(tokens: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    kept = [c for c in tokens.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends = np.asarray(lists.offsets)
            data = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    form = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in kept)
    return tokens.select(*kept, ids_col).mapInArrow(run, f"{form}, ids_crc32 long")


def op11_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` written to token files and read back; see ``write``."""
    import public_tokenizers

    folder = fresh_dir(spark, "tokens")
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    found = checksums(read(spark, folder).select("doc_id", "part", "place", "n_tokens", "ids"))
    starts = manifest(spark, folder).select("part", F.col("start").alias("before"))
    return found.join(starts, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
