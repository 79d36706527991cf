"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

For each of ``SAMPLES`` draws every weighted term (a word and its count) has its own gamma-based
race time; the winner and the step at which it entered make one sample. Two documents agree on a
sample with a probability equal to the generalised Jaccard similarity of their weighted terms.
Documents lie together in runs of neighbours; there a term's draws are made once for all documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SAMPLES = 48
#: Documents of a bucket of neighbours, and ids (a bounded sample, for the layout only) that buckets are cut by.
NEIGHBOURS, SAMPLED = 1500, 1 << 15


def _uniform(h: Column, at: int, digits: int) -> Column:
    """A uniform number in (0, 1) from some binary digits of a hash."""
    return (F.shiftrightunsigned(h, at).bitwiseAND((1 << digits) - 1) + 0.5) / float(1 << digits)


def _draw(k: int) -> Column:
    """The race of one (term, log weight) in draw ``k``: the time above, what is sampled below, in one long.

    r and c are Gamma(2, 1), b is uniform; t = floor(log w / r + b), and the time's logarithm is
    log c - r (t - b + 1).
    """
    h, g = F.xxhash64("term", F.lit(2 * k)), F.xxhash64("term", F.lit(2 * k + 1))
    r = -F.log(_uniform(g, 0, 24) * _uniform(g, 24, 24))
    log_c = F.log(-F.log(_uniform(h, 0, 32) * _uniform(h, 32, 32)))
    b = _uniform(g, 48, 16)
    t = F.floor(F.col("lw") / r + b)
    time = F.floor((F.least(F.lit(127.0), F.greatest(F.lit(-127.0), log_c - r * (t - b + 1))) + 128) * float(1 << 22)).cast("long")
    sampled = (F.shiftrightunsigned(h, 13) + t * 40503).bitwiseAND(0xFFFF)
    return F.shiftleft(time, 16).bitwiseOR(sampled)


def samples(texts: DataFrame, within: list[str], keys: list[str], text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """``within``, ``keys`` and ``s``, an array of ``n`` samples (-1 each for a text without words).

    ``keys`` name one text of those that lie together by ``within``, where nothing is shuffled. The
    draws of a (term, count) are made once for all of these texts that have it, then each text takes
    the least of each draw over its terms.
    """
    words = F.explode_outer(F.array_remove(F.split(F.col(text_col), r"\s+"), ""))  # null for a text without words
    terms = texts.select(*within, *keys, words.alias("word")).select(*within, *keys, F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"))
    counted = terms.groupBy(*within, *keys, "term").agg(F.count(F.lit(1)).alias("w"))
    shared = counted.groupBy(*within, "term", "w").agg(F.collect_list(F.struct(*keys)).alias("of"))
    # the lambda has the draws compiled in parts (a single method of all would be too long to be optimised)
    of = F.transform("of", lambda x: F.struct(*[x[c].alias(c) for c in keys])).alias("of")
    drawn = shared.withColumn("lw", F.log(F.col("w").cast("double"))).select(*within, "term", of, *[_draw(k).alias(f"s{k}") for k in range(n)])
    each = drawn.select(*within, "term", F.explode("of").alias("x"), *[f"s{k}" for k in range(n)]).select(*within, "x.*", "term", *[f"s{k}" for k in range(n)])
    least = each.groupBy(*within, *keys).agg(F.count("term").alias("words"), *[F.min(f"s{k}").alias(f"s{k}") for k in range(n)])
    return least.select(*within, *keys, F.array(*[F.when(F.col("words") == 0, F.lit(-1)).otherwise(F.col(f"s{k}").bitwiseAND(0xFFFF)).cast("int") for k in range(n)]).alias("s"))


def likeness(a: str, b: str, n: int = SAMPLES) -> Column:
    """The part of the samples that agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / float(n)


def _text_form(s: str) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(0xFFFF).cast("long"))), 4, "0")), "")


def _reached(ids: Column, hashes: Column, n: int) -> Column:
    """How many of the ``n`` sorted cuts (arrays of ids and of hashes) a row (doc_id, h) has reached; null ids come first."""
    steps = [1 << k for k in range(max(1, n).bit_length() - 1, -1, -1)]

    def step(pos: Column, s: Column) -> Column:
        at = (pos + s - 1).cast("int")
        i, h = F.get(ids, at), F.get(hashes, at)
        return F.when((pos + s <= n) & ((F.col("doc_id") > i) | (F.col("doc_id") == i) & (F.col("h") >= h)), pos + s).otherwise(pos)

    return F.coalesce(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step), F.lit(0))


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, rn, doc_id, text, next_text, extra): every row with the text of the next one by id.

    After the last comes the first; ids that are equal go by the hash of the text, null ids stand
    first. Rows lie together by bucket, a run of the order (id, hash) between two cuts; the cuts are
    ids of a bounded sample, so buckets hold about as many rows each whatever the ids are (only rows
    equal in both are never parted, and null ids are one run). ``extra`` marks copies of the first
    row of the next bucket, which close a bucket and are no documents of it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    ids = stored(rows.select("doc_id", "h"), "ids")
    n = ids.count()
    # about SAMPLED ids at most, by a hash: they lay the rows out and decide nothing else
    some = ids.where("doc_id is not null").where(F.pmod(F.xxhash64("h", "doc_id"), F.lit(max(1, n // SAMPLED))) == 0).distinct().orderBy("doc_id", "h").collect()
    every = max(1, round(len(some) * NEIGHBOURS / max(n, 1)))
    cuts = some[::every][1:]
    arrays = [F.lit(np.array([c[k] for c in cuts], np.int64)) for k in ("doc_id", "h")]
    bucket = _reached(*arrays, len(cuts))
    firsts = ids.groupBy(bucket.alias("bucket")).agg(F.min(F.struct("doc_id", "h")).alias("first"))  # a row a cut
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    firsts = stored(firsts.select(F.col("first.doc_id").alias("f_id"), F.col("first.h").alias("f_h"), F.coalesce(F.lag("bucket").over(order), last).alias("before")), "firsts")
    placed = rows.withColumn("bucket", bucket)
    placed = placed.join(F.broadcast(firsts), placed["doc_id"].eqNullSafe(firsts["f_id"]) & (placed["h"] == firsts["f_h"]), "left")
    own, copy = F.struct("bucket", F.lit(False).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))
    laid = placed.select("doc_id", "h", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to")).select("doc_id", "h", "text", "to.*")
    laid = laid.repartition(len(cuts) + 1, "bucket")  # a task for about each bucket, which it can sort without spilling
    near = Window.partitionBy("bucket").orderBy("extra", "doc_id", "h")
    return laid.select("bucket", F.row_number().over(near).alias("rn"), "doc_id", "text", F.lead("text").over(near).alias("next_text"), "extra")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text: the last half of the code points (rounded down) gives way to as many of the
    next document. Null texts count as empty; texts without words share one fingerprint, and are
    wholly like one another. Repeated rows are rows like any other. An empty table gives no rows.
    """
    near = with_neighbours(docs, id_col, text_col)
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = near.withColumn("edited", F.when(~F.col("extra"), edited))
    variants = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("v")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("v")))
    each = both.select("bucket", "rn", F.explode(variants).alias("x")).select("bucket", "rn", "x.which", F.col("x.v").alias("text")).where(F.col("text").isNotNull())
    found = samples(each, ["bucket"], ["rn", "which"], n=n)
    both_samples = found.groupBy("bucket", "rn").agg(*[F.first(F.when(F.col("which") == k, F.col("s")), ignorenulls=True).alias(c) for k, c in ((0, "s"), (1, "e"))])
    # what else is asked of each row comes from the same exchange, and is kept out of the keys of all words
    about = both.select("bucket", "rn", "doc_id", "extra", length.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    one = stored(about.join(both_samples, ["bucket", "rn"]), "samples")
    after = Window.partitionBy("bucket").orderBy("rn")
    paired = one.withColumn("next_s", F.lead("s").over(after)).where(~F.col("extra"))
    return paired.select("doc_id", "n_chars", "edited_sha256", _text_form("s").alias("fingerprint"), _text_form("e").alias("edited_fingerprint"), likeness("s", "e", n).alias("near_edited"), likeness("s", "next_s", n).alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts; see ``fingerprints``."""
    return fingerprints(table(spark, sf_dir, "documents"))
