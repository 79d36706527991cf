"""What the operators of this folder share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests on one machine) a temporary folder is set where none is named; a cluster must name one.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = getattr(spark.sparkContext, "_own_shared_dir", None)
        if known is None:
            known = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext._own_shared_dir = known
            spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path (not yet created) in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a read, not a recomputation.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for every row (ids can be null or occur twice)."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), "keyed")


def first_of_each(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each component of ``groups`` (row, doc_id, component) one row of ``rows``: the smallest id, null last."""
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select("best.row")
    return rows.join(stored(best, "kept-rows"), "row", "left_semi")
