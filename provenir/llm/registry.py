"""The queries of this folder by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .centroids import OP12_SQL, op12_centroids
from .fingerprints import op9_fingerprints
from .packing import op5_packing
from .quality import op10_quality
from .runs import op13_runs
from .sharding import op8_sharding
from .simhash import op3_simhash
from .tokenfiles import op11_tokenfiles
from .topk import OP7_SQL, op7_topk
from .toxicity import op1_toxicity
from .warc import op2_warc
from .wrappers import op4_wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_wrappers": op4_wrappers,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_topk": op7_topk,
    "op8_sharding": op8_sharding,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
    "op11_tokenfiles": op11_tokenfiles,
    "op12_centroids": op12_centroids,
    "op13_runs": op13_runs,
}
ORACLES: dict[str, str] = {
    "op7_topk": OP7_SQL,
    "op12_centroids": OP12_SQL,
}
