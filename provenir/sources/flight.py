"""Markup that a page carries as a streamed payload instead of as elements.

Such a page pushes pieces of one stream as strings. Put together they are rows; a text row names
its length in UTF-16 units and holds markup, which is then parsed like a page of its own.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How a piece is pushed, and how a text row begins.
PUSHED = re.compile(r"self\.__next_f\.push\(\[1,\s*(\"(?:[^\"\\]|\\.)*\")\s*\]\)", re.S)
TEXT_ROW = re.compile(r"(?:^|\n)[0-9a-f]+:T([0-9a-f]+),")


def markup(html: str | None) -> str | None:
    """The markup of a page's text rows, a row a line; None if there is none, or if a piece cannot be read.

    A piece that cannot be read makes all lengths behind it doubtful, so nothing is taken then.
    """
    try:
        stream = "".join(json.loads(m[1]) for m in PUSHED.finditer(html or ""))
    except ValueError:
        return None
    rows = []
    for m in TEXT_ROW.finditer(stream):
        units = stream[m.end() : m.end() + int(m[1], 16)].encode("utf-16-le", "surrogatepass")[: 2 * int(m[1], 16)]
        row = units.decode("utf-16-le", "replace")
        if "<" in row:
            rows.append(row)
    return "\n".join(rows) or None


@F.arrow_udf(StringType())
def _markup(html: pa.Array) -> pa.Array:
    return pa.array((markup(x.as_py()) for x in html), pa.string())  # page by page: no list of all


def flight_markup(html: Column) -> Column:
    """``markup`` as a column; only pages that push anything reach Python."""
    return _markup(F.when(F.coalesce(F.contains(html, F.lit("self.__next_f")), F.lit(False)), html))


def served_or_streamed(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``body``: the streamed markup where a page has some, else the page as it was served."""
    return pages.withColumn("body", F.coalesce(flight_markup(F.col(html)), F.col(html)))
