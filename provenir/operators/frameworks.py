"""Framework candidates: ranked lists interleaved, every parent before what is made under it."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sections named for a parent that is put before its child (a fixed value).
PARENT_SECTIONS = 4


def interleaved(lists: list[DataFrame], cell: list[str], owner: str = "owner", rank: str = "rank") -> DataFrame:
    """(cell, owner, place): the lists of each cell taken in turn, each owner where it comes first.

    Ranks may have gaps (what was filtered out of a list does not leave a hole). Owners that are
    null take no part; an owner that a list names twice counts at its first place.
    """
    parts = []
    for k, one in enumerate(lists):
        first = one.where(F.col(owner).isNotNull()).groupBy(*cell, owner).agg(F.min(rank).alias("_r"))
        parts.append(first.select(*cell, owner, F.row_number().over(Window.partitionBy(*cell).orderBy("_r", owner)).alias("_nth"), F.lit(k).alias("_list")))
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy(*cell, owner).agg(F.min(F.struct("_nth", "_list")).alias("_at"))
    return best.select(*cell, owner, F.row_number().over(Window.partitionBy(*cell).orderBy("_at")).alias("place"))


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell's list: a parent that is not placed yet goes right before the item that is reached."""
    out: dict[str, None] = {}
    for own, parent in rows.sort_values("place")[["owner", "parent"]].itertuples(index=False, name=None):
        if own not in out:
            if parent is not None and parent == parent:
                out.setdefault(parent)
            out[own] = None
    return pd.DataFrame({"_cell": rows["_cell"].iloc[0], "owner": list(out), "rank": range(1, len(out) + 1)})


def with_parents(listed: DataFrame, parents: DataFrame, in_force: DataFrame, cell: list[str], owner: str = "owner") -> DataFrame:
    """(cell, owner, rank): the list with the parents of its items, each before the first item under it.

    ``parents``: (owner, parent), one parent an owner; only parents that are in force (``in_force``:
    owners) are placed, whether the list has them or not. A parent that the list holds further down
    moves up. Lists are those of a depth, so a cell's list is one small group.
    """
    live = in_force.select(F.col(owner).alias("parent")).distinct()
    known = parents.select(owner, "parent").join(live, "parent", "left_semi").groupBy(owner).agg(F.min("parent").alias("parent"))
    rows = listed.join(known, owner, "left").select(F.struct(*cell).alias("_cell"), F.col(owner).cast("string").alias("owner"), F.col("parent").cast("string").alias("parent"), "place")
    keyed = rows.withColumn("_cell", F.to_json("_cell"))
    placed = keyed.groupBy("_cell").applyInPandas(_placed, "_cell string, owner string, rank int")
    form = listed.select(*cell).schema
    return placed.withColumn("_c", F.from_json("_cell", form)).select(*[F.col(f"_c.{c}").alias(c) for c in cell], F.col("owner").cast(listed.schema[owner].dataType).alias(owner), "rank")


def candidates(register: DataFrame, sections: DataFrame, retrieved: DataFrame, parents: DataFrame, in_force: DataFrame, cell: list[str], owner: str = "owner", section: str = "section") -> DataFrame:
    """(cell, owner, rank, sections): what may be a cell's framework, from three lists.

    ``register`` and ``retrieved`` are (cell, owner, rank), ``sections`` is (cell, section, owner,
    rank); only owners in force count. An owner comes with the sections that found it, in order; a
    parent that is placed for its child with its best few.
    """
    live = in_force.select(owner).distinct()
    own = [x.join(live, owner, "left_semi") for x in (register, sections, retrieved)]
    listed = interleaved([own[0], own[1], own[2]], cell, owner)
    ranked = with_parents(listed, parents, in_force, cell, owner)
    found = own[1].groupBy(*cell, owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", section))), lambda x: x[section]).alias("sections"))
    held = ranked.join(listed.select(*cell, owner, "place"), [*cell, owner], "left").join(found, [*cell, owner], "left")
    return held.select(*cell, owner, "rank", F.when(F.col("place").isNull(), F.slice("sections", 1, PARENT_SECTIONS)).otherwise(F.col("sections")).alias("sections"))
