"""A join with a table of counted keys that no single key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key is hot from this fraction of all rows on, so there are at most so many hot keys
HOT = 10_000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], count: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``keys``, which has one row for each value of ``on`` (without nulls).

    ``keys[count]`` says how many rows (or a figure in proportion) carry the key. Keys with at least
    1 / ``hot`` of the total number at most ``hot``, so these are broadcast and their rows never
    move; the others meet in a shuffle, where none of them has more than that share. ``rows`` is
    read twice. The count column is dropped.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    often = F.broadcast(keys.where(F.col(count) * hot >= total).drop(count))
    seldom = keys.where(F.col(count) * hot < total).drop(count)
    cold = rows.join(often.select(*on), on, "left_anti").join(seldom, on)
    return rows.join(often, on).unionByName(cold)
