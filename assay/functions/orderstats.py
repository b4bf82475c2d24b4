"""Exact order statistics that stay distributed, by one path for every size.

``percentile`` keeps one hash-map entry per distinct value in a single task, which does not scale. Here
a rank is found in three scans:

1. counts and ``percentile_approx`` together give an interval that should hold each wanted rank;
2. one scan counts the values below and inside the intervals, so they are *checked*;
3. the few distinct values inside are grouped, ordered and read off exactly.

Only an interval that missed its rank, or holds more than ``limit`` distinct values, is narrowed
further: by a sketch of what is inside, and by halving its range where the sketch does not help. Every
step is one partial aggregate with a one-row result; no step moves the column as a whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.exprs import col

LIMIT = 100_000         # values that one task may hold and order
ACCURACY = 10_000       # of percentile_approx; its rank error is 1 / ACCURACY
MAX_ROUNDS = 100


@dataclass
class Bracket:
    """An interval of values known to hold the ranks ``low_rank`` and ``high_rank`` (0-based)."""

    name: str
    column: Column
    low_rank: int
    high_rank: int
    fraction: float
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    distinct: int | None = None
    trial: tuple[float, float] | None = None    # an interval to check next

    def holds(self) -> Column:
        """True for the values of the column inside the interval."""
        if self.low is None:
            return self.column.isNotNull()
        return self.column.between(F.lit(self.low), F.lit(self.high))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str | Column, float]],
                 limit: int = LIMIT, also: dict[str, Column] | None = None) -> DataFrame:
    """One row with one column per entry of ``wanted``: name -> (column, probability).

    Linear interpolation between the neighbouring ranks; NULL for an empty column. ``also`` adds
    other aggregates to the row, in the first scan.
    """
    also = also or {}
    by_column: dict[str, tuple[Column, list[tuple[str, float]]]] = {}
    for name, (c, p) in wanted.items():
        key = c if isinstance(c, str) else str(c)
        by_column.setdefault(key, (col(c).cast("double"), []))[1].append((name, float(p)))
    keys, width = list(by_column), 2.0 / ACCURACY
    scan = df.agg(
        *[F.struct(F.count(c).alias("n"), F.percentile_approx(
            c, F.array(*[F.lit(x) for _, p in goals for x in (max(0.0, p - width), min(1.0, p + width))]),
            F.lit(ACCURACY)).alias("cuts")).alias(f"__q{i}") for i, (c, goals) in enumerate(by_column.values())],
        *[a.alias(n) for n, a in also.items()])
    first = scan.first()
    brackets = []
    for i, k in enumerate(keys):
        n, cuts = first[f"__q{i}"]
        for j, (name, p) in enumerate(by_column[k][1]):
            if n:
                position = p * (n - 1)
                low = min(int(math.floor(position)), n - 1)
                brackets.append(Bracket(name, by_column[k][0], low, min(low + 1, n - 1), position - low, n,
                                        trial=(cuts[2 * j], cuts[2 * j + 1])))
    found = {r["target"]: r["value"] for r in _pick_ranks(df, narrow(df, brackets, limit)).collect()} if brackets else {}
    one = df.sparkSession.createDataFrame([first], scan.schema) if also else df.sparkSession.range(1)
    return one.select(*[F.lit(found.get(n)).cast("double").alias(n) for n in wanted], *also)


def narrow(df: DataFrame, brackets: list[Bracket], limit: int = LIMIT) -> list[Bracket]:
    """Shrink each bracket until it is checked and holds at most ``limit`` distinct values."""
    width, halve, limit = 2.0 / ACCURACY, False, max(limit, 2)  # a rank and its neighbour are two values
    for _ in range(MAX_ROUNDS):
        todo = [b for b in brackets if b.distinct is None or b.distinct > limit]
        if not todo:
            return brackets
        if halve:
            for b in [b for b in todo if b.low is not None]:
                b.trial = (b.low, b.low + (b.high - b.low) / 2)
        # brackets that still cover the same interval share one sketch
        shared: dict[tuple, list[Bracket]] = {}
        for b in [b for b in todo if b.trial is None]:
            shared.setdefault((str(b.column), b.low, b.high), []).append(b)
        groups = list(shared.values())
        if groups:
            sketches = df.agg(*[
                F.percentile_approx(
                    F.when(g[0].holds(), g[0].column),
                    F.array(*[F.lit(p) for b in g for p in _around(b, width)]), F.lit(ACCURACY),
                ).alias(f"g{i}") for i, g in enumerate(groups)
            ]).first()
            for i, g in enumerate(groups):
                for j, b in enumerate(g):
                    b.trial = (sketches[i][2 * j], sketches[i][2 * j + 1])
        trial = [Bracket(b.name, b.column, 0, 0, 0.0, 0, low=b.trial[0], high=b.trial[1]) for b in todo]
        seen = df.agg(*[
            F.struct(
                F.count_if(t.column < F.lit(t.low)).alias("below"), F.count_if(t.holds()).alias("inside"),
                F.approx_count_distinct(F.when(t.holds(), t.column)).alias("distinct"),
                F.max(F.when(t.holds(), t.column)).alias("last"),
                F.min(F.when(t.column > F.lit(t.high), t.column)).alias("next"),
            ).alias(f"b{i}") for i, t in enumerate(trial)
        ]).first()
        missed = stuck = False
        for i, (b, t) in enumerate(zip(todo, trial)):
            s, b.trial = seen[f"b{i}"], None
            end = s["below"] + s["inside"]
            if s["below"] <= b.low_rank and b.high_rank < end:
                stuck |= s["distinct"] > limit and b.distinct is not None and s["inside"] > 0.9 * b.inside
                b.low, b.high, b.below, b.inside, b.distinct = t.low, t.high, s["below"], s["inside"], s["distinct"]
            elif halve and b.low_rank == end - 1 and b.high_rank == end:  # the last of one half, the first of the other
                b.trial = (s["last"], s["next"])
            elif halve and b.low_rank >= end:
                b.trial = (s["next"], b.high)
            else:
                missed = True
        if missed:
            width = min(0.5, width * 8)
        halve = stuck
    raise RuntimeError(f"no interval of at most {limit} values after {MAX_ROUNDS} rounds")


def _around(b: Bracket, width: float) -> tuple[float, float]:
    """Probabilities just below and above the wanted ranks, within the current interval."""
    return (max(0.0, (b.low_rank - b.below) / b.inside - width),
            min(1.0, (b.high_rank - b.below + 1) / b.inside + width))


def values_inside(df: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """(target, value, n): distinct values inside each bracket with their row counts."""
    hits = F.array_compact(F.array(*[
        F.when(b.holds(), F.struct(F.lit(b.name).alias("target"), b.column.alias("value")))
        for b in brackets
    ]))
    anywhere = reduce(lambda x, y: x | y, [b.holds() for b in brackets])
    return (
        df.filter(anywhere).select(F.inline(hits)).groupBy("target", "value")
        .agg(F.count("*").alias("n"))
    )


def per_target(brackets: list[Bracket], attribute: str) -> Column:
    """The bracket's attribute as a column, chosen by the row's ``target``."""
    pairs = [F.lit(x) for b in brackets for x in (b.name, getattr(b, attribute))]
    return F.create_map(*pairs)[F.col("target")]


def _pick_ranks(df: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """(target, value) interpolated at the wanted ranks; each window holds <= limit rows."""
    running = Window.partitionBy("target").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = values_inside(df, brackets).withColumn(
        "upto", F.sum("n").over(running) + per_target(brackets, "below"))
    first = F.min(F.when(F.col("upto") > per_target(brackets, "low_rank"), F.col("value")))
    second = F.min(F.when(F.col("upto") > per_target(brackets, "high_rank"), F.col("value")))
    fraction = per_target(brackets, "fraction")
    return (
        ranked.groupBy("target").agg(first.alias("a"), second.alias("b"))
        .select("target", (F.col("a") * (1 - fraction) + F.col("b") * fraction).alias("value"))
    )
