"""Descriptive statistics, correlation, shape, concentration and influence."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.exprs import (
    TINY, col, correlation as corr_of, kurtosis, skewness,
    strength, unpivot)
from assay.functions.gram import pair_correlations
from assay.functions.hot import HOT, join_counted
from assay.functions.orderstats import LIMIT
from assay.functions.pvalues import p_value
from assay.operators.profiling import as_double, stats_with_rows
from assay.session import cut_lineage

MIN_CORRELATION = 0.30
MIN_SKEW = 1.0
TOP_SHARE = 0.20        # of the rows
TARGET_SHARE = 0.80     # of the total
MIN_CONCENTRATION = 40.0
WIDE = 32               # columns from which on pairs are sums of blocks instead of one expression each


def reliability(null_rate: Column, n: Column) -> Column:
    """Warning severity of a result: gaps above 30 % (high above 60 %), or fewer than 30 rows."""
    return (
        F.when(null_rate > 0.6, "high").when(null_rate > 0.3, "medium")
        .when(n < 30, "medium")
    )


def describe(df: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """Statistics of each column with range, relative spread and confidence."""
    spread = F.col("std") / F.greatest(F.abs(F.col("mean")), F.lit(TINY))
    null_rate = 1 - F.col("n") / F.col("n_rows")
    return (
        stats_with_rows(df, columns, limit)
        .withColumn("range", F.col("max") - F.col("min"))
        .withColumn("impact", F.least(F.lit(1.0), spread))
        .withColumn("confidence", F.greatest(F.lit(0.5), 1 - null_rate))
        .withColumn("warning", reliability(null_rate, F.col("n"))).drop("n_rows")
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n) of every pair of columns, in one scan of the data."""
    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2))
    if len(columns) >= WIDE:
        return _named_pairs(pair_correlations(values), columns, "r")
    one = values.agg(*[
        F.struct(corr_of(f"c{i}", f"c{j}").alias("r"),
                 F.count_if(F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()).alias("n"))
        .alias(f"p{k}") for k, (i, j) in enumerate(pairs)
    ])
    rows = [(F.lit(columns[i]), F.lit(columns[j]), F.col(f"p{k}.r"), F.col(f"p{k}.n"))
            for k, (i, j) in enumerate(pairs)]
    return unpivot(one, rows, ["a", "b", "r", "n"])


def _named_pairs(found: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Pairs by number as pairs by name; a pair without complete rows has no value and n = 0."""
    names = [(i, j, columns[i], columns[j]) for i, j in combinations(range(len(columns)), 2)]
    named = df_of(found, names, "a long, b long, left string, right string")
    return named.join(found, ["a", "b"], "left").select(
        F.col("left").alias("a"), F.col("right").alias("b"), value, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def spearman_matrix(df: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """(a, b, rho, n) of every pair of columns: Pearson r of average ranks over the complete rows.

    Equal values share the mean of their ranks. A column has one rank for all partners without gaps
    and one for each partner with gaps, among the rows that this partner has. All come from the
    column's distinct values with their counts: these are dealt to ``parts`` ranges, and a range's totals
    are carried to those above it, so no task ranks more than a range. Ranks return to the rows by
    one join for each column that no frequent value slows down. rho is null if either column is constant.
    """
    size, pairs = len(columns), list(combinations(range(len(columns)), 2))
    values = cut_lineage(df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)]))
    gaps = values.agg(*[F.count_if(F.col(f"c{i}").isNull()) for i in range(size)]).first()
    among = [i if gaps[i] else "all" for i in range(size)]    # the rows that a partner's rank is among
    kinds = [i for i in range(size) if gaps[i]]
    has = {i: F.col(f"c{i}").isNotNull().cast("long") for i in kinds}
    sides = unpivot(values, [(F.lit(i), F.col(f"c{i}"), F.lit(1).cast("long"), *has.values()) for i in range(size)],
                    ["side", "v", "n_all", *[f"n_{k}" for k in kinds]]).where("v IS NOT NULL")
    kinds = ["all", *kinds]
    counted = sides.groupBy("side", "v").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])
    ranges = counted.repartitionByRange(parts, "side", "v") if parts else counted.repartitionByRange("side", "v")
    ranges = cut_lineage(ranges.withColumn("part", F.spark_partition_id()))
    # at most one row for each range and one for each column: ranges of a column are neighbours
    totals = ranges.groupBy("part", "side").agg(
        F.count("*"), *[F.sum(f"n_{k}") for k in kinds]).orderBy("side", "part").collect()
    different, sizes = [0] * size, [[0] * len(kinds) for _ in range(size)]
    for _, side, values_in, *n in totals:
        different[side] += values_in
        sizes[side] = [x + y for x, y in zip(sizes[side], n)]
    below, seen = [], [[0] * len(kinds) for _ in range(size)]
    for part, side, _, *n in totals:
        below.append((part, side, *[x - y / 2 for x, y in zip(seen[side], sizes[side])]))
        seen[side] = [x + y for x, y in zip(seen[side], n)]
    below = df_of(df, below, ", ".join(["part int", "side int", *[f"below_{k} double" for k in kinds]]))
    w = Window.partitionBy("part", "side").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # (rows below + (n + 1) / 2) less the mean rank (N + 1) / 2
    ranks = cut_lineage(ranges.join(F.broadcast(below), ["part", "side"]).select("side", "v", F.col("n_all").alias("rows"), *[
        (F.sum(f"n_{k}").over(w) - F.col(f"n_{k}") / 2 + F.col(f"below_{k}")).alias(f"rank_{k}") for k in kinds]))
    ranked = values.select("*", *[F.col(f"c{i}").isNotNull().alias(f"has_{i}") for i in kinds[1:]])
    large = [i for i in range(size) if different[i] > HOT]
    for i in sorted(range(size), key=lambda i: different[i]):
        own = sorted({among[j] for j in range(size) if j != i}, key=str)
        keys = ranks.where(F.col("side") == i).select(F.col("v").alias(f"c{i}"), "rows", *[
            F.col(f"rank_{k}").alias(f"rank_{i}_{k}") for k in own])
        if i in large:
            found = join_counted(ranked.where(F.col(f"c{i}").isNotNull()), keys, [f"c{i}"], "rows")
            found = found.unionByName(ranked.where(F.col(f"c{i}").isNull()), allowMissingColumns=True)
        else:
            found = ranked.join(F.broadcast(keys.drop("rows")), f"c{i}", "left")
        kept = [c for c in ranked.columns if c != f"c{i}"]
        ranked = found.select(*kept, *[
            (F.col(f"rank_{i}_{k}") if k == "all" else F.when(F.col(f"has_{k}"), F.col(f"rank_{i}_{k}"))).alias(f"rank_{i}_{k}")
            for k in own])
        if i in large:
            ranked = cut_lineage(ranked)
    x, y = F.col("x"), F.col("y")
    both = unpivot(ranked, [(F.lit(i), F.lit(j), F.col(f"rank_{i}_{among[j]}"), F.col(f"rank_{j}_{among[i]}"))
                            for i, j in pairs], ["a", "b", "x", "y"]).where("x IS NOT NULL AND y IS NOT NULL")
    sums = both.groupBy("a", "b").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"),
                                      F.sum(y * y).alias("yy"), F.count("*").alias("n"))
    rho = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    return _named_pairs(sums.select("a", "b", rho.alias("rho"), "n"), columns, "rho")


def spearman(df: DataFrame, columns: list[str], min_abs: float = 0.0, parts: int | None = None) -> DataFrame:
    """Rank correlations of at least ``min_abs`` with strength and direction, strongest first."""
    return (
        spearman_matrix(df, columns, parts)
        .filter(F.col("rho").isNotNull() & (F.abs("rho") >= min_abs))
        .withColumn("strength", strength(F.col("rho")))
        .withColumn("direction", F.when(F.col("rho") > 0, "positive").otherwise("negative"))
        .orderBy(F.abs("rho").desc(), "a", "b")
    )


def correlation_pairs(df: DataFrame, columns: list[str], min_abs: float = MIN_CORRELATION,
                      top: int | None = 3) -> DataFrame:
    """The strongest pairs with |r| at least ``min_abs``; ``top=None`` keeps them all."""
    out = (
        correlation_matrix(df, columns)
        .filter(F.col("r").isNotNull() & (F.abs("r") >= min_abs))
        .withColumn("strength", strength(F.col("r")))
        .withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("negative"))
        .orderBy(F.abs("r").desc(), "a", "b")
    )
    return out if top is None else out.limit(top)


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson r of two columns with pair count, p-value and labels; needs five pairs."""
    return (
        correlation_matrix(df, [a, b]).filter((F.col("n") >= 5) & F.col("r").isNotNull())
        .withColumn("p_value", p_value(F.col("r"), F.col("n")))
        .withColumn("strength", strength(F.col("r")))
        .withColumn("direction", F.when(F.col("r") >= 0, "positive").otherwise("negative"))
        .withColumn("significant", F.col("p_value") < 0.05)
    )


def scatter(df: DataFrame, a: str, b: str, bins: int = 15) -> DataFrame:
    """(x, y, n): all complete pairs of two columns on a grid of ``bins`` by ``bins`` cells.

    x and y are the middles of the cells that hold pairs, n how many: a picture of every row whose
    size does not depend on the table. A constant column is one cell wide.
    """
    pairs = df.select(as_double(df, a).alias("x"), as_double(df, b).alias("y")).filter(
        "x IS NOT NULL AND y IS NOT NULL")
    ends = pairs.agg(*[f(c).alias(f"{c}_{name}") for c in "xy" for name, f in (("low", F.min), ("high", F.max))])
    rows = pairs.withColumn("ends", ends.select(F.struct(*ends.columns)).scalar())
    middle = {}
    for c in "xy":
        low, width = F.col(f"ends.{c}_low"), F.col(f"ends.{c}_high") - F.col(f"ends.{c}_low")
        cell = F.when(width > 0, F.least(F.floor((F.col(c) - low) / width * bins), F.lit(bins - 1))).otherwise(0)
        middle[c] = low + F.when(width > 0, (cell + 0.5) * width / bins).otherwise(0.0)
    return rows.groupBy(middle["x"].alias("x"), middle["y"].alias("y")).agg(F.count("*").alias("n")).orderBy("x", "y")


def shape_stats(df: DataFrame, columns: list[str], min_skew: float = MIN_SKEW) -> DataFrame:
    """Sample skewness and excess kurtosis of columns with ten values and |skew| >= ``min_skew``."""
    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    one = values.agg(*[
        F.struct(F.count(f"c{i}").alias("n"), skewness(f"c{i}").alias("skewness"),
                 kurtosis(f"c{i}").alias("kurtosis")).alias(f"s{i}")
        for i in range(len(columns))
    ])
    rows = [(F.lit(c), F.col(f"s{i}.n"), F.col(f"s{i}.skewness"), F.col(f"s{i}.kurtosis"))
            for i, c in enumerate(columns)]
    return (
        unpivot(one, rows, ["column", "n", "skewness", "kurtosis"])
        .filter((F.col("n") >= 10) & (F.abs("skewness") >= min_skew))
        .withColumn("direction", F.when(F.col("skewness") > 0, "right").otherwise("left"))
    )


def factor_influence(df: DataFrame, target: str, numeric: list[str],
                     categorical: list[str], max_groups: int | None = None) -> DataFrame:
    """What moves the target: |r| of numeric columns, spread of group means of categories.

    A category's impact is (highest - lowest group mean) / std of the target, at most 1. All
    correlations come from one aggregate; all categories are grouped in one pass. ``max_groups``
    leaves out categories of more values, where a caller sets it.
    """
    few = F.lit(True) if max_groups is None else F.col("n_values") <= max_groups
    y = as_double(df, target)
    numeric = [c for c in numeric if c != target]
    frames = []
    if numeric:
        values = df.select(y.alias("y"), *[as_double(df, c).alias(f"c{i}")
                                           for i, c in enumerate(numeric)])
        one = values.agg(*[
            F.struct(corr_of(f"c{i}", "y").alias("r"),
                     F.count_if(F.col(f"c{i}").isNotNull() & F.col("y").isNotNull()).alias("n"))
            .alias(f"s{i}") for i in range(len(numeric))
        ])
        rows = unpivot(one, [(F.lit(c), F.col(f"s{i}.r"), F.col(f"s{i}.n"))
                             for i, c in enumerate(numeric)], ["feature", "r", "n"])
        frames.append(rows.filter((F.col("n") >= 5) & F.col("r").isNotNull()).select(
            "feature", F.lit("numeric").alias("type"), F.abs("r").alias("impact"),
            "r", p_value(F.col("r"), F.col("n")).alias("p_value"),
            F.lit(None).cast("double").alias("spread"),
            F.lit(None).cast("string").alias("best_group"),
            F.lit(None).cast("string").alias("worst_group"),
            F.lit(None).cast("bigint").alias("n_groups")))
    if categorical:
        cells = unpivot(df.withColumn("__y", y),
                        [(F.lit(c), col(c).cast("string"), F.col("__y")) for c in categorical],
                        ["feature", "value", "y"])
        means = (
            cells.filter("value IS NOT NULL").groupBy("feature", "value").agg(F.avg("y").alias("m"))
        )
        std = df.agg(F.stddev_samp(y).alias("s")).select(
            F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0))).scalar()
        best = F.min(F.when(F.col("m").isNotNull(), F.struct((-F.col("m")).alias("k"), "value")))
        worst = F.min(F.when(F.col("m").isNotNull(), F.struct(F.col("m").alias("k"), "value")))
        spread = F.max("m") - F.min("m")
        grouped = means.groupBy("feature").agg(
            spread.alias("spread"), best.alias("best"), worst.alias("worst"),
            F.count("m").alias("n_groups"), F.count("*").alias("n_values"))
        frames.append(
            grouped.filter((F.col("n_groups") >= 2) & few).select(
                "feature", F.lit("categorical").alias("type"),
                F.least(F.lit(1.0), F.col("spread") / std).alias("impact"),
                F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("p_value"),
                "spread", F.col("best.value").alias("best_group"),
                F.col("worst.value").alias("worst_group"), "n_groups"))
    out = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return out.orderBy(F.col("impact").desc(), "feature")


# --- concentration --------------------------------------------------------------------------------

def pareto(df: DataFrame, column: str, min_pct: float = MIN_CONCENTRATION,
           parts: int | None = None) -> DataFrame:
    """Share of the total held by the top fifth of rows, and rows needed for 80 % of it.

    No row if the column has fewer than 20 values, a negative value, no positive total, or a top
    fifth holding less than ``min_pct`` percent. ``parts``: ranges of values (by default the shuffle
    partitions).
    """
    facts, points = _concentration(df, column, parts, curve=False)
    if points is None:
        return df.sparkSession.createDataFrame([], _PARETO_SCHEMA)
    n, total = facts["n"], facts["total"]
    return points.select(
        F.lit(column).alias("column"), F.lit(n).cast("bigint").alias("n"),
        F.lit(total).alias("total"),
        (F.col("p0") / F.lit(total) * 100).alias("top_20_pct"),
        F.col("n_for_80"), (F.col("n_for_80") / F.lit(n) * 100).alias("pct_rows_for_80"),
    ).filter(F.col("top_20_pct") >= min_pct)


_PARETO_SCHEMA = ("column string, n bigint, total double, top_20_pct double, n_for_80 bigint,"
                  " pct_rows_for_80 double")


def cumulative_share(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """(pct_rows, pct_value): how the total accumulates from the largest value down.

    A point at every twentieth of the rows (each row below 40 rows), from the first to the last.
    """
    facts, points = _concentration(df, column, parts, curve=True)
    if points is None:
        return df.sparkSession.createDataFrame([], "pct_rows double, pct_value double")
    ranks, n, total = facts["ranks"], facts["n"], facts["total"]
    rows = [(F.lit(100.0 * r / n), F.col(f"p{i}") / F.lit(total) * 100) for i, r in enumerate(ranks)]
    return unpivot(points, rows, ["pct_rows", "pct_value"])


def _concentration(df: DataFrame, column: str, parts: int | None, curve: bool):
    """(facts, one-row frame): sum of the r largest values for each rank r, rows for 80 %.

    Prefix sums over ranges. Each different value is one row with its count, however often it occurs;
    these rows are dealt to ranges of values and written. A range's own total is carried to all ranges
    below it, so running totals are worked out inside a range, and no task sees more than one.
    """
    v, n = F.col("value"), F.col("n")
    counted = (df.select(as_double(df, column).alias("value")).filter("value IS NOT NULL")
               .groupBy("value").agg(F.count("*").alias("n")))
    ranges = counted.repartitionByRange(parts, v.desc()) if parts else counted.repartitionByRange(v.desc())
    ranges = cut_lineage(ranges.withColumn("part", F.spark_partition_id()))
    totals = ranges.groupBy("part").agg(F.sum("n").alias("rows"), F.sum(v * n).alias("held"), F.min("value").alias("low"))
    totals = totals.orderBy("part").collect()  # one row for each range
    facts = {"n": sum(r["rows"] for r in totals), "total": math.fsum(r["held"] for r in totals)}
    if facts["n"] < 20 or min(r["low"] for r in totals) < 0 or facts["total"] <= 0:
        return facts, None
    size = facts["n"]
    ranks = sorted({*range(1, size + 1, max(1, size // 20)), size}) if curve else [max(1, int(size * TOP_SHARE))]
    facts["ranks"] = ranks
    above, rows, held = [], 0, 0.0
    for r in totals:
        above.append((r["part"], rows, held))
        rows, held = rows + r["rows"], held + r["held"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(above, "part int, rows_above long, sum_above double"))
    w = Window.partitionBy("part").orderBy(v.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranges.join(offsets, "part").select(
        "value", "n", (F.sum("n").over(w) - n + F.col("rows_above")).alias("rows_before"),
        (F.sum(v * n).over(w) - v * n + F.col("sum_above")).alias("sum_before"))
    found = []
    for i, r in enumerate(ranks):
        here = (F.col("rows_before") < r) & (F.col("rows_before") + n >= r)
        found.append(F.max(F.when(here, F.col("sum_before") + (F.lit(r) - F.col("rows_before")) * v)).alias(f"p{i}"))
    if not curve:
        goal = F.lit(facts["total"] * TARGET_SHARE)
        fitting = F.least(n, F.when(v > 0, F.floor(
            (goal - F.col("sum_before")) / F.greatest(v, F.lit(5e-324)))).otherwise(n))
        found.append((F.coalesce(F.sum(F.when(F.col("sum_before") <= goal, fitting)), F.lit(0)) + 1)
                     .cast("bigint").alias("n_for_80"))
    return facts, running.agg(*found)
