"""Aggregates over groups, segments and seasons.

Groups are aggregated map-side first, so a key holding a third of all rows costs one partial row
per task. Figures over all groups come from a scalar subquery (``add_totals``), not from an
unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import (
    add_totals, clamped_ratio, col, ratio, sum0, unpivot)
from assay.functions.orderstats import LIMIT, quantile_row

# Short names of months and weekdays, Monday first.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def aggregate(df: DataFrame, *columns: str) -> DataFrame:
    """Total, mean, non-null count, maximum and minimum of each column, one row per column."""
    aggs = [
        F.struct(sum0(col(c)).alias("total"), F.avg(col(c)).alias("mean"),
                 F.count(col(c)).alias("n"), F.max(col(c)).alias("max"),
                 F.min(col(c)).alias("min")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    one = df.agg(*aggs)
    names = ["column", "total", "mean", "n", "max", "min"]
    fields = [(F.lit(c), *[F.col(f"c{i}.{k}") for k in names[1:]]) for i, c in enumerate(columns)]
    return unpivot(one, fields, names)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def group_count(df: DataFrame, key: str) -> DataFrame:
    """Number of distinct values of a group key (the guard of every comparison)."""
    return df.agg(F.count_distinct(col(key)).alias("n_groups"))


def _grouped(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    present = df
    for key in keys:
        present = present.filter(col(key).isNotNull())
    m = col(metric)
    return present.groupBy(*[col(k) for k in keys]).agg(
        sum0(m).alias("total"), F.avg(m).alias("average"), F.count(m).alias("n"))


def group_summary(df: DataFrame, key: str, metric: str, order_by: str = "total",
                  max_groups: int | None = None) -> DataFrame:
    """Total, average and count per group, and how far each lies from the mean of the groups.

    ``order_by`` is "total" or "average"; the comparison with the mean uses the same measure. A
    caller may refuse comparisons of more than ``max_groups`` groups: then no rows come back.
    """
    measure = F.col(order_by)
    out = add_totals(_grouped(df, [key], metric),
                     group_mean=F.avg(measure), n_groups=F.count("*"))
    if max_groups is not None:
        out = out.filter(F.col("n_groups") <= max_groups)
    return (
        out.withColumn("pct_vs_mean",
                       clamped_ratio(measure - F.col("group_mean"), F.col("group_mean")) * 100)
        .orderBy(measure.desc_nulls_last(), col(key))
    )


def group_compare_two(df: DataFrame, a: str, b: str, metric: str,
                      max_cells: int | None = None) -> DataFrame:
    """Totals over two categories and their distance from the mean cell.

    ``max_cells``, if a caller sets it, refuses larger comparisons (no rows); it counts distinct a
    times distinct b, whether or not each combination occurs.
    """
    grouped = _grouped(df, [a, b], metric).drop("average", "n")
    out = add_totals(grouped, cell_mean=F.avg("total"),
                     n_a=F.count_distinct(col(a)), n_b=F.count_distinct(col(b)))
    if max_cells is not None:
        out = out.filter(F.col("n_a") * F.col("n_b") <= max_cells)
    return (
        out.withColumn("label", F.concat_ws(" / ", col(a), col(b)))
        .withColumn("pct_vs_mean",
                    clamped_ratio(F.col("total") - F.col("cell_mean"), F.col("cell_mean")) * 100)
        .drop("n_a", "n_b")
        .orderBy(F.col("total").desc_nulls_last(), col(a), col(b))
    )


def category_relationship(df: DataFrame, key: str, metric: str,
                          by: str = "total", max_groups: int | None = None) -> DataFrame:
    """Leading and trailing group, the gap between them and the gap in percent: one row.

    No row without a group, or with more than ``max_groups`` where a caller sets that.
    """
    few = F.lit(True) if max_groups is None else F.col("n_groups") <= max_groups
    measure = F.col(by)
    gap = F.col("top_value") - F.col("bottom_value")
    grouped = _grouped(df, [key], metric).filter(measure.isNotNull())
    # ties go to the smallest key in both directions
    best = F.min(F.struct((-measure).alias("rank"), col(key).alias("name"), measure.alias("value")))
    worst = F.min(F.struct(measure.alias("rank"), col(key).alias("name"), measure.alias("value")))
    return (
        grouped.agg(F.count("*").alias("n_groups"), best.alias("best"), worst.alias("worst"))
        .filter((F.col("n_groups") > 0) & few)
        .select("n_groups",
                F.col("best.name").alias("top_group"), F.col("best.value").alias("top_value"),
                F.col("worst.name").alias("bottom_group"),
                F.col("worst.value").alias("bottom_value"))
        .withColumn("gap", gap)
        .withColumn("gap_pct", F.abs(clamped_ratio(F.col("gap"), F.col("bottom_value"))) * 100)
    )


def groups_vs_average(df: DataFrame, key: str, metric: str, side: str = "above",
                      by: str = "total") -> DataFrame:
    """Groups strictly above (or below) the mean of the groups."""
    measure = F.col(by)
    out = add_totals(_grouped(df, [key], metric).select(col(key), measure),
                     group_mean=F.avg(measure))
    keep = measure > F.col("group_mean") if side == "above" else measure < F.col("group_mean")
    order = measure.desc() if side == "above" else measure.asc()
    return (
        out.filter(keep).select(col(key), measure.alias("value"), "group_mean")
        .orderBy(order, col(key))
    )


def quarter_totals(df: DataFrame, ts: str, metric: str) -> DataFrame:
    """Total per calendar quarter (all years together), with the peak marked."""
    totals = (
        df.filter(col(ts).isNotNull() & col(metric).isNotNull())
        .groupBy(F.concat(F.lit("Q"), F.quarter(col(ts)).cast("string")).alias("quarter"))
        .agg(F.sum(col(metric)).alias("total"))
    )
    out = add_totals(totals, peak=F.max_by("quarter", "total"))
    return (
        out.select("quarter", "total", (F.col("quarter") == F.col("peak")).alias("is_peak"))
        .orderBy("quarter")
    )


def compare_quarters(df: DataFrame, ts: str, metric: str, first: int, second: int) -> DataFrame:
    """One quarter against another: both totals and the difference in percent."""
    q, m = F.quarter(col(ts)), col(metric)
    return (
        df.agg(sum0(F.when(q == first, m)).alias("first_total"),
               sum0(F.when(q == second, m)).alias("second_total"))
        .withColumn("pct_difference",
                    clamped_ratio(F.col("first_total") - F.col("second_total"),
                                  F.col("second_total")) * 100)
    )


def share_of_total(df: DataFrame, metric: str, condition: Column) -> DataFrame:
    """Part of a metric's total that falls on the rows meeting a condition."""
    m = col(metric)
    return (
        df.agg(sum0(F.when(condition, m)).alias("subset_total"), sum0(m).alias("overall_total"))
        .withColumn("pct_of_total",
                    clamped_ratio(F.col("subset_total"), F.col("overall_total")) * 100)
    )


def group_ratio(df: DataFrame, key: str, a: object, b: object, metric: str) -> DataFrame:
    """Total of group a divided by the total of group b."""
    m = col(metric)
    return (
        df.filter(col(key).isin(a, b))
        .agg(sum0(F.when(col(key) == F.lit(a), m)).alias("total_a"),
             sum0(F.when(col(key) == F.lit(b), m)).alias("total_b"))
        .withColumn("ratio", clamped_ratio(F.col("total_a"), F.col("total_b")))
    )


def segment_comparison(df: DataFrame, key: str, a: object, b: object,
                       metrics: list[str]) -> DataFrame:
    """Means of several metrics in two segments, difference, percent and the winner."""
    text = col(key).cast("string")
    one = df.filter(text.isin(str(a), str(b))).agg(*[
        F.struct(F.avg(F.when(text == str(a), col(m))).alias("a"),
                 F.avg(F.when(text == str(b), col(m))).alias("b")).alias(f"m{i}")
        for i, m in enumerate(metrics)
    ])
    rows = unpivot(one, [(F.lit(m), F.col(f"m{i}.a"), F.col(f"m{i}.b"))
                         for i, m in enumerate(metrics)], ["metric", "mean_a", "mean_b"])
    difference = F.col("mean_a") - F.col("mean_b")
    return (
        rows.filter(F.col("mean_a").isNotNull() & F.col("mean_b").isNotNull())
        .withColumn("difference", difference)
        .withColumn("pct_difference",
                    F.abs(clamped_ratio(F.col("difference"), F.col("mean_b"))) * 100)
        .withColumn("winner", F.when(F.col("mean_a") >= F.col("mean_b"), F.lit(str(a)))
                    .otherwise(F.lit(str(b))))
    )


def derived_metric(df: DataFrame, numerator: str, denominator: str,
                   limit: int = LIMIT) -> DataFrame:
    """Mean, median, std, minimum, maximum and count of numerator / denominator."""
    derived = df.select(ratio(col(numerator), col(denominator)).alias("d"))
    return quantile_row(derived, {"median": ("d", 0.5)}, limit, also={
        "mean": F.avg("d"), "std": F.stddev_samp("d"), "min": F.min("d"), "max": F.max("d"),
        "n": F.count("d")}).filter(F.col("n") > 0)


def derived_metric_by_group(df: DataFrame, numerator: str, denominator: str, key: str,
                            n: int = 10) -> DataFrame:
    """The n groups with the highest mean of numerator / denominator."""
    d = ratio(col(numerator), col(denominator))
    return (
        df.filter(col(key).isNotNull()).select(col(key), d.alias("d")).filter("d IS NOT NULL")
        .groupBy(col(key)).agg(F.avg("d").alias("mean_ratio"))
        .orderBy(F.col("mean_ratio").desc(), col(key)).limit(n)
    )


def open_summary(df: DataFrame, metrics: list[str], limit: int = LIMIT) -> DataFrame:
    """Mean, median and standard deviation of every metric."""
    one = quantile_row(df, {f"median{i}": (m, 0.5) for i, m in enumerate(metrics)}, limit, also={
        f"m{i}": F.struct(F.avg(col(m)).alias("mean"), F.stddev_samp(col(m)).alias("std"))
        for i, m in enumerate(metrics)})
    return unpivot(one, [(F.lit(m), F.col(f"m{i}.mean"), F.col(f"median{i}"), F.col(f"m{i}.std"))
                         for i, m in enumerate(metrics)], ["column", "mean", "median", "std"])


def seasonal_pattern(df: DataFrame, ts: str, metric: str) -> DataFrame:
    """Mean per month, weekday and quarter, with the peak of each season marked.

    The data is reduced once to sums per month and weekday (at most 84 rows); the three seasons
    are read from those.
    """
    month, weekday = F.month(col(ts)), F.weekday(col(ts))
    parts = (
        df.filter(col(ts).isNotNull() & col(metric).isNotNull())
        .groupBy(month.alias("m"), weekday.alias("d"))
        .agg(F.sum(col(metric)).alias("s"), F.count("*").alias("n"))
    )
    months = F.array(*[F.lit(x) for x in MONTH_NAMES])
    days = F.array(*[F.lit(x) for x in DAY_NAMES])
    quarter = F.ceil(F.col("m") / 3).cast("int")
    rows = unpivot(parts, [
        (F.lit("month"), F.col("m"), months[F.col("m") - 1], F.col("s"), F.col("n")),
        (F.lit("weekday"), F.col("d"), days[F.col("d")], F.col("s"), F.col("n")),
        (F.lit("quarter"), quarter, F.concat(F.lit("Q"), quarter.cast("string")),
         F.col("s"), F.col("n")),
    ], ["season", "position", "period", "s", "n"])
    means = rows.groupBy("season", "position", "period").agg(
        (F.sum("s") / F.sum("n")).alias("mean"))
    peaks = means.groupBy("season").agg(F.max("mean").alias("peak"))
    return (
        means.join(peaks, "season")
        .select("season", "position", "period", "mean",
                (F.col("mean") == F.col("peak")).alias("is_peak"))
        .orderBy("season", "position")
    )
