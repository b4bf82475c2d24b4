"""Filters, thresholds and counts under conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import TINY, col, ratio
from assay.functions.orderstats import LIMIT, quantile_row

# Vague word -> percentile; FENCE_WORDS mean "beyond the upper fence", LOW_WORDS look below.
WORD_PERCENTILES: dict[str, float] = {
    "high": 0.75, "highest": 0.75, "large": 0.75,
    "low": 0.25, "lowest": 0.25, "small": 0.25,
    "very high": 0.90, "extreme": 0.90, "very low": 0.10,
    "average": 0.50, "typical": 0.50, "threshold": 0.75,
}
FENCE_WORDS = ("unusual", "abnormal", "outlier")
LOW_WORDS = ("low", "lowest", "small", "very low")


def filter_eq(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose text form equals ``value``, ignoring case.

    An empty result is the answer "no such value"; it is not turned into an error, which would
    cost a second pass over the data.
    """
    return df.filter(F.lower(col(column).cast("string")) == F.lower(F.lit(str(value))))


def resolve_thresholds(df: DataFrame, wanted: dict[str, tuple[str, str]],
                       limit: int = LIMIT) -> DataFrame:
    """One row of cutoffs: name -> (column, vague word). Unknown words mean the 75th percentile."""
    quantiles: dict[str, tuple[str, float]] = {}
    for name, (column, word) in wanted.items():
        if word.lower().strip() in FENCE_WORDS:
            quantiles[f"{name}__q1"] = (column, 0.25)
            quantiles[f"{name}__q3"] = (column, 0.75)
        else:
            quantiles[name] = (column, WORD_PERCENTILES.get(word.lower().strip(), 0.75))
    row = quantile_row(df, quantiles, limit)
    values = []
    for name, (_, word) in wanted.items():
        if word.lower().strip() in FENCE_WORDS:
            q1, q3 = F.col(f"{name}__q1"), F.col(f"{name}__q3")
            value = q3 + 1.5 * (q3 - q1)
        else:
            value = F.col(name)
        values.append(F.coalesce(value, F.lit(0.0)).alias(name))
    return row.select(*values)


def resolve_threshold(df: DataFrame, column: str, word: str, limit: int = LIMIT) -> DataFrame:
    """One row, one column ``cutoff``."""
    return resolve_thresholds(df, {"cutoff": (column, word)}, limit)


def _beyond(column: str, word_or_direction: str, cutoff: Column) -> Column:
    low = word_or_direction.lower().strip() in LOW_WORDS or word_or_direction == "below"
    return col(column) <= cutoff if low else col(column) >= cutoff


def threshold_analysis(df: DataFrame, column: str, cutoff: float, target: str,
                       direction: str = "above", limit: int = LIMIT) -> DataFrame:
    """Rows at or beyond a cutoff: count, share of all rows, mean / sum / median of the target."""
    hit = _beyond(column, direction, F.lit(cutoff))
    values = df.select(F.when(hit, F.lit(1)).alias("hit"),
                       F.when(hit, col(target).cast("double")).alias("v"))
    return quantile_row(values, {"target_median": ("v", 0.5)}, limit, also={
        "n_rows": F.count("hit"),
        "pct_of_data": ratio(F.count("hit"), F.count("*")) * 100,
        "target_mean": F.avg("v"),
        "target_sum": F.sum("v"),
    })


def compound_filter(df: DataFrame, first: tuple[str, str], second: tuple[str, str],
                    limit: int = LIMIT) -> DataFrame:
    """Two vague conditions at once: ("revenue", "high") and ("discount", "low").

    One row: cutoffs, matching rows, share, and mean / min / max of both columns among them.
    """
    cutoffs = resolve_thresholds(df, {"a": first, "b": second}, limit)
    cut = cutoffs.select(F.struct("a", "b")).scalar()
    both = _beyond(*first, F.col("cut.a")) & _beyond(*second, F.col("cut.b"))
    marked = df.withColumn("cut", cut).withColumn("hit", both)
    a, b = (F.when(F.col("hit"), col(c)) for c, _ in (first, second))
    return marked.agg(
        F.max("cut.a").alias("cutoff_a"), F.max("cut.b").alias("cutoff_b"),
        F.count_if("hit").alias("n_rows"),
        (ratio(F.count_if("hit"), F.count("*")) * 100).alias("pct_of_data"),
        F.avg(a).alias("mean_a"), F.min(a).alias("min_a"), F.max(a).alias("max_a"),
        F.avg(b).alias("mean_b"), F.min(b).alias("min_b"), F.max(b).alias("max_b"),
    )


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows meet a condition, and their share of all rows."""
    return df.agg(
        F.count_if(condition).alias("n_rows"),
        (ratio(F.count_if(condition), F.count("*")) * 100).alias("pct_of_data"),
    )


def count_where_greater(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where column a exceeds column b, e.g. cost above revenue."""
    return count_where(df, col(a) > col(b))


def compound_count(df: DataFrame, column: str, cutoff: float, profit: str | None = None,
                   direction: str = "above") -> DataFrame:
    """Rows beyond a cutoff that, if a profit column is named, also made a profit."""
    condition = _beyond(column, direction, F.lit(cutoff))
    if profit:
        condition = condition & (col(profit) > 0)
    return count_where(df, condition)


def year_total(df: DataFrame, ts: str, metric: str, year: int) -> DataFrame:
    """Total of a metric and number of rows in one calendar year.

    The year is written as a range on the timestamp, so the filter reaches the parquet scan.
    """
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    inside = (col(ts) >= start) & (col(ts) < end)
    return df.filter(inside).agg(
        F.lit(year).alias("year"),
        F.coalesce(F.sum(col(metric)), F.lit(0.0)).alias("total"),
        F.count("*").alias("n_rows"),
    )


def complete_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both columns are present."""
    return df.filter(col(a).isNotNull() & col(b).isNotNull())


def typed_columns(profile: DataFrame, *types: str) -> list[str]:
    """Names of the profiled columns of the given logical types, in table order.

    Reads the profile (one row per column), never the data.
    """
    rows = profile.filter(F.col("dtype").isin(*types)).orderBy("position").select("column").collect()
    return [r["column"] for r in rows]


def metric_columns(profile: DataFrame) -> list[str]:
    """Columns that can be aggregated: true measures first, 0/1 columns only if there are none."""
    return typed_columns(profile, "numeric") or typed_columns(profile, "boolean")


def scenario_means(df: DataFrame, column: str, target: str, word: str = "high",
                   limit: int = LIMIT) -> DataFrame:
    """Mean of the target where the column is at or above a cutoff, against where it is below."""
    cut = resolve_threshold(df, column, word, limit).scalar()
    marked = df.withColumn("cut", cut)
    y = col(target).cast("double")
    high = F.when(col(column) >= F.col("cut"), y)
    low = F.when(col(column) < F.col("cut"), y)
    difference = F.avg(high) - F.avg(low)
    return marked.agg(
        F.max("cut").alias("cutoff"),
        F.avg(high).alias("high_mean"), F.avg(low).alias("low_mean"),
        difference.alias("difference"),
        (F.abs(difference) / F.greatest(F.abs(F.avg(low)), F.lit(TINY)) * 100).alias("pct_difference"),
        F.count(high).alias("high_n"), F.count(low).alias("low_n"),
    ).filter((F.col("high_n") >= 2) & (F.col("low_n") >= 2))


def what_if(df: DataFrame, x: str, y: str, pct: float) -> DataFrame:
    """Shift the mean of x by pct percent and move y along the observed regression line."""
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    xs, ys = F.when(both, a), F.when(both, b)
    slope = F.try_divide(F.covar_samp(xs, ys), F.var_samp(xs))
    r = F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))
    shift = F.col("current_mean") * (pct / 100.0)
    return (
        df.agg(F.avg(a).alias("current_mean"), F.avg(b).alias("current_target_mean"),
               slope.alias("slope"), r.alias("r"), F.count_if(both).alias("n"))
        .filter(F.col("n") >= 5)
        .select("current_mean", (F.col("current_mean") + shift).alias("simulated_mean"),
                "current_target_mean",
                (F.col("current_target_mean") + F.col("slope") * shift).alias("simulated_target_mean"),
                "slope", "r", "n")
    )


