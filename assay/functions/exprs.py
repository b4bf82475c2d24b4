"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-9  # denominators are never smaller than this

# Text that counts as a plain number.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: str | Column) -> Column:
    """A column by name (dots and spaces in the name allowed) or as given."""
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clamped_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / max(|denominator|, 1e-9): never divides by zero."""
    return numerator / F.greatest(F.abs(denominator), F.lit(TINY))


def to_number(c: str | Column) -> Column:
    """Text to double; anything that is not entirely a number becomes NULL."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def month_of(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def sum0(c: Column) -> Column:
    """Sum that is 0 rather than NULL when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson r over the rows where both are present; NULL if either is constant."""
    x, y = col(x), col(y)
    a = F.when(y.isNotNull(), x).cast("double")
    b = F.when(x.isNotNull(), y).cast("double")
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def skewness(c: str | Column) -> Column:
    """Bias-corrected sample skewness."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)


def kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)


def strength(r: Column) -> Column:
    """Label of a correlation: very strong / strong / moderate / weak at .8 / .6 / .4."""
    a = F.abs(r)
    return (
        F.when(a >= 0.8, "very strong").when(a >= 0.6, "strong")
        .when(a >= 0.4, "moderate").otherwise("weak")
    )


def totals_of(df: DataFrame, **aggregates: Column) -> Column:
    """One-row aggregates of ``df`` as a struct column (an uncorrelated scalar subquery).

    Used where every row of a grouped frame is compared with figures of the whole frame: an
    unpartitioned window would move all groups into one task, this moves one row.
    """
    fields = F.struct(*[c.alias(name) for name, c in aggregates.items()])
    return df.select(fields.alias("totals")).scalar()


def add_totals(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with one-row aggregates over all of it appended as columns.

    ``df`` (a grouped frame) is wanted twice, row by row and in total. The totals read all of its
    columns, so both uses have the same shuffle and Spark runs it once.
    """
    whole = F.max(F.struct(*[col(c) for c in df.columns]))
    return (
        df.withColumn("__t", totals_of(df, **aggregates, __all=whole))
        .select(*[col(c) for c in df.columns],
                *[F.col(f"__t.{name}").alias(name) for name in aggregates])
    )


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low), 0.5 when all values are equal."""
    return F.when(high > low, F.try_divide(value - low, high - low)).otherwise(F.lit(0.5))


def unpivot(df: DataFrame, fields: list[tuple[Column, ...]], names: list[str]) -> DataFrame:
    """One row per entry of ``fields`` for each row of ``df`` (each entry is a tuple of columns)."""
    rows = F.array(*[F.struct(*[c.alias(n) for c, n in zip(f, names)]) for f in fields])
    return df.select(F.inline(rows))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
