"""Helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column to ``digits`` places, or to its own number in ``special``."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def rounded_as_held(df: DataFrame, digits: int) -> DataFrame:
    """Like ``rounded``, but by the binary value that a double holds rather than by its shortest writing,
    which may end in a five that the value does not reach."""
    def near(c: Column) -> Column:
        places = F.abs(c) * 10.0 ** digits
        return F.when(F.isnan(c) | (places >= 2.0 ** 53), c).otherwise(F.signum(c) * F.floor(places + 0.5) / 10.0 ** digits)

    return df.select(*[near(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def once(build: Callable[[SparkSession, str], object]) -> Callable[[SparkSession, str], object]:
    """One run per session and folder, shared by the reports that read its result."""
    done: dict[tuple[str, str], object] = {}

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in done:
            done[key] = build(spark, sf_dir)
        return done[key]

    return run
