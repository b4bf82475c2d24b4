"""Reading tables and checking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.functions.exprs import col


def read_table(spark: SparkSession, path: str, fmt: str = "csv", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with header (malformed rows skipped, values as text), or a parquet / JSON / ORC table.

    CSV values stay text: logical types are voted by the profile over all rows, not guessed from
    the first ones.
    """
    if fmt == "csv":
        df = (
            spark.read.option("header", True).option("mode", "DROPMALFORMED")
            .option("columnPruning", False).option("encoding", encoding).csv(path)
        )
        return clean_header(df)
    return clean_header(spark.read.format(fmt).load(path))


def clean_header(df: DataFrame) -> DataFrame:
    """Column names trimmed; nameless columns (blank, ``Unnamed...``, ``_c0``...) dropped."""
    kept = [(c, c.strip()) for c in df.columns
            if c.strip() and not c.strip().startswith("Unnamed")
            and not (c.startswith("_c") and c[2:].isdigit())]
    return df.select(*[col(c).alias(name) for c, name in kept])


def check_shape(df: DataFrame) -> DataFrame:
    """The frame itself if it has a row and two columns; ValueError otherwise."""
    if len(df.columns) < 2:
        raise ValueError(f"need at least 2 columns, found {len(df.columns)}")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df
