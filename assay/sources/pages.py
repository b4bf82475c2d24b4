"""Pages of a table in a stated order, by an index of ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from assay.functions.exprs import col


def _place(df: DataFrame, keys: list[str]) -> Column:
    """The keys as one value whose order is theirs, missing values last."""
    return F.struct(*[part for i, k in enumerate(keys)
                      for part in (col(k).isNull().alias(f"n{i}"), col(k).alias(f"k{i}"))])


@dataclass
class PageIndex:
    """Ranges of key values with the rows in each; ``ranges``: lowest place, highest place, rows."""

    df: DataFrame
    keys: list[str]
    ranges: list[tuple[Row, Row, int]]

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def page(self, offset: int = 0, n: int = 100) -> DataFrame:
        """``n`` rows (at least 1) from ``offset`` on, in order, with the total row count.

        Only rows in the ranges that the page touches are sorted. The bounds of the first key are plain
        comparisons, which reach the scan.
        """
        offset, n = max(0, offset), max(1, n)
        touched, before, skipped = [], 0, 0
        for low, high, rows in self.ranges:
            if before + rows <= offset:
                skipped = before + rows
            elif before < offset + n:
                touched.append((low, high))
            before += rows
        if not touched:
            return self.df.limit(0).withColumn("total_rows", F.lit(self.total).cast("bigint"))
        low, high = touched[0][0], touched[-1][1]
        place = _place(self.df, self.keys)
        types = self.df.select(place.alias("p")).schema["p"].dataType

        def bound(row: Row) -> Column:
            return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, types)])

        inside = (place >= bound(low)) & (place <= bound(high))
        first = col(self.keys[0])
        if low["k0"] is not None:
            inside &= (first >= F.lit(low["k0"]).cast(types["k0"].dataType)) | first.isNull()
        if high["k0"] is not None:
            inside &= first <= F.lit(high["k0"]).cast(types["k0"].dataType)
        page = self.df.where(inside).orderBy(*[col(k).asc_nulls_last() for k in self.keys])
        return page.offset(offset - skipped).limit(n).withColumn("total_rows", F.lit(self.total).cast("bigint"))


def page_index(df: DataFrame, order_by: str | list[str], parts: int | None = None) -> PageIndex:
    """The index of ranks of ``df``, to be asked for any number of pages.

    Keys alone are dealt to ``parts`` ranges (by default the shuffle partitions of the session) and
    counted there; rows stay where they are. Rows with equal keys share a range, so a page inside a very
    long run of equal keys sorts that run: add keys until the order is total, which it must be for pages
    that neither overlap nor leave out rows.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(_place(df, keys).alias("place")).repartitionByRange(parts, "place")
    found = dealt.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n"))
    ranges = found.orderBy("part").collect()  # one row for each range
    return PageIndex(df, keys, [(r["low"], r["high"], r["n"]) for r in ranges])
