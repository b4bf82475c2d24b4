"""Views over the supplied tables: the wide ``sales`` table and its planted-defect twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVENUE = "l_extendedprice * (1 - l_discount)"
COST = "p_retailprice * l_quantity"

# view column -> (SQL expression, tables it needs besides lineitem)
SALES_COLUMNS: dict[str, tuple[str, set[str]]] = {
    "orderkey": ("l_orderkey", set()),
    "linenumber": ("l_linenumber", set()),
    "region": ("r_name", {"orders", "customer", "nation", "region"}),
    "nation": ("n_name", {"orders", "customer", "nation"}),
    "segment": ("c_mktsegment", {"orders", "customer"}),
    "brand": ("p_brand", {"part"}),
    "ptype": ("p_type", {"part"}),
    "priority": ("o_orderpriority", {"orders"}),
    "status": ("o_orderstatus", {"orders"}),
    "returnflag": ("l_returnflag", set()),
    "ts": ("l_shipdate", set()),
    "quantity": ("l_quantity", set()),
    "discount": ("l_discount", set()),
    "tax": ("l_tax", set()),
    "revenue": (REVENUE, set()),
    "cost": (COST, {"part"}),
    "profit": (f"{REVENUE} - {COST}", {"part"}),
}

# join order: (table, condition); each table only joins when a wanted column needs it
JOINS = [
    ("part", "l_partkey = p_partkey"),
    ("orders", "l_orderkey = o_orderkey"),
    ("customer", "o_custkey = c_custkey"),
    ("nation", "c_nationkey = n_nationkey"),
    ("region", "n_regionkey = r_regionkey"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The wide sales table, restricted to ``columns`` (all when none are given).

    The keys are foreign keys, so a table that contributes no wanted column is not joined: a
    question about quantity by return flag scans two columns of lineitem and joins nothing.
    Whether a joined side is broadcast is left to Spark, which knows its size.
    """
    wanted = columns or tuple(SALES_COLUMNS)
    needed = set().union(*[SALES_COLUMNS[c][1] for c in wanted])
    df = table(spark, sf_dir, "lineitem")
    for name, condition in JOINS:
        if name in needed:
            df = df.join(table(spark, sf_dir, name), F.expr(condition))
    return df.select(*[F.expr(SALES_COLUMNS[c][0]).alias(c) for c in wanted])


# Planted defects, built from integer keys so that any engine builds the same rows.
DIRTY_COLUMNS: dict[str, str] = {
    "row_id": "cast(l_orderkey * 10 + l_linenumber as bigint)",
    "segment": "case when l_orderkey % 11 = 0 then ' n/a ' "
               "when l_orderkey % 7 = 0 then upper(c_mktsegment) "
               "when l_orderkey % 5 = 0 then concat('  ', lower(c_mktsegment), ' ') "
               "else concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2))) end",
    "revenue": f"case when l_orderkey % 10 <> 0 then {REVENUE} end",
    "quantity": "case when l_linenumber % 3 <> 0 then l_quantity end",
    "money": "concat('$', cast(cast(l_partkey * 1000 + l_linenumber as bigint) as varchar(20)))",
    "units_txt": "case when l_partkey % 50 = 0 then 'many' "
                 "else cast(cast(l_quantity as bigint) as varchar(20)) end",
    "flag": "case when l_linenumber % 2 = 0 then 'Yes' else 'no' end",
    "day_txt": "case when l_orderkey % 13 = 0 then 'not a date' else "
               "concat(cast(1995 + l_orderkey % 7 as varchar(4)), '-0', "
               "cast(1 + l_orderkey % 9 as varchar(1)), '-1', cast(l_linenumber as varchar(1))) end",
    "sparse": "case when l_orderkey % 20 = 0 then l_tax end",
    "constant": "'same'",
}


def dirty_sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Sales rows with missing values, null words, case variants, text numbers and duplicates."""
    wanted = columns or tuple(DIRTY_COLUMNS)
    df = table(spark, sf_dir, "lineitem")
    if "segment" in wanted:
        df = df.join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
        df = df.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    return df.select(*[F.expr(DIRTY_COLUMNS[c]).alias(c) for c in wanted])
