"""Registered queries: what is written, read back; what a profile says about columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import predicates, profiling
from assay.session import cut_lineage, scratch_path
from assay.sources.readers import check_shape, read_table
from assay.sources.sinks import write_clean
from assay.sources.tables import dirty_sales, sales, table


def _csv_round_trip(spark, sf_dir):
    """Orders as CSV with a header and back: all text, without the internal column."""
    path = scratch_path(spark)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias(" priority "),
        F.lit(1).alias("__outlier_flag__"))
    write_clean(orders, path)
    return check_shape(read_table(spark, path))


def _json_round_trip(spark, sf_dir):
    """The properties of events as parsed values, from the text and from JSON made of them again."""
    props = F.from_json("props", "k bigint")
    again = F.from_json(F.to_json(props), "k bigint")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), again["k"].alias("again"))


def _typed_columns(spark, sf_dir):
    # a profile reads its table many times: the joins are done once
    prof = profiling.profile(cut_lineage(sales(spark, sf_dir, "region", "ts", "revenue", "quantity", "returnflag")))
    names = [(t, c) for t in ("numeric", "categorical", "datetime") for c in predicates.typed_columns(prof, t)]
    return spark.createDataFrame(names, "dtype string, column string")


QUERIES = {
    "csv_round_trip": _csv_round_trip,
    "json_round_trip": _json_round_trip,
    "typed_columns": _typed_columns,
    "ml_eligible": lambda s, d: profiling.ml_eligible(profiling.profile(dirty_sales(s, d, "row_id", "revenue", "quantity"))),
}

ORACLE = {
    "csv_round_trip": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
        o_orderpriority || ', ' || o_orderstatus AS priority FROM orders""",
    "json_round_trip": """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.k' AS BIGINT) AS again
        FROM events""",
    "typed_columns": """SELECT * FROM (VALUES ('numeric', 'revenue'), ('numeric', 'quantity'),
        ('categorical', 'region'), ('categorical', 'returnflag'), ('datetime', 'ts')) t(dtype, "column")
        WHERE EXISTS (SELECT 1 FROM lineitem)""",
    "ml_eligible": "SELECT count(*) >= 20 AS ml_eligible FROM lineitem",
}
