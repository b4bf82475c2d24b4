"""Exact duplicates by a tree merge of digest runs.

Every input partition makes a run: one row for each digest, with the best row seen and a count.
In each round ``fan_in`` neighbouring runs meet (run // fan_in), each digest in a task of its own
choice, and are merged; after log(runs) rounds one run is left. The answers then go down the same
tree to the rows. A digest that a third of all rows share is therefore one row per run on every
level, in both directions, and no task ever sees its rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.texts import named, squeezed, text_or_empty
from assay.session import cut_lineage

#: rows are equal if all three agree: the digest, a second hash and the length guard each other
KEYS = ["digest", "second", "length"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     row_col: str | None = None, fan_in: int = 8) -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Texts are equal when identical without white space; a null text counts as empty, and all empty
    texts are one group. Of a group the longest original text stays (code points), then the
    smallest id; null ids come last. Rows that repeat an id and a text are told apart by
    ``row_col`` (a unique column, such as ``monotonically_increasing_id()`` of a written table) or
    by their place in this run, so exactly one row of each group has ``kept``. An empty table gives
    no rows. Only the two or three named columns are read; other columns do not matter.

    Columns: ``doc_id`` (the id column's values), ``row_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    text = text_or_empty(text_col)
    row = named(row_col) if row_col else F.monotonically_increasing_id()
    rows = cut_lineage(docs.select(
        named(id_col).alias("doc_id"), row.alias("row_id"), F.char_length(text).alias("chars"),
        squeezed(text).alias("body"),
    ).select(
        "doc_id", "row_id", "chars", F.unhex(F.sha2(F.col("body"), 256)).alias("digest"),
        F.xxhash64("body").alias("second"), F.char_length("body").alias("length"),
        F.spark_partition_id().alias("run"),
    ))
    best = F.struct((-F.col("chars")).alias("rank"), F.col("doc_id").isNull().alias("no_id"),
                    F.col("doc_id").alias("id"), F.col("row_id").alias("row"))
    levels = [cut_lineage(rows.groupBy("run", *KEYS).agg(
        F.min(best).alias("best"), F.count(F.lit(1)).alias("n")))]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        merged = levels[-1].withColumn("run", (F.col("run") / fan_in).cast("int"))
        levels.append(cut_lineage(merged.groupBy("run", *KEYS).agg(
            F.min("best").alias("best"), F.sum("n").alias("n"))))
        runs = -(-runs // fan_in)
    known = levels.pop()
    for level in reversed(levels):
        above = known.withColumnRenamed("run", "above")
        known = (level.select("run", *KEYS).withColumn("above", (F.col("run") / fan_in).cast("int"))
                 .join(above, ["above", *KEYS]).drop("above"))
    kept = F.col("row_id") == F.col("best.row")
    return rows.join(known, ["run", *KEYS]).select(
        "doc_id", "row_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
