"""Session settings for local runs, and the folder that lineage is cut into."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: rows below which a part of a table is not divided further
PART_ROWS = 50_000


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("assay")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ASSAY_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master (tests, one machine) may go without: there a temporary folder is made, once
    per session. Elsewhere executors do not see each other's disks, so an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="assay-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder; what is written there goes when the application ends."""
    path = f"{checkpoint_folder(spark)}/assay-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_open: list[list[str]] = []


@contextmanager
def written_tables() -> Iterator[list[str]]:
    """Lists the tables that ``cut_lineage`` writes inside, for who can tell when they are no longer read."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        _open.pop()


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes written tables now rather than when the application ends."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the checkpoint folder, and read back from there.

    A written table survives lost executors like a checkpoint does, and unlike a checkpoint it is
    columnar: later passes read only the columns they name. It is deleted when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_evenly(df: DataFrame, least: int = PART_ROWS) -> DataFrame:
    """``cut_lineage``, written anew for all cores where one part holds more than twice a core's share.

    A table of one file and row group lies in one part, and every later pass over it would be one task.
    No part gets fewer than ``least`` rows, so a small table stays as it is.
    """
    spark = df.sparkSession
    with written_tables() as made:
        table = cut_lineage(df)
    sizes = table.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("n"), F.max("count").alias("largest")).first()
    n = sizes["n"] or 0
    parts = min(spark.sparkContext.defaultParallelism, n // least)
    if parts > 1 and sizes["largest"] * parts > 2 * n:
        even = cut_lineage(table.repartition(parts))
        drop_tables(spark, made)
        return even
    if _open:
        _open[-1].extend(made)
    return table


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame that several jobs read; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

