"""Helpers that every job shares: table access, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root`` (a file or a directory of part files)."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it in ``spark.checkpoint.dir``.

    Only a local session (tests, one machine) may go without: it gets a folder under the SQL
    warehouse. On a cluster a missing setting is an error, as a machine's own folder is lost
    with the machine.
    """
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and context.getCheckpointDir().isDefined():
        folder = context.getCheckpointDir().get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a compressed table and read back.

    Unlike a checkpoint of rows it is columnar and has statistics, so later joins read only
    the columns they need and Spark can choose how to join.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, most_rows: int) -> list | None:
    """The rows of ``df`` if there are at most ``most_rows``, else None.

    At most ``most_rows + 1`` rows ever reach the driver, so the caller can offer a
    broadcast for a proven size and a shuffle beyond it.
    """
    rows = df.limit(most_rows + 1).collect()
    return None if len(rows) > most_rows else rows


def is_small(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows, without reading on beyond them."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint only where its row count was checked; otherwise unchanged."""
    return F.broadcast(df) if is_small(df, most_rows) else df
