"""Streams of processing results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import idle_sessions


def result_stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """Processing results as a stream of Parquet files."""
    schema = spark.read.parquet(path).schema
    pattern = os.path.join(path, "*.parquet") if os.path.isdir(path) else path
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern)


def upsert_index(stream: DataFrame, target: str, checkpoint: str):
    """Keeps the newest hash of each source in the folder ``target``; each batch writes one new version.

    A batch folds its own rows and merges them with the version before by key. Version folders
    carry the batch's number, so a batch that is tried again writes the same folder.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("status = 'converted' and file_hash is not null").select("source_rel", "run_at", "file_hash")
        before = [v for v in versions(spark, target) if v < number]
        rows = new if not before else new.unionByName(spark.read.parquet(f"{target}/version={max(before)}"))
        folded = rows.groupBy("source_rel").agg(F.max(F.struct("run_at", "file_hash")).alias("r")).select("source_rel", "r.*")
        folded.write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> list[int]:
    """The versions in the folder ``target``, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def newest_version(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/version={versions(spark, target)[-1]}")


def first_runs(stream: DataFrame, late: str = "3650 days") -> DataFrame:
    """The first record of each source and hash; later ones within the watermark are dropped by keyed state."""
    return stream.where("file_hash is not null").withWatermark("run_at", late).dropDuplicatesWithinWatermark(["source_rel", "file_hash"])


def complete_documents(stream: DataFrame, totals: DataFrame, late: str = "30 days") -> DataFrame:
    """``sidecar_rel``, ``seen``, ``pages``: each document as soon as all of its pages have been seen; a page counts once.

    ``totals`` is a table with the number of ``pages`` of each document.
    """
    seen = stream.where("ok and page_id is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["sidecar_rel", "page_id"]).groupBy("sidecar_rel").agg(F.count("*").alias("seen"))
    return seen.join(totals.select("sidecar_rel", "pages"), "sidecar_rel").where("seen >= pages")


def expired_flags(stream: DataFrame, key: str, at: str, idle: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Flags that use refreshes, given out once each when nothing refreshed them for ``idle``."""
    return idle_sessions(stream.withWatermark(at, late), key, at, idle)
