"""Search, filter and order of listings."""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut_lineage


def top_matches(rows: DataFrame, name: str, term: str, newest: str, key: str, most: int = 10) -> DataFrame:
    """The ``most`` newest rows whose name contains ``term``, whatever the case; rows without time come first."""
    return rows.where(F.col(name).ilike(f"%{term}%")).orderBy(F.col(newest).desc_nulls_first(), F.col(key)).limit(most)


def partial_ratio(term: str, name: str) -> float:
    """Similarity, 0 to 100, of the shorter text and the best window of the longer one."""
    short, long = sorted((term, name), key=len)
    if not short:
        return 0.0 if long else 100.0
    best = 0.0
    for a, b, _ in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        at = max(0, b - a)
        best = max(best, SequenceMatcher(None, short, long[at : at + len(short)], autojunk=False).ratio())
    return 100.0 * best


def fuzzy_filter(rows: DataFrame, name: str, term: str, least: float = 90.0) -> DataFrame:
    """Rows whose name resembles ``term``, with their ``score``; each distinct name is scored once.

    A window that reaches ``least`` differs from the term by few characters; of more pieces of
    the term than that, one stands in it unchanged. Names without any piece are dropped by a
    plain text search before Python scores the rest, which loses nothing.
    """
    if not term:
        return rows.withColumn("score", F.lit(100.0))

    def score(names: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else partial_ratio(term.lower(), n.lower()) for n in names], dtype="float64")

    size = max(1, len(term) // (math.floor((1 - least / 100) * 2 * len(term) + 1e-9) + 1))
    pieces = [term.lower()[k : k + size] for k in range(0, len(term) - size + 1, size)]
    low = F.lower(F.col("__name"))
    near = reduce(lambda a, b: a | b, (low.contains(p) for p in pieces), F.length("__name") < len(term))
    names = rows.select(F.col(name).alias("__name")).where("__name is not null").where(near).distinct()
    scored = names.withColumn("score", F.pandas_udf(score, "double")("__name")).where(F.col("score") >= least)
    return rows.join(scored, F.col(name) == F.col("__name")).drop("__name")


def positions(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, in a total order, without sorting all of them in one task.

    Rows are partitioned by range and sorted within; the sizes of the partitions, a handful of
    numbers, shift each partition's own row numbers. The order must be total to be repeatable.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))  # the ranges are sampled: computed once
    sizes = kept.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = kept.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "__part").withColumn(name, F.col("before") + F.col("__nth")).drop("__part", "__nth", "before")


def placed(rows: DataFrame, group: list[str], *order: Column, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, within each group, which must be small by its nature (as the windows of one user)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def toggled(rows: DataFrame, column: str, position: str, reverse: bool = False) -> DataFrame:
    """``rows`` with their place in a list sorted by one column; equal and missing values keep the order of ``position`` either way."""
    key = F.coalesce(F.col(column), F.lit(""))
    return positions(rows, key.desc() if reverse else key.asc(), F.col(position).asc())


def search_or_recent(rows: DataFrame, recent: DataFrame, name: str, term: str, newest: str, key: str) -> DataFrame:
    """The newest matches of a term, or, where the term is blank, the list of recent rows as it is."""
    return top_matches(rows, name, term.strip(), newest, key) if term.strip() else recent


def outdated(listing: DataFrame, history: DataFrame) -> DataFrame:
    """``file``, ``outdated``: whether the copy that was fetched has another checksum; never fetched is not outdated.

    ``history`` packs checksum and date into one text, split at the first bar; its keys compare without case.
    """
    parts = F.split("packed", r"\|", 2)
    h = history.select(F.lower("file").alias("key"), F.when(F.size(parts) == 2, parts[0]).alias("fetched"), F.when(F.size(parts) == 2, parts[1]).alias("fetched_on"))
    joined = listing.withColumn("key", F.lower("file")).join(h, "key", "left")
    return joined.select("file", F.coalesce(F.col("fetched") != F.col("hash"), F.lit(False)).alias("outdated"), "fetched_on")


def short_label(name: Column, most: int = 80) -> Column:
    """A name cut to ``most`` characters with dots at the end."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)
