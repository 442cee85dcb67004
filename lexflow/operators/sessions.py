"""Order-dependent operators over sessions of events, safe for sessions of any length.

A session's rows are cut into stretches; stretches are folded first, and only their few
summaries pass through a window per session. A session with a third of all rows is thus
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRETCH = 4096  # positions
STRETCH_US = 6 * 3600 * 1_000_000  # of time


def carried_starts(events: DataFrame, session: str, position: str, at: str, starts: str, ends: str) -> DataFrame:
    """Intervals from the last earlier start to each end, in line order: ``session``, ``begin_us``, ``end_us``.

    ``starts`` and ``ends`` are boolean columns. A start without time keeps the one before; an
    end at or before its start makes no interval.
    """
    e = events.select(F.col(session).alias("session"), F.col(position).alias("pos"), F.col(at).alias("at"), F.col(starts).alias("s"), F.col(ends).alias("e"))
    e = e.withColumn("part", F.expr(f"pos div {STRETCH}")).withColumn("start", F.when(F.col("s"), F.col("at")))
    last = e.where("start is not null").groupBy("session", "part").agg(F.max_by("start", "pos").alias("last"))
    # a part without a start has no summary: the nearest earlier part's last start is found by a window over the parts
    parts = e.select("session", "part").distinct().join(last, ["session", "part"], "left")
    before = parts.select("session", "part", F.last("last", True).over(Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("session", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    filled = e.withColumn("own", F.last("start", True).over(inside)).join(before, ["session", "part"])
    spans = filled.where("e and at is not null").select("session", F.coalesce("own", "carried").alias("begin_us"), F.col("at").alias("end_us"))
    return spans.where("end_us > begin_us")


def cover(intervals: DataFrame) -> DataFrame:
    """``session``, ``covered_us``: the length of the union of each session's intervals."""
    i = intervals.withColumn("part", F.expr(f"begin_us div {STRETCH_US}"))
    ends = i.groupBy("session", "part").agg(F.max("end_us").alias("reach"))
    before = ends.select("session", "part", F.max("reach").over(Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("reached"))
    inside = Window.partitionBy("session", "part").orderBy("begin_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    j = i.withColumn("own", F.max("end_us").over(inside)).join(before, ["session", "part"])
    done = F.greatest("begin_us", F.coalesce("own", "begin_us"), F.coalesce("reached", "begin_us"))
    return j.groupBy("session").agg(F.sum(F.greatest(F.lit(0), F.col("end_us") - done)).cast("bigint").alias("covered_us"))


def turn_state(events: DataFrame, session: str, position: str, users: str, assistants: str, active: str, at: str) -> DataFrame:
    """``session``, ``working``, ``last_assistant_us``: what a scan from the newest row on finds first.

    A user row newer than every assistant row means that work is going on; else the newest
    active assistant row with a time counts.
    """
    s = events.groupBy(F.col(session).alias("session")).agg(
        F.max(F.when(F.col(users), F.col(position))).alias("user"),
        F.max(F.when(F.col(assistants), F.col(position))).alias("assistant"),
        F.max_by(F.col(at), F.when(F.col(assistants) & F.col(active) & F.col(at).isNotNull(), F.col(position))).alias("last"),
    )
    working = F.coalesce(F.col("user") > F.coalesce("assistant", F.lit(-1)), F.lit(False))
    return s.select("session", working.alias("working"), F.when(~working, F.col("last")).alias("last_assistant_us"))


def first_highest(gauges: DataFrame, group: str, value: str, position: str, keep: str) -> DataFrame:
    """The row with the highest value of each group; of equal ones the first by position."""
    best = gauges.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(keep).alias("kept")), F.struct(F.col(value), -F.col(position))).alias("b"))
    return best.select("group", "b.value", "b.kept")


def idle_sessions(events: DataFrame, key: str, at: str, idle: str = "6 hours") -> DataFrame:
    """``key``, ``begin``, ``last``, ``n``: stretches of use that end where nothing follows within ``idle``.

    On a stream with a watermark a stretch is emitted once, when it has expired; on a table all
    stretches are given. Stretches are merged where they lie before they are shuffled.
    """
    used = events.groupBy(F.col(key), F.session_window(F.col(at), idle).alias("w")).agg(F.max(at).alias("last"), F.count("*").alias("n"))
    return used.select(key, F.col("w.start").alias("begin"), "last", "n")


def pace(events: DataFrame, session: str, at_us: str) -> DataFrame:
    """``session``, ``n``, ``us_each``: the mean time from one arrival to the next, the wait for the first one aside; null for a single one."""
    seen = events.groupBy(F.col(session).alias("session")).agg(F.count(at_us).alias("n"), F.min(at_us).alias("first"), F.max(at_us).alias("last"))
    return seen.select("session", "n", F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)).alias("us_each"))
