"""Joins the catalogue needs and Spark lacks: interval containment, start/finish ids, begin/end stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scope import Scope


def bin_width(tasks: DataFrame, default: float = 1e6) -> float:
    """A bin that most tasks fit in, from one aggregate row: the 90th percentile of their lengths, but at least a quarter of the
    mean, so that a few giant tasks cannot list more than five bins a task overall."""
    length = F.col("stop") - F.col("start")
    p, mean = tasks.where(length >= 0).select(F.percentile_approx(length, 0.9, 1000), F.avg(length)).first()
    width = max(float(p or 0), float(mean or 0) / 4)
    return width if width > 0 else default


def interval_join(tasks: DataFrame, events: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """Every (task, event) with equal keys and start <= ts <= stop.

    tasks has keys, start, stop; events has keys, ts; other names must differ.  Time is cut into bins: a task is listed in
    each bin it touches and an event in its own, so the join is an equality on (keys, bin) that spreads one busy thread over many
    partitions, and each pair appears once.
    """
    width = width or bin_width(tasks)
    bins = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))
    left = tasks.where(F.col("stop") >= F.col("start")).withColumn("_bin", F.explode(bins))
    right = events.withColumn("_bin", F.floor(F.col("ts") / width))
    return left.join(right, [*keys, "_bin"]).where("ts between start and stop").drop("_bin")


def async_pairs(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """(trace_id, name, start_ts, dur): the first start in scope of each (pid, id) with every finish of that id; dur is at least 0."""
    begin = events.where((F.col("ph") == "s") & F.col("id").isNotNull() & scope.events())
    begin = begin.groupBy("trace_id", "pid", "id").agg(F.min_by(F.struct("name", "ts"), "seq").alias("s"))
    finish = events.where((F.col("ph") == "f") & F.col("id").isNotNull()).select("trace_id", "pid", "id", F.col("ts").alias("finish"), F.col("seq").alias("finish_seq"))
    both = begin.join(finish, ["trace_id", "pid", "id"])
    return both.select("trace_id", F.col("s.name").alias("name"), F.col("s.ts").alias("start_ts"), F.greatest(F.col("finish") - F.col("s.ts"), F.lit(0.0)).alias("dur"), "finish_seq")


def stack_pairs(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, begin, end of last-in-first-out pairs of ph b / e rows, in seq order within keys; only pairs of positive length.

    The running sum of +1/-1 less its running minimum (at most 0) is the stack's depth; an end at depth 0 is dropped; the rows
    of one level alternate, so an end's partner is the row before it on its level.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    rows = events.where(F.col("ph").isin("b", "e")).withColumn("s", F.sum(F.when(F.col("ph") == "b", 1).otherwise(-1)).over(order))
    rows = rows.withColumn("m", F.least(F.lit(0), F.min("s").over(order)))
    rows = rows.withColumn("before", F.coalesce(F.lag(F.col("s") - F.col("m")).over(order), F.lit(0)))
    rows = rows.withColumn("level", F.when(F.col("ph") == "b", F.col("s") - F.col("m")).otherwise(F.col("before"))).where("level > 0")
    partner = F.lag("ts").over(Window.partitionBy(*keys, "level").orderBy("seq"))
    return rows.withColumn("begin", partner).where("ph = 'e' and ts > begin").select(*keys, "begin", F.col("ts").alias("end"))
