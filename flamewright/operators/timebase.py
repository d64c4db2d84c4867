"""Time base, main thread, anchors and windows of every trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import payload
from ..functions.scope import Matcher, Scope, is_metadata

MAIN_TASK_US = 500_000.0
#: Traces whose context may be broadcast (48 bytes each and their names).
BROADCAST_TRACES = 20_000


def end() -> F.Column:
    return F.col("ts") + F.coalesce("dur", F.lit(0.0))


def run_tasks() -> F.Column:
    return (F.col("name") == "RunTask") & (F.col("ph") == "X")


def context(events: DataFrame, main_task_us: float = MAIN_TASK_US) -> DataFrame:
    """(trace_id, min_ts, first_ts, last_ts, end_ts, main_tid), one row a trace, from one scan.

    min_ts: earliest event that is not metadata (null if none); last_ts: latest end of such events; end_ts: latest end of all events, at
    least 0; main_tid: thread of the first RunTask longer than main_task_us, else the thread with most RunTasks (the least id on a tie), else 0.
    """
    meta = is_metadata()
    long = run_tasks() & (F.col("dur") > main_task_us)
    by_thread = events.groupBy("trace_id", "tid").agg(
        F.min(F.when(~meta, F.col("ts"))).alias("min_ts"),
        F.max(F.when(~meta, end())).alias("last_ts"),
        F.max(end()).alias("end_ts"),
        F.min(F.when(long, F.col("seq"))).alias("long_seq"),
        F.count_if(run_tasks()).alias("n_tasks"),
    )
    most = F.max_by(F.when(F.col("n_tasks") > 0, F.col("tid")), F.when(F.col("n_tasks") > 0, F.struct("n_tasks", (-F.col("tid")).alias("k"))))
    return by_thread.groupBy("trace_id").agg(
        F.min("min_ts").alias("min_ts"),
        F.max("last_ts").alias("last_ts"),
        F.greatest(F.max("end_ts"), F.lit(0.0)).alias("end_ts"),
        F.coalesce(F.min_by("tid", "long_seq"), most, F.lit(0)).cast("decimal(20,0)").alias("main_tid"),
    )


def with_context(events: DataFrame, **options) -> DataFrame:
    """events with their trace's context columns.

    The context (one row a trace) is worked out once for a table of events and kept; up to BROADCAST_TRACES rows of it are broadcast, so
    that the events of a large trace are not shuffled by its name.
    """
    kept = events.__dict__.setdefault("_contexts", {})
    key = tuple(sorted(options.items()))
    if key not in kept:
        ctx = context(events, **options)
        rows = ctx.limit(BROADCAST_TRACES + 1).collect()
        kept[key] = F.broadcast(events.sparkSession.createDataFrame(rows, ctx.schema)) if len(rows) <= BROADCAST_TRACES else ctx
    return events.join(kept[key], "trace_id")


def on_main() -> F.Column:
    return F.col("tid") == F.col("main_tid")


def worst_task(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """(trace_id, ts, dur) of the longest RunTask in scope, the last of equals."""
    rows = events.where(run_tasks() & F.col("dur").isNotNull() & scope.events())
    return rows.groupBy("trace_id").agg(F.max_by(F.struct("ts", "dur"), F.struct("dur", "seq")).alias("w")).select("trace_id", "w.ts", "w.dur")


def find_anchor(events: DataFrame, matcher: Matcher) -> DataFrame:
    """(trace_id, ts, kind, label): first function call that matches; else first sample of a function (else of a URL) that matches; else first match in any args."""
    from . import cpu

    calls = events.where((F.col("name") == "FunctionCall") & (F.col("ph") == "X") & payload.may_match(matcher)).withColumn("label", payload.text("data.functionName"))
    calls = calls.where(matcher.test("label")).groupBy("trace_id").agg(F.min_by(F.struct("ts", F.lit("FunctionCall").alias("kind"), "label"), F.struct("ts", "seq")).alias("a")).withColumn("rank", F.lit(1))
    seen = cpu.anchor_times(events).join(cpu.nodes(events), ["trace_id", "node_id"])

    def sampled(column: str, rank: int) -> DataFrame:
        rows = seen.where(matcher.test(column))
        return rows.groupBy("trace_id").agg(F.min_by(F.struct("ts", F.lit("cpu-profile").alias("kind"), F.col(column).alias("label")), F.struct("ts", "node_id")).alias("a")).withColumn("rank", F.lit(rank))

    args = events.where(payload.may_match(matcher)).withColumn("label", payload.tree_match(matcher, words=False)).where("label is not null")
    args = args.groupBy("trace_id").agg(F.min_by(F.struct("ts", F.lit("args").alias("kind"), "label"), F.struct("ts", "seq")).alias("a")).withColumn("rank", F.lit(4))
    every = calls.unionByName(sampled("name", 2)).unionByName(sampled("url", 3)).unionByName(args)
    return every.groupBy("trace_id").agg(F.min_by("a", "rank").alias("a")).select("trace_id", "a.*")


def windows_around(ts: float, half_us: float = 100_000.0, pre_us: float = 500_000.0, post_us: float = 500_000.0) -> dict[str, tuple[float, float]]:
    """pre, shoot and post around a time; all are inclusive, so an event on an edge is in two."""
    lo, hi = ts - half_us, ts + half_us
    return {"pre": (lo - pre_us, lo), "shoot": (lo, hi), "post": (hi, hi + post_us)}


def window_table(spark: SparkSession, windows: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in windows.items()], "win string, lo double, hi double")


def into_windows(rows: DataFrame, windows: dict[str, tuple[float, float]], ts: str = "ts") -> DataFrame:
    """rows once for each window they fall in; the windows are literals in the plan, so nothing is joined."""
    hits = F.array(*[F.when(F.col(ts).between(float(a), float(b)), F.lit(k)) for k, (a, b) in windows.items()])
    any_hit = F.lit(False)
    for a, b in windows.values():
        any_hit = any_hit | F.col(ts).between(float(a), float(b))
    return rows.where(any_hit).withColumn("win", F.explode(F.array_compact(hits)))
