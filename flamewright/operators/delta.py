"""Before / during / after an anchor: thirteen metrics for each window from one pass, and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ranks import nearest_ranks
from . import cpu
from .inspect import FRAME_EVENT, dur
from .pairing import stack_pairs
from .timebase import into_windows, on_main, with_context

WINDOWS = ("pre", "shoot", "post")
FRAME_RANKS = {"p50": 50, "p90": 90, "p99": 99}


def metric_names(lt_ms: float) -> list[tuple[str, str]]:
    """(metric, unit) in report order; ms metrics are held in µs."""
    return [("frames", "n"), ("frame p50", "ms"), ("frame p90", "ms"), ("frame p99", "ms"), ("frame max", "ms"), ("dropped frames", "n"), (f"long tasks ≥{lt_ms:.0f}ms", "n"), ("long task time", "ms"), ("main busy (RunTask)", "ms"), ("JS (FunctionCall)", "ms"), ("GC (Major+Minor)", "ms"), ("GC count", "n"), ("CPU samples", "ms")]


def window_stats(events: DataFrame, windows: dict[str, tuple[float, float]], frame_event: str = FRAME_EVENT, lt_ms: float = 50.0, **ctx) -> DataFrame:
    """(trace_id, win, frames, p50, p90, p99, largest, dropped, lt_count, lt_us, busy_us, js_us, gc_us, gc_count, cpu_us); a row for each trace and window."""
    rows = into_windows(with_context(events, **ctx), windows)
    name, main = F.col("name"), (F.col("ph") == "X") & on_main()
    task = (name == "RunTask") & main & F.col("dur").isNotNull()
    garbage = name.isin("MajorGC", "MinorGC") & (F.col("ph") == "X")
    total = lambda c: F.sum(F.when(c, dur()).otherwise(0.0))
    counters = rows.groupBy("trace_id", "win").agg(
        F.count_if(name == "DroppedFrame").alias("dropped"), F.count_if(task & (F.col("dur") >= lt_ms * 1000)).alias("lt_count"), total(task & (F.col("dur") >= lt_ms * 1000)).alias("lt_us"), total(task).alias("busy_us"),
        total((name == "FunctionCall") & main).alias("js_us"), total(garbage).alias("gc_us"), F.count_if(garbage).alias("gc_count"),
    )
    own = into_windows(events.where(name == frame_event), windows)
    pairs = stack_pairs(own, ["trace_id", "win", "tid"]).select("trace_id", "win", (F.col("end") - F.col("begin")).alias("d"))
    frames = pairs.groupBy("trace_id", "win").agg(F.count("*").alias("frames"), F.max("d").alias("largest")).join(nearest_ranks(pairs, ["trace_id", "win"], "d", FRAME_RANKS), ["trace_id", "win"])
    sampled = cpu.self_times_in(events, windows).groupBy("trace_id", "win").agg(F.sum("self_us").alias("cpu_us"))
    every = events.select("trace_id").distinct().withColumn("win", F.explode(F.array(*[F.lit(w) for w in windows])))
    out = every.join(counters, ["trace_id", "win"], "left").join(frames, ["trace_id", "win"], "left").join(sampled, ["trace_id", "win"], "left")
    return out.select("trace_id", "win", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("frames", "p50", "p90", "p99", "largest", "dropped", "lt_count", "lt_us", "busy_us", "js_us", "gc_us", "gc_count", "cpu_us")])


def delta_rows(stats: DataFrame, lt_ms: float = 50.0) -> DataFrame:
    """(trace_id, ord, metric, unit, pre, shoot, post, delta_pre, delta_post) in raw units."""
    cols = ("frames", "p50", "p90", "p99", "largest", "dropped", "lt_count", "lt_us", "busy_us", "js_us", "gc_us", "gc_count", "cpu_us")
    named = zip(cols, metric_names(lt_ms))
    long = stats.select("trace_id", "win", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.col(c).alias("v")) for k, (c, (m, u)) in enumerate(named)])).alias("x")).select("trace_id", "win", "x.*")
    wide = long.groupBy("trace_id", "ord", "metric", "unit").agg(*[F.max(F.when(F.col("win") == w, F.col("v"))).alias(w) for w in WINDOWS])
    return wide.withColumn("delta_pre", F.col("shoot") - F.col("pre")).withColumn("delta_post", F.col("post") - F.col("shoot"))


def top_cpu(events: DataFrame, windows: dict[str, tuple[float, float]], top: int = 3) -> DataFrame:
    """(trace_id, win, rank, function, self_us): heaviest named nodes of each window."""
    rows = cpu.self_times_in(events, windows).join(cpu.nodes(events), ["trace_id", "node_id"]).where("name <> ''")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id", "win").orderBy(F.col("self_us").desc(), "node_id"))).where(F.col("rank") <= top)
    return rows.select("trace_id", "win", "rank", F.col("name").alias("function"), F.round("self_us").alias("self_us"))


def compare_windows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ord, metric, unit, a_shoot, a_delta, b_shoot, b_delta, diff_shoot, diff_delta) of two traces' delta rows."""
    side = lambda df, p: df.select("ord", "metric", "unit", F.col("shoot").alias(f"{p}_shoot"), F.col("delta_pre").alias(f"{p}_delta"))
    out = side(a, "a").join(side(b, "b"), ["ord", "metric", "unit"])
    return out.withColumn("diff_shoot", F.col("b_shoot") - F.col("a_shoot")).withColumn("diff_delta", F.col("b_delta") - F.col("a_delta"))
