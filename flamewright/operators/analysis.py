"""Whole-trace analyses.  Thresholds are parameters; the defaults suit real traces (µs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import payload
from ..functions.ranks import nearest_ranks
from ..functions.scope import Scope
from .pairing import interval_join
from .succession import follows
from .timebase import on_main, run_tasks, with_context

LONG_US, HEAVY_US, SPIKE_US, BUSY_US = 50_000.0, 50_000.0, 16_667.0, 50_000.0
# The event names of the breakdown.
TRACKED = ["RunTask", "FunctionCall", "UpdateLayoutTree", "Layout", "Paint", "Layerize", "Commit", "HitTest", "IntersectionObserverController::computeIntersections", "MajorGC", "MinorGC", "EvaluateScript", "FireAnimationFrame"]
COSTS = ("js_us", "style_us", "layout_us", "paint_us", "composite_us", "hit_test_us")
COST_NAMES = ("JS", "Style", "Layout", "Paint", "Composite", "HitTest")


def _dur() -> F.Column:
    return F.coalesce("dur", F.lit(0.0))


def summary(events: DataFrame, long_us: float = LONG_US, **ctx) -> DataFrame:
    """duration_us (metadata aside), busy_us, long_tasks (strictly longer than long_us) of each trace."""
    rows = with_context(events, **ctx)
    task = run_tasks() & on_main()
    return rows.groupBy("trace_id").agg(
        F.greatest(F.first("last_ts") - F.first("min_ts"), F.lit(0.0)).alias("duration_us"),
        F.sum(F.when(task, _dur()).otherwise(0.0)).alias("busy_us"),
        F.count_if(task & (F.col("dur") > long_us)).alias("long_tasks"),
    )


def long_tasks(events: DataFrame, long_us: float = LONG_US, top: int = 10, **ctx) -> DataFrame:
    rows = with_context(events, **ctx).where(run_tasks() & on_main() & (F.col("dur") > long_us))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("dur").desc(), "seq"))).where(F.col("rank") <= top)
    return ranked.select("trace_id", "rank", "ts", "dur")


def breakdown(events: DataFrame, names: list[str] | None = None, **ctx) -> DataFrame:
    """name, count, total_us, avg_us, pct of the trace for the tracked names on the main thread."""
    rows = with_context(events, **ctx)
    rows = rows.where(F.col("name").isin(names or TRACKED) & (F.col("ph") == "X") & on_main() & F.col("dur").isNotNull())
    span = F.greatest(F.first("last_ts") - F.first("min_ts"), F.lit(0.0))
    out = rows.groupBy("trace_id", "name").agg(F.count("*").alias("count"), F.sum("dur").alias("total_us"), span.alias("span"))
    return out.select("trace_id", "name", "count", "total_us", (F.col("total_us") / F.col("count")).alias("avg_us"), F.when(F.col("span") > 0, F.col("total_us") / F.col("span") * 100).otherwise(0.0).alias("pct"))


def cumulative_pct(rows: DataFrame, value: str, order: list) -> DataFrame:
    """rows with pct and running cumulative_pct of ``value`` in each trace, in the given order."""
    whole = F.sum(value).over(Window.partitionBy("trace_id"))
    run = F.sum(value).over(Window.partitionBy("trace_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    share = lambda x: F.when(whole > 0, x / whole * 100).otherwise(0.0)
    return rows.withColumn("pct", share(F.col(value))).withColumn("cumulative_pct", share(run))


def _main_rows(events: DataFrame, **ctx) -> tuple[DataFrame, DataFrame]:
    """(trace_id, tid, task, start, stop) of the main thread's RunTasks, and its X events that are their children."""
    rows = with_context(events, **ctx).where((F.col("ph") == "X") & on_main())
    task = rows.where((F.col("name") == "RunTask") & F.col("dur").isNotNull()).select("trace_id", "tid", F.col("seq").alias("task"), F.col("ts").alias("start"), (F.col("ts") + F.col("dur")).alias("stop"))
    kids = rows.where(F.col("name").isin("FunctionCall", "UpdateLayoutTree", "Layout", "Paint", "Layerize", "Commit", "HitTest")).select("trace_id", "tid", "seq", "name", "ts", "dur")
    return task, kids


def _main_children(events: DataFrame, **ctx) -> DataFrame:
    """(trace_id, tid, task, start, stop) x main-thread X events inside, the RunTasks themselves aside."""
    return interval_join(*_main_rows(events, **ctx), ["trace_id", "tid"])


def bottleneck(costs: list[str] = list(COSTS)) -> F.Column:
    """Name of the largest cost; of equals the last in order."""
    parts = [F.struct(F.col(c).alias("v"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (c, n) in enumerate(zip(costs, COST_NAMES))]
    return F.array_max(F.array(*parts))["n"]


def ranked_costs(costs: list[str] = list(COSTS)) -> F.Column:
    """[(name, cost)] by falling cost."""
    parts = F.array(*[F.struct((-F.col(c)).alias("k"), F.lit(k).alias("i"), F.lit(n).alias("name"), F.col(c).alias("us")) for k, (c, n) in enumerate(zip(costs, COST_NAMES))])
    return F.transform(F.array_sort(parts), lambda x: F.struct(x["name"].alias("name"), x["us"].alias("us")))


def scroll_frames(events: DataFrame, heavy_us: float = HEAVY_US, **ctx) -> DataFrame:
    """RunTasks of the main thread with a heavy style update or function call inside, and what their contained children cost."""
    pairs = _main_children(events, **ctx)
    d, name = _dur(), F.col("name")
    heavy = name.isin("UpdateLayoutTree", "FunctionCall") & (d > heavy_us)
    inside = (d > 0) & (F.col("ts") + d <= F.col("stop"))
    cost = lambda *n: F.sum(F.when(inside & name.isin(*n), d).otherwise(0.0))
    out = pairs.groupBy("trace_id", "task", "start", "stop").agg(
        F.max(heavy).alias("heavy"), cost("FunctionCall").alias("js_us"), cost("UpdateLayoutTree").alias("style_us"), cost("Layout").alias("layout_us"), cost("Paint").alias("paint_us"), cost("Layerize", "Commit").alias("composite_us"), cost("HitTest").alias("hit_test_us"),
    )
    return out.where("heavy").select("trace_id", "task", F.col("start").alias("ts"), (F.col("stop") - F.col("start")).alias("dur_us"), *COSTS).withColumn("bottleneck", bottleneck())


def scroll_summary(frames: DataFrame) -> DataFrame:
    """Frames, mean costs, bottleneck of the means and duration percentiles of each trace that has any."""
    mean = frames.groupBy("trace_id").agg(F.count("*").alias("frames"), F.avg("dur_us").alias("dur_us"), *[F.avg(c).alias(c) for c in COSTS])
    return mean.withColumn("bottleneck", bottleneck()).join(nearest_ranks(frames, ["trace_id"], "dur_us", {"p50_us": 50, "p90_us": 90, "p99_us": 99}), "trace_id")


def layout_dirty(events: DataFrame, **ctx) -> DataFrame:
    """(trace_id, seq, ts, dur_us, dirty, total) of main-thread layouts that carry beginData."""
    rows = with_context(events, **ctx).where(on_main() & (F.col("name") == "Layout") & (F.col("ph") == "X"))
    begin = F.variant_get(F.try_parse_json("args"), "$.beginData", "variant")
    count = lambda p: F.coalesce(payload.unsigned(f"beginData.{p}"), F.lit(0))
    return rows.where(begin.isNotNull()).select("trace_id", "seq", "ts", _dur().alias("dur_us"), count("dirtyObjects").alias("dirty"), count("totalObjects").alias("total"))


def layout_summary(entries: DataFrame) -> DataFrame:
    """Mean and most dirty objects; the ratio's mean runs over all entries, entries without a total adding nothing."""
    ratio = F.when(F.col("total") > 0, F.col("dirty") / F.col("total") * 100).otherwise(0.0)
    return entries.groupBy("trace_id").agg(F.count("*").alias("layouts"), F.avg("dirty").alias("avg_dirty"), F.max("dirty").alias("max_dirty"), F.avg(ratio).alias("avg_ratio"))


def style_recalc(events: DataFrame, **ctx) -> DataFrame:
    """(trace_id, seq, ts, dur_us, elements) of main-thread style updates that touched elements."""
    rows = with_context(events, **ctx).where(on_main() & (F.col("name") == "UpdateLayoutTree") & (F.col("ph") == "X"))
    return rows.select("trace_id", "seq", "ts", _dur().alias("dur_us"), payload.unsigned("elementCount").alias("elements")).where("elements > 0")


def style_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("trace_id").agg(F.count("*").alias("recalcs"), F.avg("elements").alias("avg_elements"), F.max("elements").alias("max_elements"))


def forced_reflows(events: DataFrame, least: int = 2, **ctx) -> DataFrame:
    """Tasks in which a layout or style update directly follows a function call at least ``least`` times."""
    task, kids = _main_rows(events, **ctx)
    kids = kids.where(F.col("name").isin("FunctionCall", "Layout", "UpdateLayoutTree")).select("trace_id", "seq", "ts", _dur().alias("dur"), (F.col("name") == "FunctionCall").alias("first"))
    out = follows(task, kids).where(F.col("n") >= least)
    return out.select("trace_id", "task", (F.col("stop") - F.col("start")).alias("task_dur_us"), F.col("n").alias("reflows"), F.col("us").alias("layout_us"))


def jank_buckets(events: DataFrame, scope: Scope = Scope(), spike_us: float = SPIKE_US, busy_us: float = BUSY_US, **ctx) -> DataFrame:
    """Hot buckets: (trace_id, bucket, width, min_ts, busy, max_run, max_faf, max_gpu, dropped).

    Bucket width follows from the whole trace; a window only leaves events and buckets out.
    """
    rows = _bucketed(with_context(events, **ctx)).where("ts between min_ts and end_ts")
    if scope.window:
        rows = rows.where(F.col("ts").between(*map(float, scope.window)))
    name, main = F.col("name"), on_main() & (F.col("ph") == "X")
    most = lambda c: F.greatest(F.coalesce(F.max(F.when(c, F.col("dur"))), F.lit(0.0)), F.lit(0.0))
    rows = rows.where(name.isin("RunTask", "FireAnimationFrame", "GPUTask", "DroppedFrame"))
    out = rows.groupBy("trace_id", "bucket", "width", "min_ts").agg(
        F.sum(F.when((name == "RunTask") & main, _dur()).otherwise(0.0)).alias("busy"), most((name == "RunTask") & main).alias("max_run"), most((name == "FireAnimationFrame") & main).alias("max_faf"), most((name == "GPUTask") & (F.col("ph") == "X")).alias("max_gpu"), F.count_if(name == "DroppedFrame").alias("dropped"),
    )
    hot = (F.col("dropped") > 0) | (F.greatest("max_run", "max_faf", "max_gpu") >= spike_us) | (F.col("busy") >= busy_us)
    if scope.window:
        lo = F.col("min_ts") + F.col("bucket") * F.col("width")
        hot = hot & (lo + F.col("width") > float(scope.window[0])) & (lo < float(scope.window[1]))
    return out.where(hot)


def _bucketed(rows: DataFrame) -> DataFrame:
    span = F.greatest(F.col("end_ts") - F.col("min_ts"), F.lit(1.0))
    rows = rows.withColumn("width", F.greatest(F.lit(50_000.0), F.least(F.lit(1_000_000.0), span / 2000)))
    last = F.greatest(F.lit(1), F.ceil(span / F.col("width"))) - 1
    return rows.withColumn("bucket", F.least(F.greatest(F.floor((F.col("ts") - F.col("min_ts")) / F.col("width")), F.lit(0)), last))


def jank_clusters(events: DataFrame, scope: Scope = Scope(), top: int = 8, **options) -> DataFrame:
    """rank, first and last bucket, start_us, end_us, busy_us, max_*_us, dropped of the worst runs of adjacent hot buckets."""
    hot = jank_buckets(events, scope, **options)
    island = F.col("bucket") - F.row_number().over(Window.partitionBy("trace_id").orderBy("bucket"))
    runs = hot.withColumn("island", island).groupBy("trace_id", "island", "width", "min_ts").agg(
        F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.sum("busy").alias("busy_us"), F.max("max_run").alias("max_run_us"), F.max("max_faf").alias("max_faf_us"), F.max("max_gpu").alias("max_gpu_us"), F.sum("dropped").alias("dropped"),
    )
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("dropped").desc(), F.col("max_run_us").desc(), F.col("busy_us").desc(), "first"))
    out = runs.withColumn("rank", rank).where(F.col("rank") <= top)
    at = lambda b: F.col("min_ts") + b * F.col("width")
    return out.select("trace_id", "rank", "first", "last", at(F.col("first")).alias("start_us"), at(F.col("last") + 1).alias("end_us"), "busy_us", "max_run_us", "max_faf_us", "max_gpu_us", "dropped")


def jank_calls(events: DataFrame, clusters: DataFrame, scope: Scope = Scope(), top: int = 5, **ctx) -> DataFrame:
    """rank (the cluster's), call_rank, name, dur_us: the functions that took most time in each cluster."""
    calls = events.where((F.col("name") == "FunctionCall") & (F.col("ph") == "X") & F.col("dur").isNotNull())
    if scope.window:
        calls = calls.where(F.col("ts").between(*map(float, scope.window)))
    base = with_context(events, **ctx).select("trace_id", "min_ts", "end_ts").dropDuplicates(["trace_id"])
    calls = _bucketed(calls.join(base, "trace_id")).select("trace_id", "bucket", "dur", payload.text("data.functionName").alias("name")).where("name <> ''")
    spread = clusters.select("trace_id", "rank", F.explode(F.sequence("first", "last")).alias("bucket"))
    sums = calls.join(spread, ["trace_id", "bucket"]).groupBy("trace_id", "rank", "name").agg(F.sum("dur").alias("dur_us"))
    ranked = sums.withColumn("call_rank", F.row_number().over(Window.partitionBy("trace_id", "rank").orderBy(F.col("dur_us").desc(), "name")))
    return ranked.where(F.col("call_rank") <= top)
