"""Granular inspectors: each takes events and a scope and returns one DataFrame (a row order key where order matters).

t_us columns are relative to the trace's time base; values are rounded to whole µs, half away from zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import payload
from ..functions.ranks import duration_stats
from ..functions.scope import Matcher, NameFilter, Scope, is_metadata
from .pairing import async_pairs, interval_join, stack_pairs
from .timebase import context, on_main, run_tasks, with_context

FRAME_EVENT = "SubmitCompositorFrameToPresentationCompositorFrame"
GC_GROUPS = ("MajorGC", "MinorGC / GCScavenger", "other V8.GC*/CppGC*")


def dur() -> F.Column:
    return F.coalesce("dur", F.lit(0.0))


def us(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c)


def _based(events: DataFrame, rows: DataFrame) -> DataFrame:
    base = events.where(~is_metadata()).groupBy("trace_id").agg(F.min("ts").alias("min_ts"))
    return rows.join(base, "trace_id", "left")


def _top(rows: DataFrame, order: list, top: int | None, rank: str = "rank") -> DataFrame:
    """The first ``top`` rows of each trace with their rank."""
    out = rows.withColumn(rank, F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)))
    return out if top is None else out.where(F.col(rank) <= top)


def events_list(events: DataFrame, names: NameFilter = NameFilter(), scope: Scope = Scope(), min_dur: float = 0.0, sort: str = "ts", top: int | None = 30) -> DataFrame:
    """rank, total, t_us, dur_us, name, tid, pid, args of the first matching events; sort: ts, dur, name, count (array order)."""
    rows = events.where(names.test() & (dur() >= min_dur) & scope.events())
    keys = {"ts": [F.col("ts")], "dur": [dur().desc()], "name": [F.col("name"), F.col("ts")]}.get(sort, [])
    total = rows.groupBy("trace_id").agg(F.count("*").alias("total"))
    shown = _based(events, _top(rows, [*keys, F.col("seq")], top)).join(total, "trace_id")
    return shown.select("trace_id", "rank", "total", us(F.col("ts") - F.col("min_ts")).alias("t_us"), us(dur()).alias("dur_us"), "name", "tid", "pid", "args")


def stats(events: DataFrame, names: NameFilter = NameFilter(), scope: Scope = Scope(), min_dur: float = 0.0) -> DataFrame:
    """Duration distribution of each matching name."""
    rows = events.where(names.test() & scope.events()).select("trace_id", "name", dur().alias("d")).where(F.col("d") >= min_dur)
    s = duration_stats(rows, ["trace_id", "name"], "d", {"p50": 50, "p90": 90, "p99": 99})
    cols = {"total": "total_us", "least": "min_us", "mean": "avg_us", "p50": "p50_us", "p90": "p90_us", "p99": "p99_us", "largest": "max_us"}
    return s.select("trace_id", "name", "count", *[us(a).alias(b) for a, b in cols.items()])


def names(events: DataFrame, scope: Scope = Scope(), sort: str = "total", top: int | None = None) -> DataFrame:
    """rank, name, count, total_us, avg_us of each event name."""
    rows = events.where(scope.events()).groupBy("trace_id", "name").agg(F.count("*").alias("count"), F.sum(dur()).alias("total"))
    order = {"count": [F.col("count").desc()], "name": []}.get(sort, [F.col("total").desc()])
    return _top(rows, [*order, F.col("name")], top).select("trace_id", "rank", "name", "count", us("total").alias("total_us"), us(F.col("total") / F.col("count")).alias("avg_us"))


def threads(events: DataFrame, scope: Scope = Scope(), top: int | None = None) -> DataFrame:
    """rank, tid, events, runtask_us, top_event of each thread; of equally frequent names the first by name."""
    by_name = events.where(scope.events()).groupBy("trace_id", "tid", "name").agg(F.count("*").alias("n"), F.sum(F.when(F.col("name") == "RunTask", dur()).otherwise(0.0)).alias("run"))
    rows = by_name.groupBy("trace_id", "tid").agg(F.sum("n").alias("events"), F.sum("run").alias("run"), F.min_by("name", F.struct((-F.col("n")).alias("k"), "name")).alias("top_event"))
    return _top(rows, [F.col("run").desc(), F.col("tid")], top).select("trace_id", "rank", "tid", "events", us("run").alias("runtask_us"), "top_event")


def timeline(events: DataFrame, scope: Scope = Scope(), bucket_ms: float | None = None) -> DataFrame:
    """bucket, t_us, runtask_us, busy, events of every bucket of the window or trace, empty ones too."""
    ctx = context(events)
    lo, hi = (F.lit(float(x)) for x in scope.window) if scope.window else (F.col("min_ts"), F.col("end_ts"))
    ctx = ctx.select("trace_id", "min_ts", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    auto = F.greatest(F.lit(10.0), F.least(F.lit(500.0), F.round((F.col("hi") - F.col("lo")) / 1000 / 40)))
    ctx = ctx.withColumn("width", F.greatest(F.lit(1.0), (F.lit(float(bucket_ms)) if bucket_ms else auto) * 1000))
    ctx = ctx.withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.col("width"))).cast("long"))
    rows = events.where(scope.events()).join(ctx, "trace_id").where("ts between lo and hi")
    rows = rows.withColumn("bucket", F.floor((F.col("ts") - F.col("lo")) / F.col("width"))).where("bucket < n")
    sums = rows.groupBy("trace_id", "bucket").agg(F.count("*").alias("events"), F.sum(F.when(F.col("name") == "RunTask", dur()).otherwise(0.0)).alias("run"))
    every = ctx.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    out = every.join(sums, ["trace_id", "bucket"], "left").withColumn("run", F.coalesce("run", F.lit(0.0)))
    return out.select("trace_id", "bucket", us(F.col("lo") - F.col("min_ts") + F.col("bucket") * F.col("width")).alias("t_us"), us("run").alias("runtask_us"), F.least(F.col("run") / F.col("width"), F.lit(1.0)).alias("busy"), F.coalesce("events", F.lit(0)).alias("events"))


def tasks(events: DataFrame, scope: Scope = Scope(), top: int = 30) -> DataFrame:
    """rank, t_us, dur_us, tid of the longest RunTasks with children (array of name, count, total_us) and their longest function call."""
    heavy = _top(events.where(run_tasks() & F.col("dur").isNotNull() & scope.events()), [F.col("dur").desc(), F.col("seq")], top)
    heavy = heavy.select("trace_id", "tid", "rank", F.col("ts").alias("start"), F.col("dur").alias("task_dur"), (F.col("ts") + F.col("dur")).alias("stop"))
    kids = events.where(F.col("name") != "RunTask").select("trace_id", "tid", "name", "ts", "seq", dur().alias("d"), F.when(F.col("name") == "FunctionCall", F.col("args")).alias("args"))
    pairs = interval_join(heavy, kids, ["trace_id", "tid"])
    by_name = pairs.groupBy("trace_id", "rank", "name").agg(F.count("*").alias("count"), F.sum("d").alias("total"), F.max_by(F.struct("args", "d"), F.when(F.col("name") == "FunctionCall", F.struct("d", (-F.col("seq")).alias("k")))).alias("call"))
    children = by_name.groupBy("trace_id", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("k"), "name", "count", us("total").alias("total_us")))).alias("kids"), F.max(F.when(F.col("name") == "FunctionCall", F.col("call"))).alias("call"))
    out = _based(events, heavy.join(children, ["trace_id", "rank"], "left"))
    label = F.coalesce(payload.text("data.functionName", F.col("call.args")), F.lit(""))
    call = F.when(F.col("call").isNotNull(), F.struct(F.when(label == "", "(anonymous)").otherwise(label).alias("name"), us("call.d").alias("dur_us")))
    listed = F.coalesce(F.transform("kids", lambda k: F.struct(k["name"].alias("name"), k["count"].alias("count"), k["total_us"].alias("total_us"))), F.array())
    return out.select("trace_id", "rank", us(F.col("start") - F.col("min_ts")).alias("t_us"), us("task_dur").alias("dur_us"), "tid", listed.alias("children"), call.alias("top_function_call"))


def frames(events: DataFrame, scope: Scope = Scope(), frame_event: str = FRAME_EVENT) -> DataFrame:
    """One row a trace: frame durations (begin/end pairs of the window; thread, process and category do not count) and dropped frames in scope."""
    own = events.where(F.col("name") == frame_event).where(Scope(scope.window).events())
    pairs = stack_pairs(own, ["trace_id", "tid"]).select("trace_id", (F.col("end") - F.col("begin")).alias("d"))
    sums = duration_stats(pairs, ["trace_id"], "d", {"p50": 50, "p90": 90, "p99": 99})
    lost = events.where((F.col("name") == "DroppedFrame") & scope.events()).groupBy("trace_id").agg(F.count("*").alias("dropped_frames"))
    out = events.select("trace_id").distinct().join(sums, "trace_id", "left").join(lost, "trace_id", "left")
    zero = lambda c: us(F.coalesce(c, F.lit(0.0)))
    return out.select("trace_id", F.lit(frame_event).alias("frame_event"), F.coalesce("count", F.lit(0)).alias("count"), zero("mean").alias("avg_us"), zero("p50").alias("p50_us"), zero("p90").alias("p90_us"), zero("p99").alias("p99_us"), zero("largest").alias("max_us"), F.coalesce("dropped_frames", F.lit(0)).alias("dropped_frames"))


def gc(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """group, count, total_us, max_us: three rows a trace."""
    n = F.col("name")
    group = F.when(n == "MajorGC", GC_GROUPS[0]).when(n.isin("MinorGC", "V8.GCScavenger"), GC_GROUPS[1]).when(n.startswith("V8.GC") | n.startswith("CppGC"), GC_GROUPS[2])
    sums = events.where((F.col("ph") == "X") & scope.events()).withColumn("group", group).where("group is not null").groupBy("trace_id", "group").agg(F.count("*").alias("count"), F.sum(dur()).alias("total"), F.max(dur()).alias("most"))
    every = events.select("trace_id").distinct().withColumn("group", F.explode(F.array(*map(F.lit, GC_GROUPS))))
    out = every.join(sums, ["trace_id", "group"], "left")
    return out.select("trace_id", "group", F.coalesce("count", F.lit(0)).alias("count"), us(F.coalesce("total", F.lit(0.0))).alias("total_us"), us(F.greatest(F.coalesce("most", F.lit(0.0)), F.lit(0.0))).alias("max_us"))


def gc_long_tasks(events: DataFrame, scope: Scope = Scope(), threshold_us: float = 50_000.0, **ctx) -> DataFrame:
    """threshold_us, count, total_us, max_us, top_us (three) of main-thread RunTasks at or over the threshold; no row without any."""
    rows = with_context(events, **ctx).where(run_tasks() & on_main() & (dur() >= threshold_us) & scope.events()).select("trace_id", dur().alias("d"), "seq")
    sums = rows.groupBy("trace_id").agg(F.count("*").alias("count"), F.sum("d").alias("total"), F.max("d").alias("most"))
    best = _top(rows, [F.col("d").desc(), F.col("seq")], 3).groupBy("trace_id").agg(F.sort_array(F.collect_list(us("d")), False).alias("top_us"))
    return sums.join(best, "trace_id").select("trace_id", F.lit(float(threshold_us)).alias("threshold_us"), "count", us("total").alias("total_us"), us("most").alias("max_us"), "top_us")


def memory_samples(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """(trace_id, seq, ts, heap, nodes, documents, listeners) of the counter events; missing counters are 0."""
    rows = events.where((F.col("name") == "UpdateCounters") & (F.col("ph") == "I") & F.col("args").isNotNull() & scope.events())
    get = {"heap": "jsHeapSizeUsed", "nodes": "nodes", "documents": "documents", "listeners": "jsEventListeners"}
    return rows.select("trace_id", "seq", "ts", *[F.coalesce(payload.number(f"data.{p}"), F.lit(0.0)).alias(k) for k, p in get.items()])


def memory_summary(samples: DataFrame) -> DataFrame:
    """samples, first, last, growth and peak heap (bytes), time of the peak (the last of equals), peaks of the other counters."""
    order, when = F.struct("ts", "seq"), F.struct("heap", "ts", "seq")
    out = samples.groupBy("trace_id").agg(
        F.count("*").alias("samples"), F.min_by("heap", order).alias("first_heap"), F.max_by("heap", order).alias("last_heap"), F.max("heap").alias("peak_heap"), F.max_by("ts", when).alias("peak_ts"),
        F.max("nodes").alias("peak_nodes"), F.max("documents").alias("peak_documents"), F.max("listeners").alias("peak_listeners"),
    )
    return out.withColumn("growth", F.col("last_heap") - F.col("first_heap"))


def downsample(rows: DataFrame, order: list[str], top: int) -> DataFrame:
    """About ``top`` evenly spaced rows of each trace, first and last included: positions k * (n - 1) / (top - 1)."""
    by = Window.partitionBy("trace_id")
    out = rows.withColumn("_i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    k = F.ceil(F.col("_i") * max(top - 1, 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    keep = (F.col("_n") <= top) | ((k < top) & (F.floor(k * (F.col("_n") - 1) / max(top - 1, 1)) == F.col("_i")))
    return out.where(keep & F.lit(top > 0)).drop("_i", "_n")


def _input_rows(events: DataFrame, scope: Scope) -> DataFrame:
    rows = events.where((F.col("name") == "EventDispatch") & (F.col("ph") == "X") & scope.events())
    return rows.select("trace_id", "seq", "ts", F.coalesce(payload.text("data.type"), F.lit("(unknown)")).alias("type"), dur().alias("d"))


def _latency(rows: DataFrame, key: str) -> DataFrame:
    s = duration_stats(rows, ["trace_id", key], "d", {"p50": 50, "p99": 99})
    return s.select("trace_id", key, "count", *[us(a).alias(b) for a, b in (("total", "total_us"), ("mean", "avg_us"), ("p50", "p50_us"), ("p99", "p99_us"), ("largest", "max_us"))])


def input_types(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Latency of dispatched input events by type."""
    return _latency(_input_rows(events, scope), "type")


def input_worst(events: DataFrame, scope: Scope = Scope(), top: int = 30) -> DataFrame:
    rows = _based(events, _top(_input_rows(events, scope), [F.col("d").desc(), F.col("seq")], top))
    return rows.select("trace_id", "rank", us(F.col("ts") - F.col("min_ts")).alias("t_us"), us("d").alias("dur_us"), "type")


def async_tasks(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Durations of start/finish pairs by the start's name."""
    return _latency(async_pairs(events, scope).withColumnRenamed("dur", "d"), "name")


def async_longest(events: DataFrame, scope: Scope = Scope(), top: int = 30) -> DataFrame:
    rows = _based(events, _top(async_pairs(events, scope), [F.col("dur").desc(), F.col("finish_seq")], top))
    return rows.select("trace_id", "rank", us(F.col("start_ts") - F.col("min_ts")).alias("t_us"), us("dur").alias("dur_us"), "name")


def find(events: DataFrame, matcher: Matcher, scope: Scope = Scope(), top: int | None = 30) -> DataFrame:
    """rank, total, t_us, dur_us, name, tid, args, hit of the events whose args hold the pattern in any string, key, number, true, false or null."""
    rows = events.where(scope.events() & payload.may_match(matcher)).withColumn("hit", payload.tree_match(matcher)).where("hit is not null")
    total = rows.groupBy("trace_id").agg(F.count("*").alias("total"))
    shown = _based(events, _top(rows, [F.col("ts"), F.col("seq")], top)).join(total, "trace_id")
    return shown.select("trace_id", "rank", "total", us(F.col("ts") - F.col("min_ts")).alias("t_us"), us(dur()).alias("dur_us"), "name", "tid", "args", "hit")


