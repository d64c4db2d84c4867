"""A loaded trace and the questions one can ask it.

The events are cached DataFrames; each section is one lazy plan whose few rows are collected and handed to a renderer.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scope import Matcher, NameFilter, Scope
from ..operators import analysis, compare, cpu, delta, inspect, timebase
from ..render import text as T
from ..sources import traces


@dataclass
class Options:
    """What an inspection shows; the names are the command line's."""

    events: str | None = None
    function: str | None = None
    find: str | None = None
    around: float | None = None
    window: float | None = None
    min_dur: float = 0.0
    top: int = 30
    tid: str | None = None
    pid: int | None = None
    cat: str | None = None
    names: bool = False
    threads: bool = False
    stacks: bool = False
    flame: bool = False
    task: bool = False
    timeline: bool = False
    bucket: float | None = None
    stats: bool = False
    worst: bool = False
    sort: str = "ts"
    full_args: bool = False
    regex: bool = False
    jank: bool = False
    memory: bool = False
    all_samples: bool = False
    input: bool = False
    async_: bool = False
    anchor: str | None = None
    pre: float = 500.0
    post: float = 500.0
    delta: bool = False
    calltree: bool = False
    url: str | None = None
    gc: bool = False
    lt: float = 50.0
    frames: bool = False
    frame_event: str = inspect.FRAME_EVENT
    always_cpu: bool = False

    @property
    def inspects(self) -> bool:
        return any((self.events, self.function, self.find, self.names, self.threads, self.stacks, self.flame, self.task, self.timeline, self.worst, self.jank, self.memory, self.input, self.async_, self.delta, self.calltree, self.gc, self.frames))


@dataclass
class Windows:
    scope: Scope
    anchor_ts: float | None = None
    note: str | None = None
    warning: str | None = None
    parts: dict[str, tuple[float, float]] = field(default_factory=dict)


class TraceSession:
    """One trace of an event table."""

    def __init__(self, events: DataFrame, name: str, metadata: dict | None = None):
        self.name, self.metadata = name, metadata or {}
        self.events = events.where(F.col("trace_id") == name).cache()
        self.throttle = self.metadata.get("cpu_throttling") or 1.0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "TraceSession":
        events = traces.read_traces(spark, path)
        name = traces.trace_stem(path)
        meta = traces.read_metadata(spark, path, events).first()
        return cls(events, name, meta.asDict() if meta else None)

    @cached_property
    def context(self) -> dict:
        row = timebase.context(self.events).first()
        return row.asDict() if row else {"min_ts": None, "last_ts": None, "end_ts": 0.0, "main_tid": 0}

    @property
    def base(self) -> float:
        return self.context["min_ts"] or 0.0

    # Windows

    def windows(self, o: Options) -> Windows:
        tid = None if o.tid is None else int(self.context["main_tid"]) if o.tid == "main" else int(o.tid)
        scope = Scope(None, tid, o.pid, o.cat.lower() if o.cat else None)
        half, out = o.window, Windows(scope)
        if o.worst:
            w = timebase.worst_task(self.events, scope).first()
            if w:
                half = o.window if o.window is not None else max(w.dur / 2000, 50.0)
                out.anchor_ts, out.note = w.ts, f"Anchored at worst RunTask: t={T.ms(w.ts - self.base)}ms, dur={T.ms(w.dur)}ms (window ±{half:.0f}ms)"
        elif o.anchor:
            a = timebase.find_anchor(self.events, Matcher(o.anchor, o.regex)).first()
            if a:
                out.anchor_ts, out.note = a.ts, f"Anchored at {a.kind} `{a.label}` — t={T.ms(a.ts - self.base)}ms"
            else:
                out.warning = f"anchor {o.anchor} matched nothing"
        elif o.around is not None:
            out.anchor_ts = self.base + o.around * 1000
        if out.anchor_ts is not None:
            out.parts = timebase.windows_around(out.anchor_ts, (100.0 if half is None else half) * 1000, o.pre * 1000, o.post * 1000)
            out.scope = scope.with_window(out.parts["shoot"])
        return out

    # Sections: (key, Markdown, value)

    def sections(self, o: Options, w: Windows | None = None) -> list[tuple]:
        w = w or self.windows(o)
        fn = Matcher(o.function, o.regex) if o.function else None
        e, s, out = self.events, w.scope, []

        def rows(df: DataFrame, *order: str, drop: tuple = ("trace_id", "rank", "total")) -> list[dict]:
            return [{k: plain(v) for k, v in r.asDict(recursive=True).items() if k not in drop} for r in (df.orderBy(*order) if order else df).collect()]

        def show(key: str, title: str, value, head: dict[str, str] | None = None) -> None:
            out.append((key, markdown(title, value, head), value))

        if o.jank:
            found = analysis.jank_clusters(e, s).cache()
            calls = analysis.jank_calls(e, found, s).orderBy("rank", "call_rank").collect()
            show("jank", "Jank clusters", [{"rank": r.rank, "t_us": half_up(r.start_us - self.base), "span_us": half_up(r.end_us - r.start_us), "busy_us": half_up(r.busy_us), "max_run_us": half_up(r.max_run_us), "max_faf_us": half_up(r.max_faf_us), "max_gpu_us": half_up(r.max_gpu_us), "dropped_frames": r.dropped, "top_calls": [{"name": c.name, "dur_us": half_up(c.dur_us)} for c in calls if c.rank == r.rank]} for r in found.orderBy("rank").limit(o.top).collect()])
        if o.memory:
            out.append(self._memory(s, o))
        if o.input:
            show("input", "Input latency", {"types": by_total(rows(inspect.input_types(e, s))), "worst": rows(inspect.input_worst(e, s, o.top), "rank")})
        if o.async_:
            show("async", "Async tasks", {"tasks": by_total(rows(inspect.async_tasks(e, s))), "longest": rows(inspect.async_longest(e, s, o.top), "rank")})
        if o.timeline:
            show("timeline", "Timeline", rows(inspect.timeline(e, s, o.bucket), "bucket"))
        if o.task:
            got = rows(inspect.tasks(e, s, o.top), "rank", drop=("trace_id",))
            show("task", "RunTask breakdown", got)
        if o.names:
            show("names", "Event names", rows(inspect.names(e, s, o.sort, o.top), "rank"))
        if o.threads:
            show("threads", "Threads", rows(inspect.threads(e, s, o.top), "rank"))
        if o.events:
            f = NameFilter.parse(o.events, o.regex)
            if o.stats:
                show("stats", f"Duration stats: {o.events}", by_total(rows(inspect.stats(e, f, s, o.min_dur))))
            else:
                out.append(self._events(f, o.events, s, o, o.sort))
        if fn:
            show("functions", f"CPU functions matching {fn.label}", rows(cpu.matching_functions(e, fn, s, o.top), "rank"))
        if o.stacks:
            got = rows(cpu.stacks(e, fn, s, o.top), "rank", drop=("trace_id", "node_id", "exact_us"))
            show("stacks", "Heaviest call stacks", got)
        if o.calltree:
            known, own = cpu.nodes(e), cpu.self_times(e, s)
            show("calltree", "CPU call tree (inclusive)", rows(cpu.call_tree(known, own, fn, Matcher(o.url, o.regex) if o.url else None, o.top), "rank", drop=("trace_id", "rank", "node_id")))
        if o.gc:
            out.append(self._gc(s, o))
        if o.frames:
            show("frames", f"Frames: {o.frame_event}", rows(inspect.frames(e, s, o.frame_event)))
        if o.find:
            out.append(self._find(Matcher(o.find, o.regex), s, o))
        if o.delta:
            if w.parts:
                value = self.delta(w, o)
                out.append(("delta", markdown("Delta: PRE → SHOOT → POST", value["metrics"]) + markdown("Top CPU", [{"window": k, "top": ", ".join(f"{x['function']} ({T.ms(x['self_us'], 1)}ms)" for x in v) or "—"} for k, v in value["top_cpu"].items()]), value))
            else:
                out.append(("delta", "**A delta needs an anchor: --anchor, --around or --worst.**\n\n", None))
        if o.worst and not out:
            out.append(self._events(NameFilter(("RunTask",)), "RunTask", s, replace(o, min_dur=0.0), "dur"))
        return out

    def _events(self, f: NameFilter, label: str, s: Scope, o: Options, sort: str) -> tuple:
        got = inspect.events_list(self.events, f, s, o.min_dur, sort, o.top).orderBy("rank").collect()
        total = got[0].total if got else 0
        value = [{"t_us": r.t_us, "dur_us": r.dur_us, "name": r.name, "tid": int(r.tid), "pid": int(r.pid), "args": parsed(r.args)} for r in got]
        shown = [{**v, "args": T.clip(r.args or "", 2000 if o.full_args else 160)} for v, r in zip(value, got)]
        note = f"\n_Showing {len(got)} of {total} matches._\n" if total > len(got) else ""
        return "events", markdown(f"Events: {label} ({total} matches)", shown) + note, value

    def _find(self, m: Matcher, s: Scope, o: Options) -> tuple:
        got = inspect.find(self.events, m, s, o.top).orderBy("rank").collect()
        value = [{"t_us": r.t_us, "dur_us": r.dur_us, "name": r.name, "tid": int(r.tid), "args": parsed(r.args)} for r in got]
        shown = []
        for v in value:
            raw = json.dumps(v["args"], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            hit = re.search(m.pattern if m.regex else re.escape(m.pattern), raw, 0 if m.regex else re.IGNORECASE)
            shown.append({**{k: v[k] for k in ("t_us", "dur_us", "name", "tid")}, "match": T.clip(raw, 500) if o.full_args else "…" + T.around(raw, hit.start() if hit else 0, len(hit[0]) if hit else 0) + "…"})
        md = markdown(f"Find {m.label} in event args ({got[0].total if got else 0} matches)", shown)
        if got or o.always_cpu:
            more = cpu.matching_urls(self.events, m, s, o.top).orderBy("rank").collect()
            extra = [{"source": "cpu-profile", "function": r.function, "self_us": r.self_us, "url": r.url} for r in more]
            md, value = md + markdown(f"CPU profile matches ({len(extra)} functions/URLs)", extra), value + extra
        return "find", md, value

    def _gc(self, s: Scope, o: Options) -> tuple:
        order = list(inspect.GC_GROUPS)
        groups = sorted(({"group": r.group, "count": r["count"], "total_us": r.total_us, "max_us": r.max_us} for r in inspect.gc(self.events, s).collect()), key=lambda r: order.index(r["group"]))
        lt = inspect.gc_long_tasks(self.events, s, o.lt * 1000).first()
        long = {"threshold_us": half_up(o.lt * 1000), "count": lt["count"] if lt else 0, "total_us": lt.total_us if lt else 0.0, "max_us": lt.max_us if lt else 0.0, "top_us": list(lt.top_us) if lt else []}
        md = markdown("GC & long tasks", groups) + f"- **Long tasks ≥{o.lt:.0f}ms**: {long['count']} total, {T.ms(long['total_us'], 1)}ms combined, max {T.ms(long['max_us'], 1)}ms\n\n"
        return "gc", md, [{"gc": groups, "long_tasks": long}]

    def _memory(self, s: Scope, o: Options) -> tuple:
        samples = inspect.memory_samples(self.events, s).cache()
        m = inspect.memory_summary(samples).first()
        if not m:
            return "memory", markdown("Memory timeline", []), {"summary": {"samples": 0}, "samples": []}
        mb = lambda b: b / 1_048_576
        summary = {"samples": m.samples, "first_heap_mb": mb(m.first_heap), "last_heap_mb": mb(m.last_heap), "growth_mb": mb(m.growth), "peak_heap_mb": mb(m.peak_heap), "peak_heap_t_us": half_up(m.peak_ts - self.base), "peak_nodes": m.peak_nodes, "peak_documents": m.peak_documents, "peak_listeners": m.peak_listeners}
        row = lambda r: {"t_us": half_up(r.ts - self.base), "heap_mb": mb(r.heap), "nodes": r.nodes, "documents": r.documents, "listeners": r.listeners}
        few = [row(r) for r in inspect.downsample(samples, ["ts", "seq"], o.top).orderBy("ts", "seq").collect()]
        every = [row(r) for r in samples.orderBy("ts", "seq").toLocalIterator()] if o.all_samples else few
        return "memory", markdown("Memory timeline", [summary]) + markdown("Samples", few), {"summary": summary, "samples": every}

    def delta(self, w: Windows, o: Options) -> dict:
        got = self.delta_rows(w, o).orderBy("ord").collect()
        num = lambda r, v: v if r.unit == "n" else half_up(v / 100) / 10
        metrics = [{"metric": r.metric, "unit": r.unit, **{k: num(r, r[k]) for k in ("pre", "shoot", "post", "delta_pre", "delta_post")}} for r in got]
        top = delta.top_cpu(self.events, w.parts).orderBy("rank").collect()
        return {"anchor_us": half_up(w.anchor_ts), "windows": {k: [half_up(a), half_up(b)] for k, (a, b) in w.parts.items()}, "metrics": metrics, "top_cpu": {k: [{"function": r.function, "self_us": r.self_us} for r in top if r.win == k] for k in delta.WINDOWS}}

    def delta_rows(self, w: Windows, o: Options) -> DataFrame:
        return delta.delta_rows(delta.window_stats(self.events, w.parts, o.frame_event, o.lt), o.lt)

    def flame(self, o: Options) -> str:
        m = Matcher(o.function, o.regex) if o.function else None
        return "".join(r.line + "\n" for r in cpu.folded(self.events, m, self.windows(o).scope).orderBy("rank").collect())

    # Whole-trace report data

    @cached_property
    def analyses(self) -> dict:
        e = self.events
        one = lambda df: (lambda r: r.asDict() if r else None)(df.first())
        scroll, layout, style, reflow = analysis.scroll_frames(e).cache(), analysis.layout_dirty(e).cache(), analysis.style_recalc(e).cache(), analysis.forced_reflows(e).cache()
        clusters = analysis.jank_clusters(e).cache()
        funcs = cpu.functions(e).cache()
        listed = analysis.cumulative_pct(funcs, "self_us", [F.col("self_us").desc(), F.col("node_id")])
        return {
            "summary": one(analysis.summary(e)) or {"duration_us": 0.0, "busy_us": 0.0, "long_tasks": 0},
            "long": [r.dur for r in analysis.long_tasks(e).orderBy("rank").collect()],
            "breakdown": analysis.breakdown(e).orderBy(F.col("total_us").desc(), "name").collect(),
            "scroll": one(analysis.scroll_summary(scroll)), "scroll_rows": scroll.orderBy("ts", "task").limit(10).collect(),
            "layout": one(analysis.layout_summary(layout)), "layout_rows": layout.orderBy(F.col("dirty").desc(), "seq").limit(10).collect(),
            "style": one(analysis.style_summary(style)), "style_rows": style.orderBy(F.col("elements").desc(), "seq").limit(10).collect(),
            "reflow": one(reflow.agg(F.count("*").alias("tasks"), F.sum("reflows").alias("reflows"), F.sum("layout_us").alias("layout_us"))), "reflow_rows": reflow.orderBy(F.col("reflows").desc(), "task").limit(10).collect(),
            "jank": clusters.orderBy("rank").collect(), "calls": analysis.jank_calls(e, clusters).orderBy("rank", "call_rank").collect(),
            "dropped": e.where(F.col("name") == "DroppedFrame").count(),
            "cpu": one(cpu.source_totals(funcs)), "cpu_rows": listed.orderBy(F.col("self_us").desc(), "node_id").limit(30).collect(),
            "frames": {"scroll": scroll, "layout": layout, "style": style, "funcs": funcs},
        }

    def metrics(self) -> DataFrame:
        f = self.analyses["frames"]
        return compare.metrics(analysis.summary(self.events), analysis.scroll_summary(f["scroll"]), analysis.layout_summary(f["layout"]), analysis.style_summary(f["style"]))

    def against(self, other: "TraceSession") -> dict:
        return {
            "events": compare.event_rows(analysis.breakdown(self.events), analysis.breakdown(other.events)).orderBy(F.abs("diff_pct").desc(), "name").collect(),
            "cpu": compare.cpu_diff(self.analyses["frames"]["funcs"], other.analyses["frames"]["funcs"]).orderBy("rank").collect(),
            "findings": compare.findings(self.metrics(), other.metrics()).collect(),
        }


def half_up(v: float) -> float:
    """Round half away from zero, as the tables do."""
    return float(int(abs(v) + 0.5)) * (1 if v >= 0 else -1)


def plain(v):
    import decimal

    return int(v) if isinstance(v, decimal.Decimal) else v


def parsed(raw: str | None):
    try:
        return None if raw is None else json.loads(raw)
    except ValueError:
        return raw


def markdown(title: str, value, head: dict[str, str] | None = None) -> str:
    """A heading and a table of rows; times in µs show as ms."""
    if isinstance(value, dict):
        return f"## {title}\n\n" + "".join(markdown(k, v) for k, v in value.items() if isinstance(v, list))
    if not value:
        return f"## {title}\n\nNothing found.\n\n"
    keys = list(head or value[0])

    def cell(k, v):
        if isinstance(v, float):
            return T.ms(v) if k.endswith("_us") else f"{v:.2f}"
        if isinstance(v, list):
            return " → ".join(map(str, v)) if k == "stack" and len(v) <= 14 else " → ".join([*v[:2], "…", *v[-10:]]) if k == "stack" else "; ".join(" ".join(map(str, x.values())) if isinstance(x, dict) else str(x) for x in v)
        return "" if v is None else str(v)

    return f"## {title}\n\n" + T.table([(head or {}).get(k, k.replace("_us", "(ms)")) for k in keys], [[cell(k, r.get(k)) for k in keys] for r in value])


def by_total(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (-r["total_us"], r.get("name") or r.get("type")))
