"""The full Markdown report and the two-trace comparison, from a session's collected analyses."""

from __future__ import annotations

from . import text as T
from .text import change, pct, table, us, verdict_cell

# Headings, labels and column names of the report, here and in the functions below; programs that read reports look for them.
_COSTS = [("JS (FunctionCall)", "js_us"), ("Style (UpdateLayoutTree)", "style_us"), ("Layout", "layout_us"), ("Paint", "paint_us"), ("Composite (Layerize+Commit)", "composite_us"), ("HitTest", "hit_test_us")]
_SHORT = [("JS", "js_us"), ("Style (ULT)", "style_us"), ("Layout", "layout_us"), ("Paint", "paint_us"), ("HitTest", "hit_test_us"), ("Composite", "composite_us")]
_ZERO = {"avg_dirty": 0.0, "max_dirty": 0, "avg_elements": 0.0, "max_elements": 0}


def full(session, other=None) -> str:
    a = session.analyses
    parts = [f"# Trace analysis: {session.name}\n\n", _info(session), _overview(a, session.name), _scroll(a), _cpu(a), _layout(a), _style(a), _reflow(a), _jank(a), _breakdown(a)]
    if other is not None:
        diff = session.against(other)
        parts += [summary(session, other, diff), detail(session, other, diff)]
    return "".join(parts)


def summary_only(session, other=None) -> str:
    return summary(session, other, session.against(other)) if other is not None else "No comparison data: compare with a second trace.\n"


def _info(session) -> str:
    m, lines = session.metadata, []
    if not m:
        return f"> **Note**: the given throttle factor is {session.throttle:.0f}; an unthrottled device would take about a {session.throttle:.0f}th of the times below.\n\n" if session.throttle > 1 else ""
    if m.get("page_url"):
        lines.append(f"- **URL**: {m['page_url']}")
    if m.get("start_time"):
        lines.append(f"- **Recorded**: {m['start_time']}")
    if (m.get("cpu_throttling") or 0) > 1:
        lines.append(f"- **CPU Throttle**: {m['cpu_throttling']:.0f}x (all times below are throttled ones)")
    if m.get("network_throttling") not in (None, "", "No throttling"):
        lines.append(f"- **Network**: {m['network_throttling']}")
    if m.get("host_dpr") is not None:
        lines.append(f"- **DPR**: {m['host_dpr']:g}")
    return "**Trace Info**\n\n" + "".join(x + "\n" for x in lines) + "\n"


def _overview(a: dict, name: str) -> str:
    s = a["summary"]
    lines = [f"- **Trace**: {name}", f"- **Duration**: {us(s['duration_us'])}", f"- **Main Thread Busy**: {pct(s['busy_us'], s['duration_us']):.1f}% ({us(s['busy_us'])})", f"- **Long Tasks (>50ms)**: {s['long_tasks']}"]
    if a["long"]:
        lines.append("- **Top Long Tasks**: " + ", ".join(map(us, a["long"][:5])))
    return "## Overview\n\n" + "\n".join(lines) + "\n\n"


def _scroll(a: dict) -> str:
    s = a["scroll"]
    if not s:
        return "## Scroll Frame Analysis\n\nNothing scrolled: no RunTask holds a style update or call longer than 50ms.\n\n"
    head = f"- **Scroll Tasks**: {s['frames']}\n- **Avg Duration**: {us(s['dur_us'])}\n- **P50**: {us(s['p50_us'])} / **P90**: {us(s['p90_us'])} / **P99**: {us(s['p99_us'])}\n- **Bottleneck**: {s['bottleneck']}\n\n"
    costs = table(["Category", "Time", "% of Task"], [[n, us(s[k]), f"{pct(s[k], s['dur_us']):.1f}%"] for n, k in _COSTS])
    rows = table(["#", "Duration", "Bottleneck", "JS", "Style", "Layout", "Paint"], [[i + 1, us(r.dur_us), r.bottleneck, us(r.js_us), us(r.style_us), us(r.layout_us), us(r.paint_us)] for i, r in enumerate(a["scroll_rows"])])
    return f"## Scroll Frame Analysis\n\n{head}### Average Breakdown (per task)\n\n{costs}### Worst Scroll Tasks\n\n{rows}"


def _cpu(a: dict) -> str:
    c, title = a["cpu"], "## CPU Profile (Top Functions by Self-Time)\n\n"
    if not c:
        return title + "The trace holds no profile: there are no ProfileChunk events.\n\n"
    share = lambda n, k: f"- **{n}**: {us(c[k])} ({pct(c[k], c['total_us']):.1f}%)\n"
    head = f"- **Total Sample Time**: {us(c['total_us'])}\n" + share("App Code", "app_us") + share("Runtime/Library", "runtime_us") + share("Native/Browser", "native_us") + "\n"
    rows = [[i + 1, r.source, r.name or "(anonymous)", us(r.self_us), f"{r.pct:.1f}%", f"{r.cumulative_pct:.1f}%", r.url.rsplit("/", 1)[-1]] for i, r in enumerate(a["cpu_rows"])]
    return title + head + table(["#", "Source", "Function", "Self Time", "%", "Cumulative %", "File"], rows)


def _layout(a: dict) -> str:
    s, title = a["layout"], "## Layout Dirty Objects\n\n"
    if not s:
        return title + "No layout says how many objects were dirty.\n\n"
    head = f"- **Layout Events**: {s['layouts']}\n- **Avg Dirty Objects**: {s['avg_dirty']:.0f}\n- **Max Dirty Objects**: {s['max_dirty']}\n- **Avg Dirty Ratio**: {s['avg_ratio']:.1f}%\n\n"
    return title + head + table(["#", "Duration", "Dirty", "Total", "Ratio"], [[i + 1, us(r.dur_us), r.dirty, r.total, f"{pct(r.dirty, r.total):.1f}%"] for i, r in enumerate(a["layout_rows"])])


def _style(a: dict) -> str:
    s = a["style"]
    if not s:
        return ""
    head = f"## Style Recalc (UpdateLayoutTree)\n\n- **Events**: {s['recalcs']}\n- **Avg Elements**: {s['avg_elements']:.0f}\n- **Max Elements**: {s['max_elements']}\n\n"
    return head + table(["#", "Duration", "Elements"], [[i + 1, us(r.dur_us), r.elements] for i, r in enumerate(a["style_rows"])])


def _reflow(a: dict) -> str:
    s = a["reflow"]
    if not s or not s["tasks"]:
        return ""
    head = f"## Forced Reflow (Layout Thrashing)\n\n- **Tasks with thrashing**: {s['tasks']}\n- **Total reflows**: {s['reflows']}\n- **Total layout time**: {us(s['layout_us'])}\n\n"
    return head + table(["#", "Task Duration", "Reflows", "Layout Time"], [[i + 1, us(r.task_dur_us), r.reflows, us(r.layout_us)] for i, r in enumerate(a["reflow_rows"])])


def _jank(a: dict) -> str:
    if not a["jank"] and not a["dropped"]:
        return ""
    calls = lambda r: ", ".join(f"{c.name} ({us(c.dur_us)})" for c in a["calls"] if c.rank == r.rank) or "—"
    rows = [[r.rank, us(r.start_us), us(r.end_us - r.start_us), us(r.busy_us), us(r.max_run_us), us(r.max_faf_us), us(r.max_gpu_us), r.dropped, calls(r)] for r in a["jank"]]
    return f"## Jank Clusters\n\n- **Total dropped frames**: {a['dropped']}\n\n" + table(["#", "t", "span", "busy", "max RunTask", "max FAF", "max GPUTask", "dropped", "what happened"], rows)


def _breakdown(a: dict) -> str:
    return "## Event Breakdown\n\n" + table(["Event", "Total", "Count", "Avg", "% of Trace"], [[r.name, us(r.total_us), r["count"], us(r.avg_us), f"{r.pct:.1f}%"] for r in a["breakdown"]])


def _pair(name: str, a: float, b: float, show=us, cell=verdict_cell) -> list:
    return [name, show(a), show(b), cell(a, b)]


def summary(sa, sb, diff: dict) -> str:
    """The short form for a review: verdict, scroll figures, causes, regressions, notes."""
    a, b = sa.analyses, sb.analyses
    out = [f"## Summary: {sa.name} vs {sb.name}\n\n"]
    head, whole, x, y = ["Metric", "Before", "After", "Change"], lambda v: f"{v:.0f}", a["scroll"], b["scroll"]
    if x and y:
        d = (y["p50_us"] - x["p50_us"]) / x["p50_us"] * 100 if x["p50_us"] > 0 else 0.0
        out.append(f"**Overall**: {'Improved' if d < -5 else 'Regressed' if d > 5 else 'No significant change'} (Scroll P50 {d:.0f}%)\n\n### Scroll Performance\n\n")
        out.append(table(head, [_pair(n, x[k], y[k]) for n, k in [("P50", "p50_us"), ("P90", "p90_us"), ("Avg Duration", "dur_us"), *_SHORT]]))
    la, lb, ta, tb = (s or _ZERO for s in (a["layout"], b["layout"], a["style"], b["style"]))
    causes = []
    if a["style"] or b["style"]:
        causes += [_pair("Style Elements (avg)", ta["avg_elements"], tb["avg_elements"], whole), _pair("Style Elements (max)", ta["max_elements"], tb["max_elements"], whole)]
    causes.append(_pair("Layout Dirty (avg)", la["avg_dirty"], lb["avg_dirty"], whole))
    avg = {r.name: (r.avg_a_us, r.avg_b_us) for r in diff["events"]}
    io = avg.get("IntersectionObserverController::computeIntersections", (0, 0))
    if max(io) > 0:
        causes.append(_pair("IO (avg)", *io))
    out.append("### Root Cause\n\n" + table(head, causes))
    if x and y:
        worse = [_pair(n, x[k], y[k]) for n, k in _SHORT if (x[k] > 0 and (y[k] - x[k]) / x[k] * 100 > 5) or (x[k] <= 0 < y[k])]
        if worse:
            out.append("### Regressions\n\n" + table(head, worse))
    s, t = a["summary"], b["summary"]
    notes = [f"Long Tasks: {s['long_tasks']} → {t['long_tasks']} ({change(s['long_tasks'], t['long_tasks'])}). Tasks outside scrolling count too.", f"Main Thread Busy: {us(s['busy_us'])} → {us(t['busy_us'])} ({change(s['busy_us'], t['busy_us'])}). Tasks outside scrolling count too."]
    notes += [f"{n}: avg {us(avg[n][0])} → {us(avg[n][1])} ({change(*avg[n])})" for n in ("MajorGC", "MinorGC") if n in avg and max(avg[n]) > 0]
    return "".join(out) + "### Notes\n\n" + "".join(f"- {n}\n" for n in notes) + "\n"


def detail(sa, sb, diff: dict) -> str:
    a, b = sa.analyses, sb.analyses
    out = [f"## Comparison: {sa.name} (A) vs {sb.name} (B)\n\n"]
    if diff["findings"]:
        mark = {"Regressed": "!", "Improved": "+"}
        out.append("### Key Findings\n\n" + "".join(f"- **[{mark[f.severity]}]** {f.severity.upper()} {f.finding}: {f.value_a:.1f} → {f.value_b:.1f} ({f.pct:+.1f}%)\n" for f in diff["findings"]) + "\n")
    head, whole = ["Metric", "A", "B", "Change"], lambda v: f"{v:.0f}"
    s, t, la, lb, ta, tb = a["summary"], b["summary"], *(v or _ZERO for v in (a["layout"], b["layout"], a["style"], b["style"]))
    worst = [(x["long"] or [0.0])[0] for x in (a, b)]
    rows = [_pair("Long Tasks", s["long_tasks"], t["long_tasks"], whole, change), _pair("Worst Task", *worst, us, change), _pair("Main Thread Busy", s["busy_us"], t["busy_us"], us, change), _pair("Layout Dirty (avg)", la["avg_dirty"], lb["avg_dirty"], whole, change)]
    if a["style"] or b["style"]:
        rows += [_pair("Style Elements (avg)", ta["avg_elements"], tb["avg_elements"], whole, change), _pair("Style Elements (max)", ta["max_elements"], tb["max_elements"], whole, change)]
    out.append("### Quick Stats\n\n" + table(head, rows))
    x, y = a["scroll"], b["scroll"]
    if x and y:
        out.append("### Scroll Frame Comparison (per task avg)\n\n" + table(["Category", "A", "B", "Change"], [_pair(n, x[k], y[k], us, change) for n, k in [("Duration", "dur_us"), *_SHORT]]))
        out.append(f"- **A Bottleneck**: {x['bottleneck']} ({x['frames']} tasks)\n- **B Bottleneck**: {y['bottleneck']} ({y['frames']} tasks)\n\n")
    out.append("### Per-Event Average Comparison\n\n" + table(["Event", "Avg (A)", "Avg (B)", "Change"], [_pair(r.name, r.avg_a_us, r.avg_b_us, us, change) for r in diff["events"]]))
    if diff["cpu"]:
        out.append("### CPU Profile Diff (Top Functions by Impact)\n\n" + table(["Source", "Function", "A %", "B %", "Change (pp)"], [[r.source, r.name or "(anonymous)", f"{r.pct_a:.1f}%", f"{r.pct_b:.1f}%", f"{r.pct_b - r.pct_a:+.1f}pp"] for r in diff["cpu"][:20]]))
    return "".join(out)


def windows(name_a: str, name_b: str, rows: list) -> str:
    """Merged metric table of two traces' windows around their anchors."""
    show = lambda r, v: f"{int(v)}" if r.unit == "n" else T.ms(v, 1)
    body = [[r.metric, show(r, r.a_shoot), show(r, r.a_delta), show(r, r.b_shoot), show(r, r.b_delta), show(r, r.diff_shoot), show(r, r.diff_delta)] for r in rows]
    return f"## Windows: {name_a} (A) vs {name_b} (B)\n\n" + table(["metric", "A", "A−PRE", "B", "B−PRE", "B−A", "Δ(B)−Δ(A)"], body)
