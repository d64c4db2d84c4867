"""A self-contained HTML report: inline CSS and SVG, no scripts."""

from __future__ import annotations

import re
from html import escape

STYLE = "body{font:14px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:70rem;padding:0 1rem;color:#1d2733}table{border-collapse:collapse;margin:1rem 0}td,th{border:1px solid #d5dbe1;padding:.25rem .6rem;text-align:left}th{background:#f2f5f8}svg{background:#fbfcfd;border:1px solid #d5dbe1}"


def decimate(points: list[tuple[float, float]], most: int = 700) -> list[tuple[float, float]]:
    """At most ``most`` evenly spaced points, first and last included."""
    n = len(points)
    return points if n <= most else [points[k * (n - 1) // (most - 1)] for k in range(most)]


def line_chart(points: list[tuple[float, float]], title: str, unit: str, width: int = 860, height: int = 220) -> str:
    """points: (ms, value).  The value axis is padded by 5 %; times of 2000 ms and more show in seconds."""
    if len(points) < 2:
        return ""
    points = decimate(points)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    pad = (max(ys) - min(ys)) * 0.05 or 1.0
    lo, hi, x0, x1 = min(ys) - pad, max(ys) + pad, min(xs), max(xs)
    left, top, w, h = 60, 24, width - 80, height - 54
    px = lambda x: left + (x - x0) / ((x1 - x0) or 1) * w
    py = lambda y: top + h - (y - lo) / (hi - lo) * h
    seconds = x1 >= 2000
    grid = "".join(f'<line x1="{left}" x2="{left + w}" y1="{py(v):.1f}" y2="{py(v):.1f}" stroke="#e3e8ed"/><text x="{left - 6}" y="{py(v) + 4:.1f}" font-size="11" text-anchor="end">{v:.1f}</text>' for v in (lo + (hi - lo) * k / 4 for k in range(5)))
    ticks = "".join(f'<text x="{px(x):.1f}" y="{height - 10}" font-size="11" text-anchor="middle">{x / 1000:.1f}s</text>' if seconds else f'<text x="{px(x):.1f}" y="{height - 10}" font-size="11" text-anchor="middle">{x:.0f}ms</text>' for x in (x0 + (x1 - x0) * k / 4 for k in range(5)))
    path = " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in points)
    return f'<svg role="img" width="{width}" height="{height}"><text x="{left}" y="16" font-size="12">{escape(title)} ({escape(unit)})</text>{grid}{ticks}<polyline fill="none" stroke="#2f6fde" stroke-width="1.5" points="{path}"/></svg>'


def from_markdown(md: str) -> str:
    """The report's own Markdown subset: headings, lists, tables, bold, code."""
    out, rows, listed = [], [], False

    def inline(s: str) -> str:
        return re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", re.sub(r"`([^`]+)`", r"<code>\1</code>", escape(s)))

    def close() -> None:
        nonlocal rows, listed
        if rows:
            head, *body = rows
            out.append("<table><tr>" + "".join(f"<th>{inline(c)}</th>" for c in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in r) + "</tr>" for r in body) + "</table>")
        if listed:
            out.append("</ul>")
        rows, listed = [], False

    for line in md.splitlines():
        if line.startswith("|"):
            cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)[1:-1]]
            if not all(set(c) <= {"-"} for c in cells):
                rows.append(cells)
        elif line.startswith("- "):
            if not listed:
                close()
                out.append("<ul>")
                listed = True
            out.append(f"<li>{inline(line[2:])}</li>")
        else:
            close()
            if m := re.match(r"(#+) (.*)", line):
                out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            elif line.strip():
                out.append(f"<p>{inline(line)}</p>")
    close()
    return "\n".join(out)


def page(title: str, md: str, charts: list[str]) -> str:
    return f"<!doctype html>\n<html lang='en'><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}</style></head><body>\n{''.join(charts)}\n{from_markdown(md)}\n</body></html>\n"


def report(session, md: str, other=None) -> str:
    """The Markdown report as a page with the heap and busy charts of one or both traces."""
    from ..plans.session import Options

    charts = []
    for s in (session, *([other] if other is not None else [])):
        for key, _, value in s.sections(Options(memory=True, timeline=True)):
            if key == "memory" and value["samples"]:
                charts.append(line_chart([(r["t_us"] / 1000, r["heap_mb"]) for r in value["samples"]], f"{s.name}: JS heap", "MB"))
            if key == "timeline":
                charts.append(line_chart([(r["t_us"] / 1000, r["busy"] * 100) for r in value], f"{s.name}: main thread busy", "%"))
    return page(f"Trace analysis: {session.name}", md, charts)
