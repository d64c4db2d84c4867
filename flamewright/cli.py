"""Command line: python -m flamewright.cli TRACE [options]; a folder lists or exports its traces; --repl keeps a trace loaded."""

from __future__ import annotations

import argparse
import sys
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession, functions as F

from .operators import delta, inspect
from .plans.session import Options, TraceSession
from .render import blocks, html, report
from .sources import traces

FLAGS = ("names", "threads", "stacks", "flame", "task", "timeline", "stats", "worst", "full-args", "regex", "jank", "memory", "input", "delta", "calltree", "gc", "frames", "always-cpu")
TEXTS = ("events", "function", "find", "tid", "cat", "anchor", "url")
BATCH = 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flamewright", description="Analyse browser performance traces.")
    p.add_argument("trace", nargs="?")
    p.add_argument("--repl", action="store_true")
    p.add_argument("-c", "--compare")
    p.add_argument("-e", "--export", nargs="?", const="-")
    p.add_argument("--html", nargs="?", const="-")
    p.add_argument("-t", "--throttle", type=float)
    p.add_argument("-s", "--summary", action="store_true")
    for name in FLAGS:
        p.add_argument(f"--{name}", action="store_true")
    for name in TEXTS:
        p.add_argument(f"--{name}")
    for name, value in (("around", None), ("window", None), ("min-dur", 0.0), ("bucket", None), ("pre", 500.0), ("post", 500.0), ("lt", 50.0)):
        p.add_argument(f"--{name}", type=float, default=value)
    p.add_argument("--async", dest="async_", action="store_true")
    p.add_argument("--top", type=int, default=30)
    p.add_argument("--pid", type=int)
    p.add_argument("--sort", default="ts")
    p.add_argument("--frame-event", default=inspect.FRAME_EVENT)
    p.add_argument("--json", action="store_true")
    p.add_argument("--csv", action="store_true")
    return p


def options(a: argparse.Namespace) -> Options:
    return Options(**{k: getattr(a, k) for k in Options.__dataclass_fields__ if k != "all_samples"}, all_samples=bool(a.json or a.csv))


def inspect_output(s: TraceSession, a: argparse.Namespace) -> str:
    o = options(a)
    if o.flame:
        return s.flame(o)
    w = s.windows(o)
    if w.warning:
        print(f"warning: {w.warning}", file=sys.stderr)
    sections = s.sections(o, w)
    shoot = w.parts.get("shoot")
    if a.json:
        rel = [float(round((t - s.base) / 1000)) for t in shoot] if shoot else None
        return blocks.envelope(s.name, sections, rel, w.note) + "\n"
    if a.csv:
        return blocks.csv_blocks(sections)
    head = f"# Inspect: {s.name}\n\n" + (f"**{w.note}**\n\n" if w.note else "")
    if shoot:
        head += f"**Window**: {(shoot[0] - s.base) / 1000:.2f}ms … {(shoot[1] - s.base) / 1000:.2f}ms from trace start\n\n"
    return head + "".join(md for _, md, _ in sections)


def compare_output(a_s: TraceSession, b_s: TraceSession, a: argparse.Namespace) -> str:
    """Both traces' sections, and with a delta the merged metrics."""
    o = options(a)
    if o.flame:
        return f"# {a_s.name}\n" + a_s.flame(o) + f"# {b_s.name}\n" + b_s.flame(o)
    both = [(s, w, s.sections(o, w)) for s in (a_s, b_s) for w in [s.windows(o)]]
    rows = []
    if o.delta and all(w.parts for _, w, _ in both):
        (sa, wa, _), (sb, wb, _) = both
        rows = delta.compare_windows(sa.delta_rows(wa, o), sb.delta_rows(wb, o)).orderBy("ord").collect()
    merged = [{k: v for k, v in r.asDict().items() if k != "ord"} for r in rows]
    if a.json:
        import json

        return json.dumps({"a": {"trace": a_s.name, "sections": {k: v for k, _, v in both[0][2]}}, "b": {"trace": b_s.name, "sections": {k: v for k, _, v in both[1][2]}}, "compare": merged or None}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    if a.csv:
        return blocks.csv_blocks(both[0][2], "a") + blocks.csv_blocks(both[1][2], "b") + (f"# compare\n{blocks.csv_rows(merged)}" if merged else "")
    text = "".join(f"# {n}: {s.name}\n\n" + "".join(md for _, md, _ in sec) for n, (s, _, sec) in zip("AB", both))
    return text + (report.windows(a_s.name, b_s.name, rows) if rows else "")


def put(spark: SparkSession, target: str, text: str) -> str:
    """Write to a file of any store that Spark knows and say so, or return the text for standard output."""
    if target == "-":
        return text
    traces.put_text(spark, target, text)
    return f"exported to {target}\n"


def full_output(s: TraceSession, other: TraceSession | None, a: argparse.Namespace) -> str:
    if a.throttle:
        s.throttle = a.throttle
    md = report.summary_only(s, other) if a.summary else report.full(s, other)
    if a.html:
        return put(s.events.sparkSession, a.html, html.report(s, md, other))
    return put(s.events.sparkSession, a.export or "-", md)


def folder(spark: SparkSession, path: str, a: argparse.Namespace) -> str:
    """List the folder's traces, or export a report beside each of them, a few at a time; a broken trace is reported and skipped."""
    paths = traces.list_traces(spark, path)
    if not a.export:
        return "".join(f"{traces.trace_stem(p)}\n" for p in paths)

    def one(p: str) -> str:
        stem = traces.trace_stem(p)
        try:
            return put(spark, f"{path.rstrip('/')}/trace-export-{stem}.md", full_output(TraceSession.open(spark, p), None, argparse.Namespace(**{**vars(a), "export": "-", "html": None})))
        except Exception as e:
            return f"{stem}: {str(e).splitlines()[0]}\n"

    with ThreadPoolExecutor(BATCH) as pool:
        return "".join(pool.map(one, paths))


def run(spark: SparkSession, argv: list[str]) -> str:
    a = parser().parse_args(argv)
    if not a.trace:
        raise SystemExit("a trace file or folder is needed")
    if a.repl:
        repl(spark, a.trace)
        return ""
    if traces.is_folder(spark, a.trace):
        return folder(spark, a.trace, a)
    s = TraceSession.open(spark, a.trace)
    other = TraceSession.open(spark, a.compare) if a.compare else None
    if options(a).inspects:
        return compare_output(s, other, a) if other is not None else inspect_output(s, a)
    return full_output(s, other, a)


# Interactive use


def words(line: str) -> list[str]:
    """Split a command line: quotes group, a backslash outside single quotes takes the next character as it is."""
    out, word, quote, took = [], "", "", False
    chars = iter(line)
    for c in chars:
        if c == "\\" and quote != "'":
            word += next(chars, "")
        elif quote:
            quote, word = ("", word) if c == quote else (quote, word + c)
        elif c in "'\"":
            quote = c
        elif c in " \t":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
        took = bool(word)
    return out + [word] * took


def expand(tokens: list[str]) -> list[str]:
    """A bare first word stands for its flag; "stats X" for --events X --stats; "name=value" for --name=value."""
    first, *rest = tokens
    if first == "stats":
        return ["--events", *rest, "--stats"]
    known = {x.lstrip("-") for act in parser()._actions for x in act.option_strings if x.startswith("--")} - {"repl", "help"}
    return [f"--{first}", *rest] if first.split("=", 1)[0] in known else tokens


class Repl:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.session, self.other = spark, TraceSession.open(spark, path), None

    def answer(self, line: str) -> str | None:
        """Output of a command; None to leave."""
        tokens = words(line)
        if not tokens:
            return ""
        if tokens[0] in ("quit", "exit", "q"):
            return None
        if tokens[0] in ("help", "?"):
            return parser().format_help()
        if tokens[0] == "clear":
            return "\x1b[2J\x1b[H"
        if tokens[0] in ("status", "info"):
            n = self.session.events.agg(F.count("*")).first()[0]
            return f"{self.session.name}: {n} events, main thread {self.session.context['main_tid']}, throttle {self.session.throttle:g}x" + (f", compared with {self.other.name}" if self.other else "") + "\n"
        try:
            a = parser().parse_args(expand(tokens))
        except SystemExit:
            return "? bad command (try `help`)\n"
        if a.compare:
            began = time.time()
            self.other = TraceSession.open(self.spark, a.compare)
            if not options(a).inspects:
                return f"# compare `{self.session.name}` vs `{self.other.name}` built in {time.time() - began:.1f}s\n"
        if options(a).inspects:
            return compare_output(self.session, self.other, a) if a.compare else inspect_output(self.session, a)
        if a.export or a.html or a.summary:
            return full_output(self.session, self.other, a)
        if a.throttle:
            self.session.throttle = a.throttle
            return f"throttle = {a.throttle:g}x\n"
        return f"? unknown command `{a.trace}` (try `help`)\n" if a.trace else "? nothing to do (try `help`)\n"


def repl(spark: SparkSession, path: str) -> None:
    loop = Repl(spark, path)
    for line in sys.stdin:
        try:
            text = loop.answer(line.rstrip("\n"))
        except Exception as e:
            text = f"error: {str(e).splitlines()[0]}\n"
        if text is None:
            break
        print(text, end="", flush=True)


def main() -> None:
    spark = SparkSession.builder.appName("flamewright").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(run(spark, sys.argv[1:]), end="")


if __name__ == "__main__":
    main()
