"""Spans of a regular expression in a text column, with SQL functions only, and span digests.

Positions are code points, end exclusive.  ``find`` gives the leftmost non-overlapping matches; the pieces
between matches fix the positions.  Patterns should be possessive so that long runs cost linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<kind:string,start:int,end:int,hit:string>>"


def find(text: Column, pattern: Column | str, kind: str, holds=None, needs: str | None = None) -> Column:
    """Spans of pattern in text; ``holds(hit)`` drops matches afterwards; ``needs``: literal any match contains."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    some = F.regexp_like(text, p) if needs is None else F.contains(text, F.lit(needs)) & F.regexp_like(text, p)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, p, -1), lambda x: F.length(x))
    zipped = F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), F.length(h).alias("n"), h.alias("hit")))
    spans = F.when(some, place(zipped, kind)).otherwise(F.array().cast(SPAN))
    return F.filter(spans, lambda s: holds(s["hit"])) if holds else spans


def place(zipped: Column, kind: str) -> Column:
    """Running positions of (gap, n, hit) rows."""

    def run(begin: Column, part: Column) -> Column:
        zero = F.struct(begin.alias("at"), F.array().cast(SPAN).alias("out"))
        step = lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["hit"].alias("hit")))).cast(SPAN).alias("out"))
        return F.aggregate(part, zero, step, lambda a: a["out"])

    return run(F.lit(0), zipped)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans), 256)


def mask(text: Column, spans: Column, label) -> Column:
    """text with each span replaced by label(kind, hit); of overlapping spans the first to start (the longer on a tie) is used."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind"), s["hit"].alias("hit"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        skip = s["start"] < a["at"]
        add = F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), label(s["kind"], s["hit"]))
        return F.struct(F.when(skip, a["at"]).otherwise(-s["stop"]).alias("at"), F.when(skip, a["out"]).otherwise(F.concat(a["out"], add)).alias("out"))

    def last(a):
        return F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(order, zero, step, last))
