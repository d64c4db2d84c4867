"""Predicates: scope, matchers, classifiers.  All are Columns, so Catalyst pushes what it can to the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Event names that only describe the trace.
METADATA_NAMES = ["thread_name", "process_name", "thread_sort_index", "process_sort_index"]
# URL parts of library code.
RUNTIME_MARKS = ["node_modules", "svelte", "react", "vue", "angular", "polyfill", "vendor", "chunk-", ".min."]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_ci(hay: Column | str, needle: str) -> Column:
    """Case-insensitive substring; an empty needle is refused."""
    if not needle:
        raise ValueError("empty search pattern")
    return F.contains(F.lower(col(hay)), F.lit(needle.lower()))


@dataclass(frozen=True)
class Scope:
    """Window (inclusive, µs), thread, process and category; None leaves a part open."""

    window: tuple[float, float] | None = None
    tid: int | None = None
    pid: int | None = None
    cat: str | None = None

    def without_window(self) -> "Scope":
        return Scope(None, self.tid, self.pid, self.cat)

    def with_window(self, window) -> "Scope":
        return Scope(window, self.tid, self.pid, self.cat)

    @property
    def everything(self) -> bool:
        return self == Scope()

    def events(self) -> Column:
        """Rows inside the window with the wanted thread, process and category."""
        test = self.chunks()
        if self.window:
            test = F.col("ts").between(*map(float, self.window)) & test
        return test

    def chunks(self) -> Column:
        """The same without the window; a missing category fails a category test."""
        test = F.lit(True)
        if self.tid is not None:
            test = test & (F.col("tid") == self.tid)
        if self.pid is not None:
            test = test & (F.col("pid") == self.pid)
        if self.cat is not None:
            test = test & F.coalesce(contains_ci("cat", self.cat), F.lit(False))
        return test


@dataclass(frozen=True)
class Matcher:
    """Case-insensitive substring, or a case-sensitive unanchored regular expression (Java dialect)."""

    pattern: str
    regex: bool = False

    def __post_init__(self):
        if not self.pattern:
            raise ValueError("empty search pattern")

    def test(self, c: Column | str) -> Column:
        return F.coalesce(col(c).rlike(self.pattern) if self.regex else contains_ci(c, self.pattern), F.lit(False))

    @property
    def label(self) -> str:
        return f"/{self.pattern}/" if self.regex else f'"{self.pattern}"'


@dataclass(frozen=True)
class NameFilter:
    """Exact event names, or regular expressions any of which may match; no names: everything."""

    names: tuple[str, ...] = ()
    regex: bool = False

    @classmethod
    def parse(cls, text: str | None, regex: bool = False) -> "NameFilter":
        return cls(tuple(x.strip() for x in (text or "").split(",") if x.strip()), regex)

    def test(self, c: Column | str = "name") -> Column:
        if not self.names:
            return F.lit(True)
        if not self.regex:
            return col(c).isin(*self.names)
        out = F.lit(False)
        for p in self.names:
            out = out | col(c).rlike(p)
        return out


def is_metadata() -> Column:
    return F.col("name").isin(METADATA_NAMES) | F.col("cat").eqNullSafe("__metadata")


def source_type(url: Column | str) -> Column:
    """native (no URL), runtime (library code) or app."""
    low = F.lower(col(url))
    hit = F.lit(False)
    for mark in RUNTIME_MARKS:
        hit = hit | F.contains(low, F.lit(mark))
    return F.when(F.coalesce(col(url), F.lit("")) == "", "native").when(hit, "runtime").otherwise("app")


def short_url(url: Column | str) -> Column:
    return F.substring_index(col(url), "/", -1)


def pct_diff(a: Column | str, b: Column | str) -> Column:
    """Change from a to b in percent; 0 where a is not positive."""
    return F.when(col(a) > 0, (col(b) - col(a)) / col(a) * 100).otherwise(0.0)


def or_anonymous(name: Column | str) -> Column:
    return F.when(col(name) == "", "(anonymous)").otherwise(col(name))
