"""Strict reads of the JSON in ``args`` and tree search.

Spark's getters coerce; the readers here give null unless the JSON value has the wanted type.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

from .scope import Matcher, contains_ci


def _path(path: str) -> list[str]:
    return path.split(".")


def _typed(path: str, leaf: str, args: Column | None) -> Column:
    parts = _path(path)
    ddl = f"`{parts[-1]}`: {leaf}" if len(parts) > 1 else f"`{parts[-1]}` {leaf}"
    for p in reversed(parts[:-1]):
        ddl = f"`{p}`{'' if p == parts[0] else ':'} struct<{ddl}>"
    out = F.from_json(F.col("args") if args is None else args, ddl)
    for p in parts:
        out = out[p]
    return out


def number(path: str, args: Column | None = None) -> Column:
    """A JSON number at the path as double."""
    return _typed(path, "double", args)


def unsigned(path: str, args: Column | None = None) -> Column:
    """A non-negative JSON integer at the path."""
    v = _typed(path, "bigint", args)
    return F.when(v >= 0, v)


def text(path: str, args: Column | None = None) -> Column:
    """A JSON string at the path; numbers and objects give null."""
    v = F.variant_get(F.try_parse_json(F.col("args") if args is None else args), "$." + path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _leaves(value, words: bool) -> list[str]:
    """Strings, keys and numbers of a JSON value in document order (members by key); with words also true, false and null."""
    stack, out = [value], []
    while stack:
        v = stack.pop()
        if isinstance(v, tuple):  # an object's member: its key, then its value
            out.append(v[0])
            stack.append(v[1])
        elif isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            stack.extend(reversed(sorted(v.items())))
        elif words or not (v is None or isinstance(v, bool)):
            out.append(json.dumps(v))
    return out


def tree_match(matcher: Matcher, words: bool = True, args: str = "args") -> Column:
    """Text of the first match anywhere in the JSON of args, null if none; callers filter with ``may_match`` first.

    Python only takes the JSON apart, an Arrow batch at a time; the matcher itself runs in the JVM, so a regular expression means here what it means everywhere.
    """

    @pandas_udf("array<string>")
    def leaves(column: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return None if raw is None else _leaves(json.loads(raw), words)
            except ValueError:
                return None

        return column.map(one)

    return F.get(F.filter(leaves(F.col(args)), matcher.test), 0)


def may_match(matcher: Matcher, args: str = "args") -> Column:
    """Cheap test on the raw text that every substring match passes."""
    return F.col(args).isNotNull() if matcher.regex else F.coalesce(contains_ci(args, matcher.pattern), F.lit(False))
