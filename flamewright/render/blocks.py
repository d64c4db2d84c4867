"""JSON and CSV forms of sections: (key, Markdown, value)."""

from __future__ import annotations

import json


def compact(v) -> str:
    return json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def field(v) -> str:
    """A value as a CSV field; whole numbers with all their digits, where JSON has an exponent from 1e16 on."""
    whole = isinstance(v, float) and v.is_integer()
    s = "" if v is None else v if isinstance(v, str) else f"{v:.1f}" if whole else compact(v)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s


def csv_rows(rows: list) -> str:
    """Rows of objects as CSV; the first row's keys, in order, are the header."""
    if not rows or not isinstance(rows[0], dict):
        return ""
    keys = sorted(rows[0])
    lines = [",".join(map(field, keys))] + [",".join(field(r.get(k)) for k in keys) for r in rows if isinstance(r, dict)]
    return "\n".join(lines) + "\n"


def csv_blocks(sections: list[tuple], prefix: str | None = None) -> str:
    """A "# key" line and a CSV block for each array; an object gives a block for each of its arrays."""
    out = []
    for key, _, value in sections:
        label = f"{prefix}.{key}" if prefix else key
        if isinstance(value, list):
            out.append(f"# {label}\n{csv_rows(value)}")
        elif isinstance(value, dict):
            out += [f"# {label}.{k}\n{csv_rows(v)}" for k, v in sorted(value.items()) if isinstance(v, list)]
    return "".join(out)


def envelope(name: str, sections: list[tuple], window=None, anchor: str | None = None) -> str:
    obj = {"trace": name, "window": window, "sections": {k: v for k, _, v in sections}}
    if anchor:
        obj["anchor"] = anchor
    return json.dumps(obj, indent=2, sort_keys=True, ensure_ascii=False)
