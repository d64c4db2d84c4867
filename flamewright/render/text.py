"""Number formats of the reports, on collected values; ties round half to even on the exact binary value."""

from __future__ import annotations


def us(v: float) -> str:
    if abs(v) < 0.01:
        return "0"
    if abs(v) >= 1e6:
        return f"{v / 1e6:.2f}s"
    return f"{v / 1e3:.2f}ms" if abs(v) >= 1e3 else f"{v:.0f}us"


def ms(v: float, digits: int = 2) -> str:
    return f"{v / 1000:.{digits}f}"


def pct(part: float, whole: float) -> float:
    return part / whole * 100 if whole > 0 else 0.0


def change(a: float, b: float) -> str:
    """Signed change in percent, "-" where a is not positive."""
    if a <= 0:
        return "-"
    d = (b - a) / a * 100
    return f"{'+' if d > 0 else ''}{d:.1f}%"


def verdict_cell(a: float, b: float) -> str:
    """Change cell of the summary: worse is flagged, better by more than 5 % ticked."""
    if a <= 0:
        return "-" if b <= 0 else "new"
    d = (b - a) / a * 100
    return f"+{d:.0f}% :red_circle:" if d > 0 else f"{d:.0f}%{' :white_check_mark:' if d < -5 else ''}"


def clip(s: str, most: int) -> str:
    return s if len(s) <= most else s[:most] + "…"


def around(s: str, at: int, length: int, margin: int = 60) -> str:
    return s[max(0, at - margin) : at + length + margin]


def table(head: list[str], rows: list[list]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "|".join("---" for _ in head) + "|"]
    lines += ["| " + " | ".join(str(c).replace("|", "\\|") for c in r) + " |" for r in rows]
    return "\n".join(lines) + "\n\n"
