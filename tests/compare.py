"""Row-set comparison between a Spark result and an independent SQL result."""

from __future__ import annotations

from collections import Counter


def _cell(value: object) -> object:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(float(value)) if not isinstance(value, int) else repr(float(value))


def compare(names, rows, other_names, other_rows) -> str:
    """Empty when both hold the same rows; otherwise a short description of the difference."""
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} vs {sorted(other_names)}"
    left = sorted(range(len(names)), key=lambda i: names[i])
    right = sorted(range(len(other_names)), key=lambda i: other_names[i])
    a = Counter(tuple(_cell(row[i]) for i in left) for row in rows)
    b = Counter(tuple(_cell(row[i]) for i in right) for row in other_rows)
    if a == b:
        return ""
    return (
        f"{sum(a.values())} vs {sum(b.values())} rows; columns {sorted(names)}; "
        f"only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"
    )
