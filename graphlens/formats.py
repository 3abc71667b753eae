"""Results as JSON lines, a JSON array, or a table for people."""

from __future__ import annotations

import json

from .session import ErrorResult, Result, SetResult, TableResult, VoidResult, collected


def records(result: Result) -> list[dict]:
    """Records without nulls; EXPLAIN's first field is empty, a null reference is said to be one."""
    if isinstance(result, ErrorResult):
        return [{"error": result.error}]
    if isinstance(result, VoidResult):
        return [result.info]
    rows = collected(result.rows)
    if isinstance(result, TableResult):
        return rows
    out = []
    for row in rows:
        own = {k: v for k, v in row.items() if v is not None}
        if not isinstance(result, SetResult):
            if "depth" in row and "field" in row:
                own.setdefault("field", "")
            if "ref" in row and row.get("ref") is None and row.get("value") is None:
                own["ref"] = "null"
        out.append(own)
    return out


def render(result: Result, form: str = "human") -> str:
    rows = records(result)
    if form == "jsonl":
        return "\n".join(json.dumps(r, default=str, ensure_ascii=False) for r in rows)
    if form == "json":
        return json.dumps(rows, default=str, ensure_ascii=False)
    return table(rows)


def table(rows: list[dict]) -> str:
    """Columns of all records in order of appearance, numbers to the right."""
    if not rows:
        return "(no results)"
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: "" if v is None else json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v)
    cells = [[text(r.get(n)) for n in names] for r in rows]
    widths = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    right = [all(isinstance(r.get(n), (int, float, type(None))) for r in rows) for n in names]
    line = lambda own: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(own, widths, right, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in widths]), *(line(c) for c in cells)])
