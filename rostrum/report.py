"""A self-contained HTML report from metric frames; the ledger shows at most CAP rows, every figure counts all."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

CAP = 1500
STYLE = "body{font:15px sans-serif;margin:2em auto;max-width:70em}table{border-collapse:collapse}td,th{padding:.3em .7em;border-bottom:1px solid #ddd;text-align:left}.bar{background:#88a;height:.7em}"


def bar(value: float | None, most: float) -> str:
    width = max(0, min(100, round(100 * (value or 0) / most))) if most else 0
    return f'<div class="bar" style="width:{width}%"></div>'


def table(title: str, df: DataFrame, cap: int = CAP) -> str:
    """A section of at most `cap` rows of `df`, in its order."""
    rows = df.limit(cap + 1).collect()
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape('—' if v is None else str(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in rows[:cap])
    more = f"<p>First {cap} rows.</p>" if len(rows) > cap else ""
    return f"<h2>{html.escape(title)}</h2><table><tr>{cells('th', df.columns)}</tr>{body}</table>{more}"


def build(title: str, sections: dict[str, DataFrame]) -> str:
    inner = "".join(table(k, v) for k, v in sections.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{inner}</body></html>"
