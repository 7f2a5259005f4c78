"""Small pages and digests of finished tables; what is rendered is collected and bounded."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A page shows so many rows at most and says how many there are.
MOST_ROWS = 5_000


class Digest:
    """A text report, line by line."""

    def __init__(self):
        self.lines: list[str] = []

    def header(self, text: str) -> Digest:
        self.lines += [text, "=" * len(text)]
        return self

    def value(self, key: str, value: object) -> Digest:
        self.lines.append(f"{key}: {value}")
        return self

    def section(self, title: str, rows: DataFrame, most: int = 20) -> Digest:
        shown = rows.limit(most + 1).collect()
        self.lines += ["", title, "-" * len(title)]
        self.lines += ["  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in shown[:most]]
        if len(shown) > most:
            self.lines.append(f"... {rows.count() - most} more rows")
        return self

    def render(self) -> str:
        return "\n".join(self.lines) + "\n"


def feature_pivot(rows: DataFrame, columns: Sequence[str], value: str = "r", p: str = "p") -> str:
    """An HTML table, features by response: the value, stars of its p, a colour by size."""
    wide = rows.withColumn("cell", F.concat(F.format_number(value, 3), F.when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("")))
    table = wide.groupBy("feature").pivot("response", list(columns)).agg(F.first("cell").alias("text"), F.first(value).alias("size")).orderBy("feature")
    total = table.count()
    body = []
    for r in table.limit(MOST_ROWS).collect():
        cells = []
        for c in columns:
            size = r[f"{c}_size"]
            shade = 0 if size is None else min(1.0, abs(size))
            tone = f"rgba(200,60,60,{shade:.2f})" if (size or 0) < 0 else f"rgba(60,110,200,{shade:.2f})"
            cells.append(f'<td style="background:{tone}">{html.escape(r[f"{c}_text"] or "")}</td>')
        body.append(f"<tr><th>{html.escape(r['feature'])}</th>{''.join(cells)}</tr>")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><caption>{total} features</caption><tr><th></th>{head}</tr>{''.join(body)}</table>"


def _table(rows: DataFrame, columns: Sequence[str], title: str) -> str:
    shown = rows.select(*columns).limit(MOST_ROWS + 1).collect()
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in shown[:MOST_ROWS])
    more = f"<p>The first {MOST_ROWS} of {rows.count()} rows.</p>" if len(shown) > MOST_ROWS else ""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>{more}"


def page(title: str, sections: dict[str, DataFrame]) -> str:
    """A whole HTML page of tables, in the order given."""
    parts = "".join(_table(rows, rows.columns, name) for name, rows in sections.items())
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>"


def fit_quality_page(summaries: dict[str, DataFrame]) -> str:
    """How well each analyzer's models fit: its rows, without those of single features."""
    kept = {}
    for name, rows in summaries.items():
        ids = [c for c in ("model", "response") if c in rows.columns]
        marks = [c for c in ("cv_r2", "r2", "marginal_r2", "conditional_r2", "aic", "n", "n_rows", "status") if c in rows.columns]
        if ids and marks:
            kept[name] = rows.groupBy(*ids).agg(*(F.first(c, ignorenulls=True).alias(c) for c in marks)).orderBy(*ids)
    return page("Fit quality", kept)


def selection_page(selected: dict[str, DataFrame]) -> str:
    return page("Selected features", {name: rows.orderBy(*[c for c in ("model", "response", "place", "feature") if c in rows.columns]) for name, rows in selected.items()})


def model_effects_page(effects: DataFrame) -> str:
    return page("Model effects", {"effects": effects.orderBy(*[c for c in ("response", "model", "term", "feature") if c in effects.columns])})
