"""HTML reports: summaries and bounded tables of DataFrames."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells as cell_ops
from .expression import top_markers


@dataclass
class Section:
    title: str
    body: str
    order: int = 0


@dataclass
class Report:
    title: str = "Analysis report"
    sections: list[Section] = field(default_factory=list)

    def add_summary(self, title: str, values: dict, order: int = 0) -> None:
        items = "".join(f"<li><b>{html.escape(str(k))}</b>: {html.escape(f'{v:.4f}' if isinstance(v, float) else str(v))}</li>" for k, v in values.items())
        self.sections.append(Section(title, f"<ul>{items}</ul>", order))

    def add_table(self, title: str, df: DataFrame, max_rows: int = 50, order: int = 0) -> None:
        """The first rows; a note tells the number of all where there are more."""
        rows = df.limit(max_rows + 1).collect()
        note = f"<p>{max_rows} of {df.count()} rows</p>" if len(rows) > max_rows else ""
        cell = lambda v: html.escape(f"{v:.4f}" if isinstance(v, float) else str(v))
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows[:max_rows])
        self.sections.append(Section(title, f"<table><tr>{head}</tr>{body}</table>{note}", order))

    def add_text(self, title: str, text: str, order: int = 0) -> None:
        self.sections.append(Section(title, f"<p>{html.escape(text)}</p>", order))

    def add_markdown(self, title: str, text: str, order: int = 0) -> None:
        """Headings, bullets, bold, emphasis between asterisks, and code; the rest is text."""
        lines, out, listed = text.split("\n"), [], False
        for line in lines:
            x = html.escape(line.strip())
            x = re.sub(r"`([^`]+)`", r"<code>\1</code>", x)
            x = re.sub(r"\*\*([^*]+)\*\*", r"<b>\1</b>", x)
            x = re.sub(r"(?<!\*)\*([^*\s][^*]*)\*(?!\*)", r"<i>\1</i>", x)
            bullet = x.startswith("- ")
            if bullet != listed:
                out.append("<ul>" if bullet else "</ul>")
                listed = bullet
            depth = len(x) - len(x.lstrip("#"))
            out.append(f"<li>{x[2:]}</li>" if bullet else f"<h{depth + 2}>{x[depth:].strip()}</h{depth + 2}>" if 1 <= depth <= 4 else f"<p>{x}</p>" if x else "")
        self.sections.append(Section(title, "".join(out) + "</ul>" * listed, order))

    def render(self) -> str:
        parts = "".join(f"<section><h2>{html.escape(s.title)}</h2>{s.body}</section>" for s in sorted(self.sections, key=lambda s: s.order))
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(self.title)}</title></head><body><h1>{html.escape(self.title)}</h1><p>{datetime.now():%Y-%m-%d %H:%M}</p>{parts}</body></html>"

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.render())


def clustering_report(expr: DataFrame, cells: DataFrame, markers: DataFrame | None = None, metrics: dict | None = None, title: str = "Clustering report") -> Report:
    qc = cell_ops.cell_qc(expr, cells)
    report = Report(title)
    report.add_summary("Summary", cell_ops.overall_qc(qc).first().asDict() | (metrics or {}), 0)
    report.add_table("Clusters", cell_ops.cluster_qc(qc).orderBy("cluster"), order=1)
    if markers is not None:
        report.add_table("Markers", top_markers(markers, 5).orderBy("cluster", F.desc("score")), order=2)
    return report


def comparison_report(runs: DataFrame, metrics: DataFrame | None = None, title: str = "Comparison") -> Report:
    """runs: method, cell_id, label."""
    report = Report(title)
    x = runs.groupBy("method").agg(F.count_distinct("label").alias("n_clusters"), F.count("*").alias("n_cells"))
    report.add_table("Methods", (x if metrics is None else x.join(metrics, "method", "left")).orderBy("method"))
    return report
