"""Exporters of query results: CSV, JSON, HTML tables and pages, spreadsheet HTML, grid and charts."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Callable
from typing import Any

from queryloom.service import QueryResult, QueryService


def text_of(value: Any) -> str:
    """A value as report text: nothing for null and false, 1 for true."""
    if value is None or value is False:
        return ""
    if value is True:
        return "1"
    return str(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 1e15 else str(value)


class Exporter:
    """Takes a result, or a query and the service that runs it, and renders it."""

    name, mime, extension = "", "text/plain", "txt"

    def __init__(self, service: QueryService | None = None) -> None:
        self.service, self.query, self._result = service, None, None

    def set_query(self, query: dict) -> Exporter:
        self.query, self._result = query, None
        return self

    def set_result(self, result: QueryResult) -> Exporter:
        self._result = result
        return self

    @property
    def result(self) -> QueryResult:
        if self._result is None and self.query is not None and self.service is not None:
            self._result = self.service.execute(self.query)
        if self._result is None:
            raise RuntimeError("No query result set for export.")
        return self._result

    def table(self) -> tuple[list[str], list[list[Any]]]:
        result = self.result
        names = [c["name"] for c in result.columns]
        return names, [[row.get(n) for n in names] for row in result.stream()]

    def to_string(self) -> str:
        raise NotImplementedError

    def to_file(self, path: str) -> None:
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(self.to_string())

    def to_sql(self) -> str:
        return self.result.debug


class CsvExporter(Exporter):
    name, mime, extension = "csvreportexporter", "text/csv", "csv"

    def _write(self, f: Any) -> None:
        names = [c["name"] for c in self.result.columns]
        out = csv.writer(f, lineterminator="\n")
        out.writerow(names)
        for row in self.result.stream():
            out.writerow([text_of(row.get(n)) for n in names])

    def to_string(self) -> str:
        f = io.StringIO()
        self._write(f)
        return f.getvalue()

    def to_file(self, path: str) -> None:
        """Row by row, one partition in memory."""
        with open(path, "w", encoding="utf-8", newline="") as f:
            self._write(f)

    def to_folder(self, path: str) -> None:
        """Written by the executors, for results that no driver should hold."""
        if self.result.df is not None:
            self.result.df.write.option("header", True).csv(path)


class JsonExporter(Exporter):
    name, mime, extension = "jsonreportexporter", "application/json", "json"

    def __init__(self, service: QueryService | None = None, debug: bool = False) -> None:
        super().__init__(service)
        self.debug = debug

    def to_string(self) -> str:
        body: dict[str, Any] = {"columns": self.result.columns, "rows": list(self.result.stream())}
        if self.debug:
            body["debugSql"] = self.result.debug
        return json.dumps(body, indent=4, ensure_ascii=False, default=str)

    def to_folder(self, path: str) -> None:
        if self.result.df is not None:
            self.result.df.write.json(path)


def _cells(values: list[Any], tag: str, style: str = "") -> str:
    look = f' style="{style}"' if style else ""
    return "".join(f"<{tag}{look}>{html.escape(text_of(v))}</{tag}>" for v in values)


class HtmlTableExporter(Exporter):
    """A table with its styles inline, for mails."""

    name, mime, extension = "htmltablereportexporter", "text/html", "html"
    head, cell = "border:1px solid #bbb;padding:4px 8px;background:#eee;text-align:left", "border:1px solid #bbb;padding:4px 8px"

    def to_string(self) -> str:
        names, rows = self.table()
        body = "".join(f"<tr>{_cells(r, 'td', self.cell)}</tr>" for r in rows)
        return f'<table style="border-collapse:collapse"><thead><tr>{_cells(names, "th", self.head)}</tr></thead><tbody>{body}</tbody></table>'


def page(title: str, body: str, head: str = "") -> str:
    return f'<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"><title>{html.escape(title)}</title>{head}</head>\n<body>\n{body}\n</body>\n</html>\n'


class HtmlPageExporter(Exporter):
    name, mime, extension = "htmlpagereportexporter", "text/html", "html"

    def to_string(self) -> str:
        names, rows = self.table()
        style = "<style>body{font:14px sans-serif}table{border-collapse:collapse}th,td{border:1px solid #bbb;padding:4px 8px}</style>"
        return page("Report", f"<table><thead><tr>{_cells(names, 'th')}</tr></thead><tbody>{''.join(f'<tr>{_cells(r, "td")}</tr>' for r in rows)}</tbody></table>", style)


class SpreadsheetExporter(Exporter):
    name, mime, extension = "excelhtmlreportexporter", "application/vnd.ms-excel", "xls"

    def to_string(self) -> str:
        names, rows = self.table()
        office = "urn:schemas-microsoft-com:office:"
        spaces = " ".join(f'{key}="{uri}"' for key, uri in (("xmlns:x", office + "excel"), ("xmlns:o", office + "office"), ("xmlns", "http://www.w3.org/TR/REC-html40")))
        body = "".join(f"<tr>{_cells(r, 'td')}</tr>" for r in rows)
        return f'<html {spaces}><head><meta charset="utf-8"></head><body><table border="1"><tr>{_cells(names, "th")}</tr>{body}</table></body></html>'


def script_json(value: Any) -> str:
    """JSON that is safe inside a script element."""
    text = json.dumps(value, ensure_ascii=False, default=str)
    return "".join({"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "'": "\\u0027"}.get(ch, ch) for ch in text)


class DataTableExporter(Exporter):
    """A page whose table pages itself: 10 rows at a time, of 5, 10 or 20."""

    name, mime, extension = "datatablereportexporter", "text/html", "html"

    def to_string(self) -> str:
        names, rows = self.table()
        data = script_json({"columns": names, "rows": [[text_of(v) for v in r] for r in rows], "sizes": [5, 10, 20], "size": 10})
        script = (
            "<script>const t=" + data + ";let at=0;"
            "function draw(){const e=(s)=>{const d=document.createElement('div');d.textContent=s;return d.innerHTML};"
            "const part=t.rows.slice(at,at+t.size);document.getElementById('grid').innerHTML='<tr>'+t.columns.map(c=>'<th>'+e(c)+'</th>').join('')+'</tr>'"
            "+part.map(r=>'<tr>'+r.map(v=>'<td>'+e(v)+'</td>').join('')+'</tr>').join('')}"
            "function go(n){at=Math.max(0,Math.min(at+n*t.size,Math.max(0,t.rows.length-1)));draw()}"
            "function size(n){t.size=n;at=0;draw()}draw();</script>"
        )
        sizes = "".join(f'<option{" selected" if n == 10 else ""}>{n}</option>' for n in (5, 10, 20))
        return page("Report", f'<select onchange="size(+this.value)">{sizes}</select><button onclick="go(-1)">&lt;</button><button onclick="go(1)">&gt;</button><table id="grid"></table>{script}')


class ChartExporter(Exporter):
    """First column: labels; second: values."""

    mime, extension, kind = "text/html", "html", ""

    def points(self) -> tuple[list[str], list[float]]:
        names, rows = self.table()
        if len(names) < 2:
            raise RuntimeError("A chart needs a label and a value column.")
        return [text_of(r[0]) for r in rows], [float(r[1] or 0) for r in rows]

    def draw(self, labels: list[str], values: list[float]) -> str:
        raise NotImplementedError

    def to_string(self) -> str:
        labels, values = self.points()
        data = f'<script type="application/json" id="chart-data">{script_json({"type": self.kind, "labels": labels, "values": values})}</script>'
        return page("Chart", self.draw(labels, values) + data)


class BarChartExporter(ChartExporter):
    name, kind = "barchartreportexporter", "bar"

    def draw(self, labels: list[str], values: list[float]) -> str:
        top = max([abs(v) for v in values], default=0) or 1
        bars = "".join(f'<text x="0" y="{24 * i + 16}">{html.escape(a)}</text><rect x="160" y="{24 * i + 2}" width="{400 * abs(v) / top:.1f}" height="18" fill="#47a"/><text x="{166 + 400 * abs(v) / top:.1f}" y="{24 * i + 16}">{text_of(v)}</text>' for i, (a, v) in enumerate(zip(labels, values)))
        return f'<svg width="680" height="{24 * len(labels) + 4}" font-family="sans-serif" font-size="13">{bars}</svg>'


class PieChartExporter(ChartExporter):
    name, kind = "piechartreportexporter", "doughnut"
    colors = ("#47a", "#e67", "#283", "#cb4", "#6ce", "#a37", "#bbb")

    def draw(self, labels: list[str], values: list[float]) -> str:
        total, at, out = sum(abs(v) for v in values) or 1, 0.0, []
        for i, (a, v) in enumerate(zip(labels, values)):
            part = 100 * abs(v) / total
            out.append(f'<circle r="15.9155" cx="21" cy="21" fill="none" stroke="{self.colors[i % len(self.colors)]}" stroke-width="8" stroke-dasharray="{part:.3f} {100 - part:.3f}" stroke-dashoffset="{25 - at:.3f}"><title>{html.escape(a)}: {text_of(v)}</title></circle>')
            at += part
        return f'<svg viewBox="0 0 42 42" width="360" height="360">{"".join(out)}</svg>'


EXPORTERS: dict[str, Callable[..., Exporter]] = {c.name: c for c in (CsvExporter, JsonExporter, HtmlTableExporter, HtmlPageExporter, SpreadsheetExporter, DataTableExporter, BarChartExporter, PieChartExporter)}


def exporter(name: str, service: QueryService | None = None) -> Exporter:
    """The exporter of a name, written with or without the common ending."""
    make = EXPORTERS.get(name.lower()) or EXPORTERS.get(f"{name.lower()}reportexporter")
    if make is None:
        raise RuntimeError(f"Report exporter '{name}' could not be instantiated or is invalid")
    return make(service)
