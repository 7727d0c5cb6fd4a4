"""The measures as one page of HTML that needs nothing else: tables, bars and a line, drawn from the registered views."""

from __future__ import annotations

import datetime
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans import registry
from marlstone.sources.store import collected

ROWS = 200  # rows shown of a view; a page says how many there are
#: View, heading, order, (label, value) of a chart or none.
SECTIONS = (
    ("vw_tool_calls", "Calls by tool", ("day", "tool", "principal"), ("tool", "calls")),
    ("vw_zero_results", "Searches without results", ("day", "tenant"), None),
    ("vw_two_phase", "Documents fetched for each search", ("tenant",), None),
    ("vw_eval_trend", "Evaluation runs", ("run",), ("run", "queries")),
    ("vw_llm_calls", "Model calls", ("day", "provider", "model", "caller"), ("provider", "tokens")),
    ("vw_connector_health", "Age of cursors", ("source", "tenant"), None),
    ("vw_spend_daily", "Spend in the vendors' units", ("day", "tenant", "provider"), ("provider", "cost_units")),
)
STYLE = "body{font:14px sans-serif;margin:2em auto;max-width:60em}table{border-collapse:collapse}td,th{padding:2px 8px;border-bottom:1px solid #ccc;text-align:left}svg text{font-size:12px}"


def bars(items: list[tuple], width: int = 640) -> str:
    """One bar for each (label, value), as long as its share of the longest."""
    top = max((v for _, v in items), default=0) or 1
    rows = [
        f'<text x="0" y="{20 * k + 14}">{escape(str(label))}</text><rect x="170" y="{20 * k + 3}" width="{max(2, (width - 250) * v / top):.1f}" height="14" fill="#357"/><text x="{width - 70}" y="{20 * k + 14}">{v}</text>'
        for k, (label, v) in enumerate(items)
    ]
    return f'<svg role="img" width="{width}" height="{20 * len(items) + 6}">{"".join(rows)}</svg>' if items else ""


def table(columns: list[str], rows: list, total: int) -> str:
    if not rows:
        return '<p class="empty">no data yet</p>'
    cell = lambda v: "—" if v is None else escape(str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    more = f"<p>{len(rows)} of {total} rows, the last ones</p>" if total > len(rows) else ""
    return f"<table><thead><tr>{''.join(f'<th>{escape(c)}</th>' for c in columns)}</tr></thead><tbody>{body}</tbody></table>{more}"


def section(heading: str, view: DataFrame, order: tuple, chart: tuple | None) -> str:
    """The chart over all rows, summed in Spark, and the last rows of the view."""
    total = collected(view.agg(F.count(F.lit(1)).alias("n")))[0]["n"]
    rows = collected(view.orderBy(*[F.desc(c) for c in order]).limit(ROWS))[::-1]
    drawn = ""
    if chart:
        label, value = chart
        sums = view.groupBy(label).agg(F.sum(value).alias("v")).orderBy(F.desc("v"), label).limit(ROWS)
        drawn = bars([(r[label], r["v"]) for r in collected(sums)])
    return f"<section><h2>{escape(heading)}</h2>{drawn}{table(view.columns, rows, total)}</section>"


def report(spark: SparkSession, sf_dir: str, title: str = "Measures", at: datetime.datetime | None = None) -> str:
    """The page; what a view holds is escaped."""
    views, at = registry.queries(), at or datetime.datetime.now(datetime.UTC)
    body = "".join(section(heading, views[name](spark, sf_dir), order, chart) for name, heading, order, chart in SECTIONS)
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style><h1>{escape(title)}</h1><p>made {at:%Y-%m-%d %H:%M} UTC</p>{body}'
