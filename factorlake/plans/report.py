"""Files for people: CSV tables, and an HTML page with inline SVG charts. Small frames only, brought to the driver here."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import ic_chart, ic_histogram


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, written by the executors."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """One CSV file: for report tables of a row a day at most."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False)


def format_value(v) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v:,.4f}"
    return html.escape(f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v))


def table(df: DataFrame, limit: int = 2000) -> str:
    names = df.columns
    rows = df.limit(limit + 1).collect()
    more = f"<p>The first {limit} rows; the CSV file beside this page has all.</p>" if len(rows) > limit else ""
    rows = rows[:limit]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in names)
    body = "".join("<tr>" + "".join(f"<td>{format_value(r[c])}</td>" for c in names) + "</tr>" for r in rows)
    return f"{more}<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" if rows else "<p>No rows.</p>"


def line_chart(df: DataFrame, x: str, y: str, title: str, width: int = 860, height: int = 240) -> str:
    """An SVG line, with its points as JSON beside it."""
    points = [(str(r[x]), float(r[y])) for r in df.where(f"{y} is not null").orderBy(x).collect()]
    if not points:
        return f"<h3>{html.escape(title)}</h3><p>No data.</p>"
    lo, hi = min(v for _, v in points), max(v for _, v in points)
    span, n = (hi - lo) or 1.0, max(1, len(points) - 1)
    path = " ".join(f"{'L' if i else 'M'}{i * width / n:.1f},{height - (v - lo) / span * height:.1f}" for i, (_, v) in enumerate(points))
    data = json.dumps(points)
    return f"<h3>{html.escape(title)}</h3><p>{points[0][0]} to {points[-1][0]}; {lo:.4f} to {hi:.4f}</p><svg viewBox='0 0 {width} {height}' width='100%' height='{height}'><path d='{path}' fill='none' stroke='#276' stroke-width='1.5'/></svg><script type='application/json'>{data}</script>"


STYLE = """body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 8px;text-align:right}h2{margin-top:2em}
.card{display:inline-block;border:1px solid #ccc;border-radius:6px;padding:8px 14px;margin:4px}.card b{display:block;font-size:18px}
.tabs>input{display:none}.tabs>label{display:inline-block;padding:6px 14px;border:1px solid #ccc;cursor:pointer}.tabs>section{display:none}.grid{display:grid;grid-template-columns:1fr 1fr;gap:1em}"""
#: Colours of lines, in order.
COLOURS = ("#276", "#c63", "#36c", "#a3a", "#888", "#222")


def page(title: str, body: str) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def tabs(parts: dict[str, str]) -> str:
    """One part at a time, by the labels above; without scripts."""
    heads, bodies, rules = [], [], []
    for i, (name, body) in enumerate(parts.items()):
        heads.append(f"<input type='radio' name='tab' id='tab{i}'{' checked' if i == 0 else ''}><label for='tab{i}'>{html.escape(name)}</label>")
        bodies.append(f"<section id='part{i}'>{body}</section>")
        rules.append(f"#tab{i}:checked~#part{i}{{display:block}}#tab{i}:checked+label{{background:#dee}}")
    return f"<style>{''.join(rules)}</style><div class='tabs'>{''.join(heads)}{''.join(bodies)}</div>"


def cards(df: DataFrame) -> str:
    """A card a measure of a table's first row."""
    row = df.first()
    if row is None:
        return "<p>No rows.</p>"
    return "".join(f"<div class='card'>{html.escape(c.replace('_', ' '))}<b>{format_value(row[c]) or '-'}</b></div>" for c in df.columns)


def heat_map(df: DataFrame, label: str) -> str:
    """A table whose numbers are coloured, green above 0 and red below, the darker the larger."""
    rows, names = df.collect(), [c for c in df.columns if c != label]
    numbers = [r[c] for r in rows for c in names if isinstance(r[c], float)]
    most = max((abs(x) for x in numbers), default=0.0) or 1.0

    def cell(v) -> str:
        if not isinstance(v, float):
            return f"<td>{format_value(v)}</td>"
        return f"<td style='background:rgba({'0,140,60' if v >= 0 else '200,40,40'},{min(1.0, abs(v) / most):.2f})'>{v:.2%}</td>"

    head = "".join(f"<th>{html.escape(c)}</th>" for c in [label, *names])
    body = "".join(f"<tr><th>{html.escape(str(r[label]))}</th>{''.join(cell(r[c]) for c in names)}</tr>" for r in rows)
    return f"<table class='heat'><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" if rows else "<p>No rows.</p>"


def bars_and_lines(title: str, labels: list, bars: list | None = None, lines: dict[str, list] | None = None, width: int = 620, height: int = 240) -> str:
    """An SVG chart of bars from 0, and of lines over them, all on one scale; None leaves a gap."""
    lines = lines or {}
    numbers = [float(v) for values in ([bars] if bars else []) + list(lines.values()) for v in values if v is not None]
    if not numbers:
        return f"<div><h3>{html.escape(title)}</h3><p>No data.</p></div>"
    lo, hi = min(0.0, *numbers), max(0.0, *numbers)
    y = lambda v: height - (v - lo) / ((hi - lo) or 1.0) * height
    step, parts = width / max(1, len(labels)), [f"<line x1='0' x2='{width}' y1='{y(0.0):.1f}' y2='{y(0.0):.1f}' stroke='#999'/>"]
    for i, v in enumerate(bars or []):
        if v is not None:
            parts.append(f"<rect x='{i * step:.1f}' y='{min(y(v), y(0.0)):.1f}' width='{max(0.8 * step, 0.5):.1f}' height='{abs(y(v) - y(0.0)):.1f}' fill='#8bc'><title>{html.escape(str(labels[i]))}: {v:.4f}</title></rect>")
    for k, (name, values) in enumerate(lines.items()):
        path, pen = [], "M"
        for i, v in enumerate(values):
            if v is None:
                pen = "M"
            else:
                path.append(f"{pen}{(i + 0.5) * step:.1f},{y(v):.1f}")
                pen = "L"
        parts.append(f"<path d='{' '.join(path)}' fill='none' stroke='{COLOURS[k % len(COLOURS)]}' stroke-width='1.5'><title>{html.escape(str(name))}</title></path>")
    named = "".join(f" <span style='color:{COLOURS[k % len(COLOURS)]}'>{html.escape(str(n))}</span>" for k, n in enumerate(lines))
    return f"<div><h3>{html.escape(title)}</h3><p>{html.escape(str(labels[0]))} to {html.escape(str(labels[-1]))}; {lo:.4f} to {hi:.4f}{named}</p><svg viewBox='0 0 {width} {height}' width='100%' height='{height}'>{''.join(parts)}</svg></div>"


def factor_page(report, path: str, period: int | None = None, window: int = 20, bins: int = 50, max_lag: int = 20) -> None:
    """One page with a factor report's table and, for each factor, four charts of one period: IC with its moving average, its histogram, curves of the quantile groups, and IC decay."""
    period = period if period is not None else report.periods[min(1, len(report.periods) - 1)]
    own = F.col("period") == period
    order = lambda rows, *keys: sorted(rows, key=lambda r: tuple(r[k] for k in keys))
    ic = order(ic_chart(report.ic_series().where(own), window).collect(), "factor", "date")  # a row a factor and day
    counts = order(ic_histogram(report.ic_series().where(own), bins).collect(), "factor", "bin")
    curves = order(report.layered().cumulative_returns.where(own).collect(), "factor", "date", "grp")
    decay = order(report.ic_decay(max_lag).collect(), "factor", "lag")
    parts = {"summary": table(report.summary().orderBy("factor", "period"))}
    for name in dict.fromkeys(r["factor"] for r in ic):
        mine = lambda rows: [r for r in rows if r["factor"] == name]  # noqa: B023, E731
        days = sorted({r["date"] for r in mine(curves)})
        found = {(r["grp"], r["date"]): r["cumulative"] for r in mine(curves)}
        n = {r["bin"]: r["n"] for r in mine(counts)}
        charts = [
            bars_and_lines(f"IC, period {period}", [r["date"] for r in mine(ic)], [r["ic"] for r in mine(ic)], {f"mean of {window}": [r["ma"] for r in mine(ic)]}),
            bars_and_lines(f"IC histogram, {bins} bins", list(range(1, bins + 1)), [float(n.get(b, 0)) for b in range(1, bins + 1)]),
            bars_and_lines("Cumulative returns of quantile groups", days, None, {f"group {g}": [found.get((g, d)) for d in days] for g in sorted({g for g, _ in found})}) if days else bars_and_lines("Cumulative returns of quantile groups", [0]),
            bars_and_lines("IC decay by lag", [r["lag"] for r in mine(decay)] or [0], [r["ic"] for r in mine(decay)]),
        ]
        parts[name] = f"<div class='grid'>{''.join(charts)}</div>"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(page("Factor report", tabs(parts)), encoding="utf-8")


def export_report(analyzer, folder: str) -> list[str]:
    """Statistics, equity curve, trades and an HTML page of tabs in `folder`; older pages there are removed."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for old in out.glob("*.html"):
        old.unlink()
    frames = {"summary_stats": analyzer.summary_stats(), "equity_curve": analyzer.nav(), "rebalance_records": analyzer.rebalance_records(), "monthly_returns": analyzer.monthly_returns(), "activity": analyzer.activity()}
    if analyzer.benchmarks is not None:
        frames["benchmark_stats"] = analyzer.benchmark_stats()
    for name, df in frames.items():
        write_small_csv(df, str(out / f"{name}.csv"))
    rolling = analyzer.rolling_sharpe()
    curves = [line_chart(analyzer.nav(), "date", "nav", "Equity"), line_chart(analyzer.nav(), "date", "drawdown", "Drawdown"), line_chart(rolling, "date", "sharpe", "Rolling Sharpe (60)")]
    book = [line_chart(analyzer.overview(), "date", "turnover", "Turnover"), line_chart(analyzer.overview(), "date", "cash", "Cash")]
    parts = {"overview": cards(frames["summary_stats"]) + (f"<h2>benchmarks</h2>{table(frames['benchmark_stats'])}" if "benchmark_stats" in frames else ""), "curves": "".join(curves), "months": heat_map(analyzer.monthly_table().orderBy("year").drop("strategy"), "year")}
    parts |= {"portfolio": "".join(book) + f"<h2>days with trades</h2>{table(frames['activity'])}", "trades": table(frames["rebalance_records"])}
    (out / "report.html").write_text(page(analyzer.name, tabs(parts)), encoding="utf-8")
    return sorted(p.name for p in out.iterdir())


def export_run(result, analyzer, folder: str) -> None:
    """The tables of a strategy run as CSV folders."""
    for name, df in {"stats": analyzer.summary_stats(), "equity": result.equity_curve, "returns": result.returns, "positions": result.positions, "trades": result.trades, "trade_details": result.trade_details}.items():
        write_csv(df, f"{folder}/{name}")
