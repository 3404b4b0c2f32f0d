"""Small aggregates as SVG charts: bars, points, lines, cells, spokes. No drawing library is needed."""

from __future__ import annotations

from html import escape
from math import cos, pi, sin

from pyspark.sql import DataFrame

from revsift.sources.results import ORDER

COLOURS = ["#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5"]
WIDE, HIGH, EDGE = 720, 420, 60
#: The most rows that a chart shows; charts are for aggregates, and more is an error.
MOST = 5_000


def colour(name: str) -> str:
    """A strategy's colour, the same in every chart."""
    return COLOURS[(ORDER.index(name) if name in ORDER else sum(name.encode())) % len(COLOURS)]


def _rows(df: DataFrame) -> list:
    got = df.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError("a chart is made of an aggregate")
    return got


def _text(x: float, y: float, s, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" font-size="11">{escape(f"{s:.3g}" if isinstance(s, float) else str(s))}</text>'


def _page(title: str, body: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDE} {HIGH}" font-family="sans-serif"><rect width="{WIDE}" height="{HIGH}" fill="white"/>' + _text(WIDE / 2, 20, title) + "".join(body) + "</svg>"


def _scale(values: list[float], low: float, high: float):
    a, z = min(values, default=0.0), max(values, default=1.0)
    return lambda v: low + (v - a) / ((z - a) or 1.0) * (high - low)


def _axes(x: str, y: str) -> list[str]:
    line = f'<path d="M{EDGE} {EDGE / 2}V{HIGH - EDGE}H{WIDE - EDGE / 2}" fill="none" stroke="#888"/>'
    return [line, _text(WIDE / 2, HIGH - 12, x), f'<g transform="translate(14 {HIGH / 2}) rotate(-90)">{_text(0, 0, y)}</g>']


def bars(df: DataFrame, name: str, values: list[str], title: str, low: str | None = None, high: str | None = None) -> str:
    """A group of bars for each row, one for each value; with low and high, an interval on each first bar."""
    rows = _rows(df)
    top = max([float(r[v] or 0) for r in rows for v in values] + ([float(r[high] or 0) for r in rows] if high else []), default=1.0) or 1.0
    step, body = (WIDE - 1.5 * EDGE) / max(len(rows), 1), _axes(name, ", ".join(values))
    at = lambda v: HIGH - EDGE - (HIGH - 1.5 * EDGE) * v / top
    for i, r in enumerate(rows):
        w = step * 0.8 / len(values)
        for j, v in enumerate(values):
            x, y = EDGE + i * step + step * 0.1 + j * w, at(max(0.0, float(r[v] or 0)))
            body.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{HIGH - EDGE - y:.1f}" fill="{colour(str(r[name])) if len(values) == 1 else COLOURS[j % len(COLOURS)]}"/>' + _text(x + w / 2, y - 4, float(r[v] or 0)))
            if low and high and not j:
                body.append(f'<path d="M{x + w / 2:.1f} {at(float(r[low] or 0)):.1f}V{at(float(r[high] or 0)):.1f}" stroke="black"/>')
        body.append(_text(EDGE + (i + 0.5) * step, HIGH - EDGE + 16, r[name]))
    return _page(title, body)


def points(df: DataFrame, x: str, y: str, title: str, name: str | None = None, frontier: str | None = None) -> str:
    """A point for each row; those on the frontier are joined."""
    rows = [r for r in _rows(df) if r[x] is not None and r[y] is not None]
    sx, sy = _scale([float(r[x]) for r in rows], EDGE + 20, WIDE - EDGE), _scale([float(r[y]) for r in rows], HIGH - EDGE - 20, EDGE)
    body = _axes(x, y)
    if frontier:
        way = sorted((sx(float(r[x])), sy(float(r[y]))) for r in rows if r[frontier])
        body.append(f'<path d="M{"L".join(f"{a:.1f} {b:.1f}" for a, b in way)}" fill="none" stroke="#555"/>' if way else "")
    for r in rows:
        a, b = sx(float(r[x])), sy(float(r[y]))
        body.append(f'<circle cx="{a:.1f}" cy="{b:.1f}" r="5" fill="{colour(str(r[name])) if name else COLOURS[0]}"/>' + (_text(a, b - 9, r[name]) if name else ""))
    return _page(title, body)


def lines(df: DataFrame, x: str, y: str, title: str, name: str | None = None) -> str:
    """A line through the rows of each name, such as a precision-recall curve."""
    rows = [r for r in _rows(df) if r[x] is not None and r[y] is not None]
    sx, sy = _scale([float(r[x]) for r in rows], EDGE, WIDE - EDGE), _scale([float(r[y]) for r in rows], HIGH - EDGE, EDGE)
    body, groups = _axes(x, y), {}
    for r in rows:
        groups.setdefault(str(r[name]) if name else "", []).append((float(r[x]), float(r[y])))
    for i, (k, v) in enumerate(sorted(groups.items())):
        body.append(f'<path d="M{"L".join(f"{sx(a):.1f} {sy(b):.1f}" for a, b in sorted(v))}" fill="none" stroke="{COLOURS[i % len(COLOURS)]}" stroke-width="2"/>' + _text(WIDE - EDGE, EDGE + 14 * i, k, "end"))
    return _page(title, body)


def cells(df: DataFrame, row: str, column: str, value: str, title: str) -> str:
    """A cell for each pair of row and column: a confusion matrix, or metrics of strategies."""
    got = _rows(df)
    across, down = sorted({str(r[column]) for r in got}), sorted({str(r[row]) for r in got})
    w, h = (WIDE - 3 * EDGE) / max(len(across), 1), (HIGH - 2 * EDGE) / max(len(down), 1)
    shade = _scale([float(r[value] or 0) for r in got], 0.1, 0.9)
    body = [_text(2.5 * EDGE + (i + 0.5) * w, HIGH - EDGE / 2, c) for i, c in enumerate(across)] + [_text(2.4 * EDGE, EDGE + (i + 0.5) * h, d, "end") for i, d in enumerate(down)]
    for r in got:
        x, y = 2.5 * EDGE + across.index(str(r[column])) * w, EDGE + down.index(str(r[row])) * h
        body.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{COLOURS[0]}" fill-opacity="{shade(float(r[value] or 0)):.2f}" stroke="white"/>' + _text(x + w / 2, y + h / 2 + 4, float(r[value] or 0)))
    return _page(title, body)


def spokes(df: DataFrame, name: str, values: list[str], title: str) -> str:
    """A polygon for each row over values within 0 and 1."""
    cx, cy, size = WIDE / 2, HIGH / 2 + 10, HIGH / 2 - EDGE
    place = lambda i, v: (cx + size * v * sin(2 * pi * i / len(values)), cy - size * v * cos(2 * pi * i / len(values)))
    body = [f'<path d="M{cx} {cy}L{place(i, 1)[0]:.1f} {place(i, 1)[1]:.1f}" stroke="#ccc"/>' + _text(*place(i, 1.15), v) for i, v in enumerate(values)]
    for i, r in enumerate(_rows(df)):
        way = "L".join("{:.1f} {:.1f}".format(*place(j, max(0.0, min(1.0, float(r[v] or 0))))) for j, v in enumerate(values))
        body.append(f'<path d="M{way}Z" fill="{colour(str(r[name]))}" fill-opacity="0.15" stroke="{colour(str(r[name]))}"/>' + _text(WIDE - 10, 40 + 14 * i, r[name], "end"))
    return _page(title, body)


def counts(df: DataFrame, value: str, title: str, bins: int = 30) -> str:
    """A histogram of a column of any size: binned by the cluster, drawn from the bins."""
    from pyspark.sql import functions as F

    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return _page(title, [])
    width = (float(hi) - float(lo)) / bins or 1.0
    of = F.least(F.floor((F.col(value) - float(lo)) / width), F.lit(bins - 1))
    b = df.where(F.col(value).isNotNull()).groupBy(of.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin")
    return bars(b.select(F.round(F.col("bin") * width + float(lo), 3).alias("from"), "n"), "from", ["n"], title)


def benchmark_charts(summary: DataFrame, losses: DataFrame, frontier: DataFrame) -> dict[str, str]:
    """A run's charts by name."""
    rates = ["freshness_success_rate", "cache_preservation_success_rate", "relative_freshness_rate", "rank_agreement_rate"]
    long = summary.selectExpr("strategy_name", f"stack({len(rates)}, " + ", ".join(f"'{r}', {r}" for r in rates) + ") as (metric, value)")
    return {
        "strategies": bars(summary, "strategy_name", ["candidate_update_fraction"], "Share embedded again"),
        "quality": bars(summary, "strategy_name", rates[:2], "Success rates"),
        "frontier": points(frontier, "cost", "quality", "Cost and quality", "strategy_name", "on_frontier"),
        "heatmap": cells(long, "strategy_name", "metric", "value", "Rates"),
        "radar": spokes(summary, "strategy_name", rates, "Rates"),
        "staleness": lines(losses, "k", "loss_rate", "Hits lost by k", "strategy_name"),
    }


def experiment_charts(importance: DataFrame, curve: DataFrame, confusion: DataFrame, scores: DataFrame, coverage: DataFrame) -> dict[str, str]:
    """Charts of a model's evaluation: importance (feature, importance), curve (recall, precision), confusion (needs, done, n),
    scores (drift), coverage (strategy_name, coverage)."""
    return {
        "importance": bars(importance.orderBy(importance["importance"].desc()).limit(20), "feature", ["importance"], "What the model uses"),
        "precision_recall": lines(curve, "recall", "precision", "Precision and recall"),
        "confusion": cells(confusion, "needs", "done", "n", "Needed and done"),
        "drift": counts(scores, "drift", "Drift"),
        "coverage": bars(coverage, "strategy_name", ["coverage"], "Needed that was embedded again"),
    }
