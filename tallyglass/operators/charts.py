"""Charts without a plotting library: which chart a question asks for, which columns it shows, and the rows to draw."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Words that ask for a chart, in the order in which they are looked for; a bar chart otherwise.
CHART_WORDS = [("pie", ["pie", "tỷ lệ", "proportion"]), ("line", ["line", "trend", "tháng", "month", "time"]), ("scatter", ["scatter"])]
#: Points that a scatter chart draws one by one, at most; beyond that it draws cells of a grid.
MAX_POINTS = 5_000


@dataclass
class ChartSpec:
    """kind: bar, line, pie, scatter, or none (with a reason)."""

    kind: str
    x: str | None = None
    y: str | None = None
    title: str = ""
    options: dict = field(default_factory=dict)


def classify(schema: T.StructType) -> dict[str, str]:
    """Quantitative for numbers, Categorical for all else (booleans and dates too)."""
    return {f.name: "Quantitative" if isinstance(f.dataType, T.NumericType) else "Categorical" for f in schema}


def chart_type(question: Column) -> Column:
    """The kind of chart that a question asks for."""
    from tallyglass.plans.router import has_any

    out = None
    for kind, words in CHART_WORDS:
        case = has_any(question, words)
        out = F.when(case, kind) if out is None else out.when(case, kind)
    return out.otherwise("bar")


def chart_type_of(question: str) -> str:
    from tallyglass.plans.router import folded

    q = folded(question)
    return next((kind for kind, words in CHART_WORDS if any(w in q for w in words)), "bar")


def encode(schema: T.StructType, kind: str) -> ChartSpec:
    """x is the first categorical column, else the first; y the first quantitative one, else the second. A scatter chart needs
    two quantitative columns and is a bar chart without."""
    kinds, names = classify(schema), [f.name for f in schema]
    numbers, labels = [n for n in names if kinds[n] == "Quantitative"], [n for n in names if kinds[n] == "Categorical"]
    x = labels[0] if labels else names[0] if names else None
    y = numbers[0] if numbers else names[1] if len(names) > 1 else None
    if x is None or y is None:
        return ChartSpec("none", options={"reason": "a chart needs a column of labels and one of values"})
    if kind == "scatter" and len(numbers) > 1:
        return ChartSpec("scatter", numbers[0], numbers[1], f"{numbers[1]} against {numbers[0]}")
    options = {"line": {"markers": True, "area": True}, "pie": {"label": "share"}}
    return ChartSpec(kind if kind in options else "bar", x, y, f"{y} by {x}", options.get(kind, {"value_labels": True}))


def gridded(df: DataFrame, max_points: int) -> DataFrame:
    """(x, y, n) of points: each distinct point and how often it stands there, or, if these are more than max_points, the middle
    of each cell of a grid of max_points cells at most with the number of its points. No point is left out of the counts."""
    points = df.groupBy("x", "y").agg(F.count("*").alias("n"))
    if points.limit(max_points + 1).count() <= max_points:
        return points
    side = max(1, math.isqrt(max_points))
    ends = points.filter("x is not null and y is not null").agg(*(f(c).cast("double").alias(f"{c}_{name}") for c in "xy" for name, f in (("low", F.min), ("high", F.max)))).first()
    if ends["x_low"] is None:
        return points.limit(0)

    def cell(c: str) -> Column:
        step = (ends[f"{c}_high"] - ends[f"{c}_low"]) / side or 1.0
        return (F.least(F.floor((F.col(c).cast("double") - ends[f"{c}_low"]) / step), F.lit(side - 1)) + 0.5) * step + ends[f"{c}_low"]

    return points.filter("x is not null and y is not null").groupBy(cell("x").alias("x"), cell("y").alias("y")).agg(F.sum("n").alias("n"))


def chart_data(df: DataFrame, spec: ChartSpec, order: list[Column] | None = None, max_points: int = MAX_POINTS) -> DataFrame:
    """The rows to draw: label and value; for a line also pos from 0, by order (the label by default); for a pie also share of
    the whole; for a scatter chart x, y and the number of points there (see gridded). A line or a pie that can be drawn has
    few rows: pos numbers them in one place."""
    if spec.kind == "none":
        return df.limit(0)
    x, y = F.col(f"`{spec.x}`"), F.col(f"`{spec.y}`")
    if spec.kind == "scatter":
        return gridded(df.select(x.alias("x"), y.alias("y")), max_points)
    label = x.cast("string").alias("label")
    if spec.kind == "line":
        return df.select(label, y.alias("value"), (F.row_number().over(W.orderBy(*(order or [x]))) - 1).alias("pos"))
    if spec.kind == "pie":
        whole = df.agg(F.sum(y).alias("whole"))
        return df.crossJoin(F.broadcast(whole)).select(label, y.alias("value"), F.try_divide(y, F.col("whole")).alias("share"))
    return df.select(label, y.alias("value"))
