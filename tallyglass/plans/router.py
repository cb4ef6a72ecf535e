"""Which analysis a question asks for, by the words in it."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.measures import Tables, by_dimension

#: Words of each analysis, in the order in which they are looked for.
ROUTES = [
    ("month", ["month", "tháng"]),
    ("region", ["region", "vùng", "khu vực"]),
    ("category", ["category", "danh mục", "product"]),
    ("customer", ["customer", "khách hàng"]),
    ("top", ["top", "best"]),
]
#: Decomposed letters of the words above, and their composed forms: questions come in either.
COMPOSED = {unicodedata.normalize("NFD", c): c for _, words in ROUTES for w in words for c in w if unicodedata.normalize("NFD", c) != c} | {unicodedata.normalize("NFD", c): c for c in "ỷệ"}


def folded(question: str) -> str:
    return unicodedata.normalize("NFC", question).lower()


def has_any(question: Column, words: list[str]) -> Column:
    """Is any of the words in the question? Case does not matter, nor whether accents are composed."""
    q = F.lower(question)
    for apart, whole in sorted(COMPOSED.items(), key=lambda x: -len(x[0])):
        q = F.replace(q, F.lit(apart), F.lit(whole))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(q, F.lit(w))
    return F.coalesce(out, F.lit(False))


def _order(compat: bool) -> list[tuple[str, list[str]]]:
    """compat: as listed, so "top ... products" asks for categories. Else top is looked for before category, and products
    alone still ask for categories."""
    return ROUTES if compat else [*ROUTES[:2], ROUTES[4], *ROUTES[2:4]]


def route_of(question: str, compat: bool = False) -> str:
    q = folded(question)
    return next((name for name, words in _order(compat) if any(w in q for w in words)), "default")


def route(question: Column, compat: bool = False) -> Column:
    """The same for a column of questions."""
    out = None
    for name, words in _order(compat):
        case = has_any(question, words)
        out = F.when(case, name) if out is None else out.when(case, name)
    return out.otherwise("default")


@dataclass(frozen=True)
class Intent:
    """What to compute: a measure by a dimension, ordered, perhaps the first few only; or sample rows of orders."""

    measure: str | None
    dimension: str | None
    descending: bool = True
    limit: int | None = None
    year: int | None = None


def intent(name: str, year: int = 1997) -> Intent:
    return {
        "month": Intent("order_revenue", "month", descending=False, year=year),
        "region": Intent("order_revenue", "region"),
        "category": Intent("line_revenue", "category"),
        "customer": Intent("order_revenue", "customer"),
        "top": Intent("quantity", "product", limit=5),
        "default": Intent(None, None, limit=10),
    }[name]


def plan(tables: Tables, what: Intent) -> DataFrame:
    """The intent as a lazy result. Ties in a top list are broken by label."""
    if what.measure is None:
        return tables["orders"].orderBy("o_orderkey").limit(what.limit or 10)
    name = "monthly_revenue" if what.dimension == "month" else None
    df = by_dimension(tables, what.measure, what.dimension, what.year, name)
    label, value = df.columns
    df = df.orderBy(F.col(value).desc(), F.col(label)) if what.descending else df.orderBy(label)
    return df.limit(what.limit) if what.limit else df
