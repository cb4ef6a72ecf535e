"""Measures by dimensions over the star schema.

A measure is a sum at the grain of one fact table. Where the dimension's tables are small enough for Spark to broadcast them,
facts go through the joins as they are scanned and are summed once, by label: only partial sums are shuffled. Where the
first table on the way is larger, facts are summed by their foreign key first, so that the shuffled joins carry one row for
each key, not one for each fact. Money is summed as decimals, so the order of additions does not matter, and is cast to
double at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Measure:
    fact: str
    value: Column | None  # None: a count of rows
    name: str


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def measure(name: str) -> Measure:
    """order_revenue (order totals), line_revenue (discounted line prices), quantity (of lines) or orders (a count)."""
    return {
        "order_revenue": lambda: Measure("orders", _money("o_totalprice"), "total_revenue"),
        "line_revenue": lambda: Measure("lineitem", F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), "total_revenue"),
        "quantity": lambda: Measure("lineitem", F.col("l_quantity").cast("decimal(18,2)"), "total_qty"),
        "orders": lambda: Measure("orders", None, "n_orders"),
    }[name]()


@dataclass(frozen=True)
class Dimension:
    name: str
    keys: dict[str, str]  # fact -> its foreign key (or the column of a date)
    path: tuple[tuple[str, str, str], ...]  # (table, its key, the column that leads to it)
    label: str


DIMENSIONS = {
    "region": Dimension("region_name", {"orders": "o_custkey"}, (("customer", "c_custkey", "o_custkey"), ("nation", "n_nationkey", "c_nationkey"), ("region", "r_regionkey", "n_regionkey")), "r_name"),
    "nation": Dimension("nation_name", {"orders": "o_custkey"}, (("customer", "c_custkey", "o_custkey"), ("nation", "n_nationkey", "c_nationkey")), "n_name"),
    "customer": Dimension("customer_name", {"orders": "o_custkey"}, (("customer", "c_custkey", "o_custkey"),), "c_name"),
    "category": Dimension("category", {"lineitem": "l_partkey"}, (("part", "p_partkey", "l_partkey"),), "p_type"),
    "product": Dimension("product_name", {"lineitem": "l_partkey"}, (("part", "p_partkey", "l_partkey"),), "p_name"),
    "month": Dimension("month", {"orders": "o_orderdate", "lineitem": "l_shipdate"}, (), ""),
}
DATES = {"orders": "o_orderdate", "lineitem": "l_shipdate"}


def total(tables: Tables, of: str) -> DataFrame:
    """The measure over all facts: null for a sum over none."""
    m = measure(of)
    return tables[m.fact].agg(_sum(m).alias(m.name))


def _sum(m: Measure) -> Column:
    return F.count("*") if m.value is None else F.sum(m.value).cast("double")


def broadcastable(df: DataFrame) -> bool:
    """Does Spark expect df to be within the size up to which it broadcasts?"""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def by_dimension(tables: Tables, of: str, dimension: str, year: int | None = None, newest_name: str | None = None) -> DataFrame:
    """(label, measure) for each label of the dimension, of one year's facts if a year is given."""
    m, d = measure(of), DIMENSIONS[dimension]
    if m.fact not in d.keys:
        raise ValueError(f"{of} has no {dimension}")
    name = newest_name or m.name
    facts, key = tables[m.fact], d.keys[m.fact]
    if year is not None:
        first = lambda y: F.make_date(F.lit(y), F.lit(1), F.lit(1)).cast("timestamp")
        facts = facts.filter((F.col(DATES[m.fact]) >= first(year)) & (F.col(DATES[m.fact]) < first(year + 1)))
    if not d.path:
        return facts.groupBy(F.date_format(key, "MM").alias(d.name)).agg(_sum(m).alias(name))
    sums = not broadcastable(tables[d.path[0][0]].select(d.path[0][1], *([d.path[1][2]] if len(d.path) > 1 else [d.label])))
    value = F.lit(1) if m.value is None else m.value
    part = facts.groupBy(key).agg(F.sum(value).alias("part")) if sums else facts.select(key, value.alias("part"))
    for table, own, via in d.path:
        part = part.join(tables[table], F.col(via) == F.col(own))
    whole = F.sum("part")
    return part.groupBy(F.col(d.label).alias(d.name)).agg((whole if m.value is None else whole.cast("double")).alias(name))
