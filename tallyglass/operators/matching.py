"""Does a predicted result match the gold one?

Names are ignored; positions count. Rows are compared as multisets by one aggregation over both sides, or, where order
counts, also position by position. Nulls equal nulls, and 1 equals 1.0; text never equals a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords that make a query harder.
HARD = ["join", "group by", "having", "order by", "union", "intersect", "except"]


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    return "any" if isinstance(kind, T.NullType) else "text" if isinstance(kind, T.StringType) else kind.simpleString()


def comparable(a: DataFrame, b: DataFrame) -> bool:
    """As many columns, of the same families."""
    kinds = [(_family(x.dataType), _family(y.dataType)) for x, y in zip(a.schema, b.schema, strict=False)]
    return len(a.columns) == len(b.columns) and all(x == y or "any" in (x, y) for x, y in kinds)


def _positional(df: DataFrame) -> DataFrame:
    """Columns named by place, numbers as doubles or (where all are whole) as they are, so both sides group alike."""
    whole = lambda k: isinstance(k, (T.IntegralType, T.BooleanType))
    cast = lambda f: F.col(f"`{f.name}`").cast("long") if whole(f.dataType) else F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.NumericType) else F.col(f"`{f.name}`")
    renamed = df.toDF(*(f"_{k}" for k in range(len(df.columns))))
    return renamed.select(*(cast(f).alias(f.name) for f in renamed.schema))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number differs, with n_left - n_right as surplus."""
    both = _positional(a).withColumn("surplus", F.lit(1)).union(_positional(b).withColumn("surplus", F.lit(-1)))
    return both.groupBy(*both.columns[:-1]).agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return comparable(a, b) and multiset_difference(a, b).isEmpty()


def numbered(df: DataFrame) -> DataFrame:
    """df (already stored, in order) with pos: the place of each row. Partitions are counted first, so none has to hold all rows."""
    at = F.monotonically_increasing_id()
    part = F.shiftright(at, 33)
    counts = dict(df.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    return df.withColumn("pos", F.element_at(F.lit(before or [0]), part.cast("int") + 1) + at.bitwiseAND(F.lit((1 << 33) - 1)))


def same_sequence(a: DataFrame, b: DataFrame) -> bool:
    """The same rows in the same order: first as multisets, then place by place, as multisets of rows with their places."""
    if not same_rows(a, b):
        return False
    stored = [_positional(x).persist() for x in (a, b)]
    try:
        return multiset_difference(*(numbered(x) for x in stored)).isEmpty()
    finally:
        for x in stored:
            x.unpersist()


def order_sensitive(sql: str) -> bool:
    return "order by" in sql.lower()


def matches(predicted: DataFrame, gold: DataFrame, ordered: bool) -> bool:
    return same_sequence(predicted, gold) if ordered else same_rows(predicted, gold)


def order_sensitive_column(sql: Column) -> Column:
    return F.contains(F.lower(sql), F.lit("order by"))


def hardness(sql: Column) -> Column:
    """easy, medium, hard or extra, by the number of HARD keywords in the text and whether SELECT stands in it twice."""
    from tallyglass.functions.text import occurrences

    low = F.lower(sql)
    n = sum(F.contains(low, F.lit(k)).cast("int") for k in HARD)
    flat = occurrences(low, "select") <= 1
    return F.when((n == 0) & flat, "easy").when((n <= 1) & flat, "medium").when(n <= 2, "hard").otherwise("extra")
