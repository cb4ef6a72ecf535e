"""Reports on two methods' evaluations: merged rows, accuracy, agreement, cost. Each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ["easy", "medium", "hard", "extra"]


def merge(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """Rows of two evaluations (see plans.evaluate) by idx; an idx that only one has is left out."""
    own = lambda df, m: df.select("idx", F.col("pred_sql").alias(f"{m}_pred"), F.col("correct").alias(f"{m}_correct"))
    return a.select("idx", "db_id", "question", "gold_sql", "hardness").join(own(a, a_name), "idx").join(own(b, b_name), "idx")


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def accuracy(merged: DataFrame, a: Column, b: Column) -> DataFrame:
    """(total, a_correct, b_correct, a_percent, b_percent); percentages of nothing are null."""
    n = F.count("*")
    return merged.agg(n.alias("total"), F.count_if(a).alias("a_correct"), F.count_if(b).alias("b_correct"), _percent(F.count_if(a), n).alias("a_percent"), _percent(F.count_if(b), n).alias("b_percent"))


def accuracy_by(merged: DataFrame, group: Column, a: Column, b: Column) -> DataFrame:
    """(group, n, a_percent, b_percent) of each group that has rows."""
    n = F.count("*")
    return merged.groupBy(group.alias("group")).agg(n.alias("n"), _percent(F.count_if(a), n).alias("a_percent"), _percent(F.count_if(b), n).alias("b_percent"))


def accuracy_by_hardness(merged: DataFrame, a: Column, b: Column) -> DataFrame:
    """The same by hardness, from easy to extra."""
    return accuracy_by(merged, F.col("hardness"), a, b).orderBy(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("group")))


def agreement(merged: DataFrame, a: Column, b: Column) -> DataFrame:
    """(outcome, n, percent): both right, one of them, neither."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    cases = {"both": a & b, "only_a": a & ~b, "only_b": ~a & b, "neither": ~a & ~b}
    counted = merged.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in cases.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("outcome"), F.col(k).alias("n")) for k in cases))
    return counted.select("total", F.explode(rows).alias("r")).select("r.outcome", "r.n", _percent(F.col("r.n"), F.col("total")).alias("percent"))


def cost(details: DataFrame) -> DataFrame:
    """(avg_latency, avg_tokens) of run details."""
    return details.agg(F.avg("latency").alias("avg_latency"), F.avg("tokens").alias("avg_tokens"))
