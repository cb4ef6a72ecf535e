"""Questions and evaluation results that arrive as a stream: the batch column functions, applied to streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.charts import chart_type
from tallyglass.plans.router import route


def routed(questions: DataFrame, text_col: str = "text", compat: bool = False) -> DataFrame:
    """A stream (or batch) of questions with the analysis and chart that each asks for. No state."""
    return questions.withColumn("route", route(F.col(text_col), compat)).withColumn("chart", chart_type(F.col(text_col)))


def demand(questions: DataFrame, time_col: str = "ts", text_col: str = "text", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Questions of each analysis by window of time; windows close once `late` has passed, so state stays bounded."""
    return routed(questions, text_col).withWatermark(time_col, late).groupBy(F.window(time_col, width), "route").agg(F.count("*").alias("n"))
