"""SQL texts, guarded and run."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallyglass.functions.dialect import alias_replaced, bare_replaced, to_spark

_QUIET = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
#: Rewrites that the analysis of one query may ask for, at most.
MAX_REWRITES = 20


def problem(sql: str) -> str | None:
    """Why sql may not be run: it must be one statement, and a query."""
    bare = _QUIET.sub(" ", sql).strip()
    if not bare:
        return "there is no statement"
    if ";" in bare.rstrip("; \n\t"):
        return "there is more than one statement"
    if not re.match(r"\(*\s*(select|with|values)\b", bare, re.IGNORECASE):
        return "only queries are run"
    if re.search(r"\b(insert\s+(into|overwrite)|reflect\s*\(|java_method\s*\(|transform\s*\([^)]*\)\s+using)", bare, re.IGNORECASE):
        return "the query would do more than read"
    return None


@dataclass
class Result:
    """df or error. df is lazy: errors of its rows come with the first action."""

    df: DataFrame | None
    error: str | None = None


def _rewritten(sql: str, e: AnalysisException) -> str | None:
    """sql as SQLite would take it, where Spark's analysis has stopped at something that SQLite allows."""
    told = e.getMessageParameters() or {}
    condition = e.getCondition() or ""
    if condition.startswith("UNRESOLVED_COLUMN"):
        return alias_replaced(sql, told.get("objectName", "").strip("`"))
    if condition == "MISSING_GROUP_BY":
        return bare_replaced(sql, None)
    if condition == "MISSING_AGGREGATION":
        return bare_replaced(sql, told.get("expression", "").strip('"').rpartition(".")[2].strip("`"))
    return None


def execute(spark: SparkSession, sql: str, sqlite_dialect: bool = False) -> Result:
    """sqlite_dialect: SQLite's wording is taken (see functions.dialect), what can't be divided or cast is null, not an error."""
    if why := problem(sql):
        return Result(None, why)
    sql = sql.strip().rstrip(";")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        if sqlite_dialect:
            sql = to_spark(sql)
            spark.conf.set("spark.sql.ansi.enabled", "false")
        for _ in range(MAX_REWRITES):
            try:
                df = spark.sql(sql)
                df.schema  # noqa: B018  analysis errors surface here
                return Result(df)
            except AnalysisException as e:
                if not sqlite_dialect or (other := _rewritten(sql, e)) is None:
                    raise
                sql = other
        return Result(None, "the query needs too many rewrites")
    except Exception as e:
        return Result(None, str(e))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def rows(spark: SparkSession, sql: str, max_rows: int, sqlite_dialect: bool = False, seconds: float | None = None) -> tuple[list | None, str | None]:
    """(rows, None) or (None, error cut to 200 characters), of a result of max_rows rows at most that takes `seconds` at most."""
    found = execute(spark, sql, sqlite_dialect)
    if found.df is None:
        return None, found.error[:200]
    tag = f"query-{uuid.uuid4().hex}"
    late = threading.Timer(seconds, spark.sparkContext.cancelJobsWithTag, [tag]) if seconds is not None else None
    spark.sparkContext.addJobTag(tag)
    try:
        if late:
            late.start()
        got = found.df.limit(max_rows + 1).collect()
    except Exception as e:
        return None, f"more than {seconds:g} seconds" if late and late.finished.is_set() else str(e)[:200]
    finally:
        spark.sparkContext.removeJobTag(tag)
        if late:
            late.cancel()
    return (got, None) if len(got) <= max_rows else (None, f"more than {max_rows} rows")
