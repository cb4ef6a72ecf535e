"""Execution accuracy of predicted SQL.

Each pair of queries is two plans; the driver submits them, Spark runs them. The gold results that were asked for last are
cached, so that several methods' predictions meet them ready; how many is bounded. Rows of an evaluation: idx, db_id, question, gold_sql, pred_sql, correct,
error, hardness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.operators.matching import hardness, matches, order_sensitive
from tallyglass.plans.execute import Result, execute

SCHEMA = "idx int, db_id string, question string, gold_sql string, pred_sql string, correct boolean, error string"


class Evaluator:
    """open_database: makes the tables of a db_id the current views and returns True, or returns False if there is no such database."""

    def __init__(self, spark: SparkSession, open_database: Callable[[str], bool], sqlite_dialect: bool = True, max_cached: int = 64):
        self.spark, self.open_database, self.sqlite_dialect, self.max_cached = spark, open_database, sqlite_dialect, max_cached
        self.gold: dict[tuple[str, str], Result] = {}

    def _gold(self, db_id: str, sql: str) -> Result:
        """The gold query's result, cached; the one that was asked for longest ago goes when there are too many."""
        found = self.gold.pop((db_id, sql), None)
        if found is None:
            found = execute(self.spark, sql, self.sqlite_dialect)
            found = Result(found.df.persist() if found.df is not None else None, found.error)
        self.gold[db_id, sql] = found
        while len(self.gold) > self.max_cached:
            oldest = self.gold.pop(next(iter(self.gold)))
            if oldest.df is not None:
                oldest.df.unpersist()
        return found

    def correct(self, db_id: str, predicted: str, gold: str) -> tuple[bool, str | None]:
        """(whether the results match, why not if a query failed)"""
        if not self.open_database(db_id):
            return False, f"no database {db_id}"
        want, got = self._gold(db_id, gold), execute(self.spark, predicted, self.sqlite_dialect)
        if want.df is None or got.df is None:
            return False, want.error and f"gold: {want.error}" or got.error
        try:
            return matches(got.df, want.df, order_sensitive(gold)), None
        except Exception as e:  # of rows, at run time
            return False, str(e)

    def evaluate(self, predictions: DataFrame, gold: DataFrame, questions: DataFrame | None = None) -> DataFrame:
        """predictions: idx, pred_sql; gold: idx, gold_sql, db_id, as many; questions: idx, question, or fewer ('' where there is none)."""
        pairs = gold.join(predictions, "idx", "full")
        if questions is not None:
            pairs = pairs.join(questions.select("idx", "question"), "idx", "left")
        asked = pairs.select("idx", "db_id", F.coalesce("question", F.lit("")).alias("question") if questions is not None else F.lit("").alias("question"), "gold_sql", "pred_sql").orderBy("idx").collect()
        if any(r["gold_sql"] is None or r["pred_sql"] is None for r in asked):
            raise ValueError("there are not as many predictions as gold queries")
        rows = []
        for r in asked:
            ok, error = self.correct(r["db_id"], r["pred_sql"], r["gold_sql"])
            rows.append((*r, ok, error[:100] if error else None))
        return self.spark.createDataFrame(rows, SCHEMA).withColumn("hardness", hardness(F.col("gold_sql")))

    def close(self) -> None:
        for r in self.gold.values():
            if r.df is not None:
                r.df.unpersist()
        self.gold.clear()


def sqlite_databases(spark: SparkSession, folder: str) -> Callable[[str], bool]:
    """open_database for folder/<db_id>/<db_id>.sqlite."""
    import os

    from tallyglass.sources.sqlite import register_database

    registered: list[str] = []

    def open_database(db_id: str) -> bool:
        path = os.path.join(folder, db_id, f"{db_id}.sqlite")
        if not os.path.exists(path):
            return False
        for name in registered:
            spark.catalog.dropTempView(name)
        registered[:] = register_database(spark, path)
        return True

    return open_database


def clean_outputs(raw: DataFrame) -> DataFrame:
    """(idx, sql, query_shaped) of raw answers (idx, raw)."""
    from tallyglass.functions.text import extract_batch_sql, is_query_shaped

    return raw.select("idx", extract_batch_sql(F.col("raw")).alias("sql")).withColumn("query_shaped", is_query_shaped(F.col("sql")))
