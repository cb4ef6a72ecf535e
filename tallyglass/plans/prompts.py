"""Prompts for language models: tables and examples for SQL, columns and a request for charts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyglass.operators.charts import classify


@dataclass(frozen=True)
class Example:
    question: str
    sql: str


EXAMPLES = [
    Example("How many customers do we have?", "SELECT COUNT(*) AS n FROM customer"),
    Example("How much did all orders bring in?", "SELECT SUM(o_totalprice) AS total_revenue FROM orders"),
    Example("Which product categories exist?", "SELECT DISTINCT p_type AS category FROM part"),
    Example(
        "Which regions bring in the most?",
        "SELECT r_name AS region_name, SUM(o_totalprice) AS total_revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY total_revenue DESC",
    ),
    Example("Revenue of each month of 1997", "SELECT date_format(o_orderdate, 'MM') AS month, SUM(o_totalprice) AS monthly_revenue FROM orders WHERE year(o_orderdate) = 1997 GROUP BY month ORDER BY month"),
    Example("The five products that sold most", "SELECT p_name AS product_name, SUM(l_quantity) AS total_qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY total_qty DESC, p_name LIMIT 5"),
]


def sql_prompt(question: str, ddl: str, examples: list[Example] | None = None) -> str:
    """Examples, then the tables, then the question; the answer goes on after SELECT."""
    shown = "\n\n".join(f"-- {e.question}\n{e.sql}" for e in (EXAMPLES if examples is None else examples))
    return f"-- Questions and the Spark SQL that answers them:\n\n{shown}\n\n-- The tables:\n\n{ddl}\n\n-- {question}\nSELECT"


def chart_prompt(question: str, df: DataFrame, rows: int = 3, with_rows: bool = True) -> str:
    """Columns with their kinds, a few rows if these may be shown, the request, and what the answer must be."""
    kinds = classify(df.schema)
    columns = "\n".join(f"- {f.name}: {kinds[f.name]}, {f.dataType.simpleString()}" for f in df.schema)
    sample = "\n".join(" | ".join(map(str, r)) for r in df.limit(rows).collect()) if with_rows else ""
    shown = f"\n\nIts first rows:\n{sample}" if sample else ""
    return (
        f"A pandas DataFrame `df` has these columns:\n{columns}{shown}\n\nDraw this: {question}\n\n"
        "Answer with Python code alone, for matplotlib (as plt) or seaborn (as sns): a figure of 10 by 6 inches with a title and axis labels, a tight layout, no plt.show(), names with spaces or hyphens in brackets."
    )
