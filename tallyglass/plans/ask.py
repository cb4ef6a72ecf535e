"""A question in, an answer out: its result as a lazy DataFrame, a chart specification, and the rows to draw."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.text import clean_code, extract_sql
from tallyglass.operators.charts import ChartSpec, chart_data, chart_type_of, encode
from tallyglass.operators.measures import Tables
from tallyglass.plans.execute import execute
from tallyglass.plans.prompts import chart_prompt, sql_prompt
from tallyglass.plans.providers import Provider, ask_in_turn, is_plot_code
from tallyglass.plans.router import intent, plan, route_of
from tallyglass.sources.tables import ddl


@dataclass
class Answer:
    question: str
    df: DataFrame | None
    source: str  # "rules" or a provider's name
    sql: str | None = None
    prompt: str | None = None
    chart: ChartSpec | None = None
    data: DataFrame | None = None
    code: str | None = None
    error: str | None = None
    trace: list[tuple[str, str]] = field(default_factory=list)

    def size(self) -> tuple[int, int]:
        """Rows and columns of the result."""
        return self.df.count(), len(self.df.columns)


@dataclass
class Translation:
    sql: str | None
    source: str | None
    prompt: str
    trace: list[tuple[str, str]]


def _apply(spark: SparkSession, text: str, function) -> str | None:
    """A column function on one string."""
    return spark.range(1).select(function(F.lit(text))).first()[0]


def translate(spark: SparkSession, tables: Tables, question: str, providers: list[Provider]) -> Translation:
    """SQL for a question, by the first provider with a usable answer. No rows of tables are in the prompt."""
    prompt = sql_prompt(question, ddl(tables))
    asked = ask_in_turn(providers, lambda p: prompt, lambda raw: _apply(spark, raw, extract_sql), 512, 0.0)
    return Translation(asked.text, asked.source, prompt, asked.trace)


def chart(spark: SparkSession, question: str, df: DataFrame, kind: str | None = None, providers: list[Provider] | None = None) -> tuple[ChartSpec, DataFrame, str | None, list[tuple[str, str]]]:
    """(specification, rows to draw, plotting code or None, trace) for any DataFrame. kind: an explicit wish, which beats what the
    question says. Code of providers is cleaned and checked, never run here; remote providers get no rows of df."""
    spec = encode(df.schema, kind or chart_type_of(question))
    asked = ask_in_turn(providers or [], lambda p: chart_prompt(question, df, with_rows=p.local), lambda raw: code if is_plot_code(code := _apply(spark, raw, clean_code) or "") else None, 800, 0.1)
    return spec, chart_data(df, spec), asked.text, [*asked.trace, ("template", "used")]


def ask(spark: SparkSession, tables: Tables, question: str, providers: list[Provider] | None = None, chart_kind: str | None = None, compat: bool = False, year: int = 1997) -> Answer:
    """Answers by providers in turn, by rules where none of them gives SQL that runs. compat: see router."""
    out = Answer(question, None, "rules")
    if providers:
        t = translate(spark, tables, question, providers)
        out.prompt, out.trace = t.prompt, t.trace
        if t.sql:
            for name, df in tables.items():
                df.createOrReplaceTempView(name)
            found = execute(spark, t.sql)
            out.sql = t.sql
            if found.df is not None:
                out.df, out.source = found.df, t.source
            else:
                out.error = found.error
                out.trace.append((t.source, f"SQL failed: {found.error}"[:500]))
    if out.df is None:
        out.df, out.source = plan(tables, intent(route_of(question, compat), year)), "rules"
    out.chart, out.data, out.code, more = chart(spark, question, out.df, chart_kind, providers)
    out.trace += more
    return out
