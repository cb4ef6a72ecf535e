import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.operators.charts import chart_data, chart_type, chart_type_of, classify, encode
from tallyglass.operators.measures import by_dimension
from tallyglass.plans.ask import ask, chart
from tallyglass.plans.execute import execute, problem, rows
from tallyglass.plans.prompts import chart_prompt, sql_prompt
from tallyglass.plans.providers import HttpProvider, ask_in_turn, complete_all, is_plot_code
from tallyglass.plans.router import route, route_of
from tallyglass.sources.tables import KeyRegistry, ddl, load, sample_rows, schema_dict
from tallyglass.streaming.questions import demand, routed

SF = "/root/testdata/sf0.001"

#: question, route as the words stand, route by default, chart
QUESTIONS = [
    ("Show monthly revenue in 1997", "month", "month", "line"),
    ("Revenue by product category", "category", "category", "bar"),
    ("Revenue by region", "region", "region", "bar"),
    ("Top 5 best-selling products", "category", "top", "bar"),
    ("Revenue by customer", "customer", "customer", "bar"),
    ("Top 5 sản phẩm bán chạy nhất tháng 12?", "month", "month", "line"),
    ("Doanh thu theo từng khu vực trong Q3?", "region", "region", "bar"),
    ("So sánh số lượng đơn hàng giữa các năm", "default", "default", "bar"),
    ("best sellers, pie", "top", "top", "pie"),
    ("scatter of quantity", "default", "default", "scatter"),
    ("stop list", "top", "top", "bar"),
    (unicodedata.normalize("NFD", "Top 5 sản phẩm bán chạy nhất tháng 12?"), "month", "month", "line"),
    (unicodedata.normalize("NFD", "tỷ lệ theo danh mục"), "category", "category", "pie"),
]


def test_routes(spark):
    df = spark.createDataFrame([(q,) for q, *_ in QUESTIONS], "q string")
    got = df.select(route(F.col("q"), compat=True), route(F.col("q")), chart_type(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [q[1:] for q in QUESTIONS]
    assert [(route_of(q, True), route_of(q), chart_type_of(q)) for q, *_ in QUESTIONS] == [q[1:] for q in QUESTIONS]


def fields(*kinds):
    return T.StructType([T.StructField(f"c{k}", {"t": T.StringType(), "n": T.LongType(), "b": T.BooleanType()}[c]) for k, c in enumerate(kinds)])


@pytest.mark.parametrize(
    "kinds, kind, want",
    [("tn", "bar", ("bar", "c0", "c1")), ("nn", "bar", ("bar", "c0", "c0")), ("nn", "scatter", ("scatter", "c0", "c1")), ("n", "line", ("line", "c0", "c0")), ("t", "bar", ("none", None, None)), ("tt", "pie", ("pie", "c0", "c1")), ("tn", "scatter", ("bar", "c0", "c1")), ("", "bar", ("none", None, None)), ("nb", "bar", ("bar", "c1", "c0"))],
)
def test_encode(kinds, kind, want):
    spec = encode(fields(*kinds), kind)
    assert (spec.kind, spec.x, spec.y) == want
    assert set(classify(fields(*kinds)).values()) <= {"Quantitative", "Categorical"}


def test_chart_data(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 3.0), (None, None)], "x string, `y'z` double")
    assert [tuple(r) for r in chart_data(df, encode(df.schema, "line")).orderBy("pos").collect()] == [(None, None, 0), ("a", 3.0, 1), ("b", 1.0, 2)]
    assert {tuple(r) for r in chart_data(df, encode(df.schema, "pie")).collect()} == {("b", 1.0, 0.25), ("a", 3.0, 0.75), (None, None, None)}
    assert chart_data(df.select("x"), encode(df.select("x").schema, "bar")).count() == 0


class Fake:
    def __init__(self, name, answer, local=True, up=True):
        self.name, self.answer, self.local, self.up, self.prompts = name, answer, local, up, []

    def available(self):
        return self.up

    def complete(self, prompt, max_tokens, temperature):
        self.prompts.append(prompt)
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


def test_ask(spark):
    tables = load(spark, SF)
    a = ask(spark, tables, "Revenue by region", chart_kind="pie")
    assert a.source == "rules" and a.size() == (5, 2) and a.chart.kind == "pie" and abs(sum(r["share"] for r in a.data.collect()) - 1) < 1e-9
    down, broken, wordy = Fake("down", "", up=False), Fake("broken", RuntimeError("boom")), Fake("remote", "```sql\nSELECT r_name, r_regionkey FROM region\n```", local=False)
    a = ask(spark, tables, "Regions?", [down, broken, wordy])
    assert a.source == "remote" and a.size() == (5, 2) and a.code is None and ("down", "not available") in a.trace and ("broken", "failed: boom") in a.trace
    assert "CREATE TABLE region" in a.prompt and "AFRICA" not in "".join(wordy.prompts)
    bad = ask(spark, tables, "Revenue by customer", [Fake("x", "SELECT nope FROM nowhere")])
    assert bad.source == "rules" and bad.error and bad.df.count() == 150
    assert ask(spark, tables, "anything", [Fake("x", "DROP TABLE region")]).source == "rules"
    assert ask(spark, tables, "Top 5 best-selling products", compat=True).df.columns == ["category", "total_revenue"]


def test_chart_code(spark):
    df = spark.createDataFrame([("secret", 1)], "k string, v int")
    local, remote = Fake("local", "nonsense"), Fake("remote", "```python\nplt.figure(figsize=(10, 6))\nplt.bar(df['k'], df['v'])\n```", local=False)
    spec, data, code, trace = chart(spark, "bars", df, providers=[local, remote])
    assert code.startswith("plt.figure") and spec.kind == "bar" and data.count() == 1 and trace[-1] == ("template", "used")
    assert "secret" in local.prompts[0] and "secret" not in remote.prompts[0]
    assert not is_plot_code("plt.bar(") and not is_plot_code("x = 1\n" * 9) and is_plot_code("plt.bar([1, 2], [3, 4])")


def test_providers():
    gone = HttpProvider("gone", "http://127.0.0.1:9/x", lambda p, n, t: {"prompt": p}, health_url="http://127.0.0.1:9/", timeout=1)
    assert not gone.available()
    with pytest.raises(RuntimeError):
        gone.complete("hello")
    assert ask_in_turn([gone], lambda p: "", lambda x: x).text is None


@pytest.mark.parametrize("sql, ok", [("SELECT 1", True), ("  with q as (select 1) select * from q ;", True), ("(SELECT 1) UNION (SELECT 2)", True), ("SELECT ';' AS x -- ; drop", True), ("SELECT 1; SELECT 2", False), ("DROP TABLE t", False), ("", False), ("-- nothing", False), ("WITH q AS (SELECT 1) INSERT INTO t SELECT * FROM q", False), ("SELECT reflect('a', 'b')", False)])
def test_guard(sql, ok):
    assert (problem(sql) is None) is ok


def test_execute(spark):
    load(spark, SF, ["region"])
    assert rows(spark, "SELECT count(*) FROM region", 10)[0][0][0] == 5
    assert rows(spark, "SELECT * FROM region", 3) == (None, "more than 3 rows")
    assert execute(spark, "SELECT nope FROM region").error and len(rows(spark, "SELECT * FROM nowhere", 1)[1]) <= 200
    assert "zero" in rows(spark, "SELECT 1 / (r_regionkey - r_regionkey) FROM region", 9)[1].lower()


def test_time_limit(spark):
    got, why = rows(spark, "SELECT count(*) FROM range(1000000000000) WHERE sqrt(id) = 1.5", 1, seconds=1)
    assert got is None and why == "more than 1 seconds"
    assert rows(spark, "SELECT 1", 1, seconds=60)[0] is not None


def test_sqlite_wording(spark):
    load(spark, SF, ["customer"])
    run = lambda sql: execute(spark, sql, sqlite_dialect=True)
    assert [r[0] for r in run("SELECT 'twice' AS x, c_custkey * 2 AS twice FROM customer WHERE twice BETWEEN 1 AND 5 AND x = 'twice'").df.select("twice").collect()] == [2, 4]
    assert run("SELECT c_name, MIN(c.c_custkey) AS k FROM customer c").df.first() == ("Customer#000000000", 0)
    assert run("SELECT lower(c.c_name) AS n, c_nationkey, COUNT(*) FROM customer c GROUP BY c_nationkey").df.count() == 25
    assert run("SELECT 1 / 0 AS a, CAST('x' AS INT) AS b").df.first() == (None, None)
    assert run("SELECT nothing FROM customer").error and run("SELECT strftime(c_name, 1) FROM customer").error and run("SELECT date((1 FROM customer").error
    assert "zero" in rows(spark, "SELECT 1 / 0", 1)[1].lower()


class Shouting:
    name, local = "shouting", True

    def available(self):
        return True

    def complete(self, prompt, max_tokens, temperature):
        return prompt.upper() + f" {max_tokens}" if prompt != "bad" else 1 / 0


def test_complete_all(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "bad"), (3, None)], "id int, prompt string")
    assert [tuple(r) for r in complete_all(df, Shouting, 7).orderBy("id").collect()] == [(1, "hello", "HELLO 7", None), (2, "bad", None, "division by zero"), (3, None, None, None)]


def test_gridded_points_count_all(spark):
    df = spark.range(1_000).selectExpr("id AS a", "id % 10 AS b")
    got = chart_data(df, encode(df.schema, "scatter"), max_points=25).collect()
    assert len(got) <= 25 and sum(r["n"] for r in got) == 1_000
    same = chart_data(df, encode(df.schema, "scatter")).collect()
    assert len(same) == 1_000 and {r["n"] for r in same} == {1}
    assert chart_data(df.selectExpr("CAST(NULL AS INT) AS a", "b"), encode(df.schema, "scatter"), max_points=1).count() == 0


def test_schema(spark):
    tables = load(spark, SF, ["region", "nation"])
    keys = KeyRegistry({"nation": ["n_nationkey"]}, {"nation": [(["n_regionkey"], "region", None)]})
    assert ddl(tables, keys).split("\n\n")[0] == "CREATE TABLE nation (n_nationkey INT, n_name STRING, n_regionkey INT, PRIMARY KEY (n_nationkey), FOREIGN KEY (n_regionkey) REFERENCES region);"
    assert schema_dict(spark)["region"] == ["r_regionkey", "r_name"] and sample_rows(spark, "region", 2).count() == 2
    assert sql_prompt("Why?", "DDL").endswith("DDL\n\n-- Why?\nSELECT") and "r_name" in chart_prompt("x", tables["region"], with_rows=False)
    with pytest.raises(ValueError):
        by_dimension(tables, "order_revenue", "category")


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(q, f"2024-01-01 0{k % 3}:00:00") for k, (q, *_) in enumerate(QUESTIONS)], "text string, ts string").select("text", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = routed(stream).writeStream.format("memory").queryName("routed_questions").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("routed_questions").select("text", "route", "chart").collect())) == sorted((q[0], *q[2:]) for q in QUESTIONS)
    query = demand(stream).writeStream.format("memory").queryName("demand_of_questions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("demand_of_questions").collect()) == len(QUESTIONS)
