"""Catalogue of queries, each over its whole tables, and the SQL that each must equal."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.text import extract_batch_sql, extract_sql, response_text, without_ansi
from tallyglass.operators import reports
from tallyglass.operators.charts import ChartSpec, chart_data, chart_type
from tallyglass.operators.matching import HARD, hardness, multiset_difference
from tallyglass.operators.measures import by_dimension, total
from tallyglass.plans.ask import ask
from tallyglass.plans.evaluate import Evaluator
from tallyglass.plans.execute import execute
from tallyglass.plans.router import intent, plan, route
from tallyglass.sources.tables import STAR as STAR_KEYS
from tallyglass.sources.tables import TABLES, ddl, schema_rows
from tallyglass.streaming.questions import routed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Fixed values (where they are the surveyed product's sample questions): questions in both languages; each analysis and each chart is asked for.
QUESTIONS = [
    "Show monthly revenue in 1997",
    "Revenue by product category",
    "Revenue by region",
    "Top 5 best-selling products",
    "Revenue by customer",
    "Top 5 sản phẩm bán chạy nhất tháng 12?",
    "Doanh thu theo từng khu vực trong Q3?",
    "So sánh số lượng đơn hàng giữa các năm",
    "best sellers, pie",
    "scatter of quantity",
    "stop list",
    "tỷ lệ doanh thu theo danh mục",
]
#: Queries of each difficulty.
GRADED = [
    "SELECT a FROM t",
    "SELECT a FROM t WHERE b > 1",
    "SELECT a, COUNT(*) FROM t GROUP BY a",
    "SELECT a FROM t JOIN u ON t.k = u.k ORDER BY a",
    "SELECT a FROM t WHERE k IN (SELECT k FROM u)",
    "SELECT a FROM t WHERE k IN (SELECT k FROM u) ORDER BY a",
    "SELECT a FROM t JOIN u ON t.k = u.k GROUP BY a HAVING COUNT(*) > 1",
    "SELECT a FROM t UNION SELECT a FROM u EXCEPT SELECT a FROM v",
]
def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def outside(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """rows whose key is NOT IN the others' keys, as SQL means it: none if a key of the others is null."""
    return rows.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE `{key}` NOT IN (SELECT `{other_key}` FROM {{others}})", rows=rows, others=others)


MONEY = "CAST(o_totalprice AS DECIMAL(18,2))"
LINE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
STAR = ("region", "nation", "customer", "part", "orders", "lineitem")


@query("SELECT COUNT(*) AS n_customers FROM customer")
def count_customers(spark, folder):
    return _t(spark, folder, "customer")["customer"].agg(F.count("*").alias("n_customers"))


@query(f"SELECT CAST(SUM({MONEY}) AS DOUBLE) AS total_revenue FROM orders")
def total_revenue(spark, folder):
    return total(_t(spark, folder, *STAR), "order_revenue")


@query("SELECT DISTINCT p_type AS category FROM part")
def list_categories(spark, folder):
    return _t(spark, folder, "part")["part"].select(F.col("p_type").alias("category")).distinct()


BY_REGION = f"""SELECT r_name AS region_name, CAST(SUM({MONEY}) AS DOUBLE) AS total_revenue FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
BY_MONTH = f"SELECT strftime(o_orderdate, '%m') AS month, CAST(SUM({MONEY}) AS DOUBLE) AS monthly_revenue FROM orders WHERE year(o_orderdate) = 1997 GROUP BY month"
BY_CATEGORY = f"SELECT p_type AS category, CAST(SUM({LINE}) AS DOUBLE) AS total_revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type"
BY_CUSTOMER = f"SELECT c_name AS customer_name, CAST(SUM({MONEY}) AS DOUBLE) AS total_revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name"
TOP = """SELECT p_name AS product_name, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_qty FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY p_name ORDER BY total_qty DESC, product_name LIMIT 5"""


@query(f"{BY_REGION} ORDER BY total_revenue DESC")
def revenue_by_region(spark, folder):
    return plan(_t(spark, folder, *STAR), intent("region"))


@query(f"{BY_MONTH} ORDER BY month")
def monthly_revenue(spark, folder):
    return plan(_t(spark, folder, *STAR), intent("month"))


@query(f"{BY_CATEGORY} ORDER BY total_revenue DESC")
def revenue_by_category(spark, folder):
    return plan(_t(spark, folder, *STAR), intent("category"))


@query(f"{BY_CUSTOMER} ORDER BY total_revenue DESC")
def revenue_by_customer(spark, folder):
    return plan(_t(spark, folder, *STAR), intent("customer"))


@query(TOP)
def top5_products(spark, folder):
    return plan(_t(spark, folder, *STAR), intent("top"))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def sample_orders(spark, folder):
    return plan(_t(spark, folder, *STAR), intent("default"))


@query("""SELECT n_name AS nation_name, COUNT(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def orders_by_nation(spark, folder):
    return by_dimension(_t(spark, folder, *STAR), "orders", "nation")


@query("SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
def having_frequent_customers(spark, folder):
    return _t(spark, folder, "orders")["orders"].groupBy("o_custkey").agg(F.count("*").alias("n_orders")).filter("n_orders > 12")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def not_in_big_spenders(spark, folder):
    return outside(_t(spark, folder, "customer")["customer"], "c_custkey", _t(spark, folder, "orders")["orders"].filter("o_totalprice > 400000"), "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_customers(spark, folder):
    t = _t(spark, folder, "customer", "orders")
    return t["customer"].select("c_custkey", "c_name").join(t["orders"].filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


ABOVE = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders o WHERE CAST(o_totalprice AS DECIMAL(18,2)) >
    (SELECT SUM(CAST(i.o_totalprice AS DECIMAL(18,2))) FROM orders i WHERE i.o_custkey = o.o_custkey) / (SELECT COUNT(*) FROM orders i WHERE i.o_custkey = o.o_custkey)"""


@query(ABOVE)
def above_own_average(spark, folder):
    orders = _t(spark, folder, "orders")["orders"]
    own = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"))
    return orders.join(own, "o_custkey").filter(F.col("o_totalprice").cast("decimal(18,2)") * F.col("n") > F.col("s")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey AS nationkey FROM supplier")
def union_keys(spark, folder):
    t = _t(spark, folder, "customer", "supplier")
    return t["customer"].select(F.col("c_nationkey").alias("nationkey")).union(t["supplier"].select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey AS nationkey FROM supplier")
def union_all_keys(spark, folder):
    t = _t(spark, folder, "customer", "supplier")
    return t["customer"].select(F.col("c_nationkey").alias("nationkey")).union(t["supplier"].select("s_nationkey"))


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey AS nationkey FROM supplier")
def intersect_nations(spark, folder):
    t = _t(spark, folder, "customer", "supplier")
    return t["customer"].select(F.col("c_nationkey").alias("nationkey")).intersect(t["supplier"].select("s_nationkey"))


@query("SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 5000")
def except_nations(spark, folder):
    t = _t(spark, folder, "customer", "supplier")
    return t["customer"].select(F.col("c_nationkey").alias("nationkey")).subtract(t["supplier"].filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_custkey, COUNT(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_counts(spark, folder):
    t = _t(spark, folder, "customer", "orders")
    counted = t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return t["customer"].select("c_custkey").join(counted, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT COUNT(DISTINCT o_custkey) AS n_customers FROM orders")
def count_distinct_customers(spark, folder):
    return _t(spark, folder, "orders")["orders"].agg(F.countDistinct("o_custkey").alias("n_customers"))


@query("""SELECT c_mktsegment, MIN(c_acctbal) AS least, MAX(c_acctbal) AS most, COUNT(*) AS n,
    CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS average FROM customer GROUP BY c_mktsegment""")
def segment_balances(spark, folder):
    c = F.col("c_acctbal")
    return _t(spark, folder, "customer")["customer"].groupBy("c_mktsegment").agg(F.min(c).alias("least"), F.max(c).alias("most"), F.count("*").alias("n"), (F.sum(c.cast("decimal(18,2)")).cast("double") / F.count("*")).alias("average"))


@query("""SELECT r_name AS region_name, STRING_AGG(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def nations_of_regions(spark, folder):
    t = _t(spark, folder, "nation", "region")
    names = F.array_join(F.array_sort(F.collect_list("n_name")), ",")
    return t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region_name")).agg(names.alias("nations"))


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE (o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('F', 'P')) OR o_orderpriority IS NULL""")
def where_mixed(spark, folder):
    where = (F.col("o_totalprice").between(1000, 50000) & F.col("o_orderstatus").isin("F", "P")) | F.col("o_orderpriority").isNull()
    return _t(spark, folder, "orders")["orders"].filter(where).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'middle' ELSE 'small' END AS size, CAST(o_orderkey AS VARCHAR) AS key_text FROM orders")
def case_and_cast(spark, folder):
    p = F.col("o_totalprice")
    return _t(spark, folder, "orders")["orders"].select("o_orderkey", F.when(p >= 300000, "large").when(p >= 100000, "middle").otherwise("small").alias("size"), F.col("o_orderkey").cast("string").alias("key_text"))


@query("SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue FROM orders WHERE o_totalprice < 0")
def sum_empty(spark, folder):
    return total({"orders": _t(spark, folder, "orders")["orders"].filter("o_totalprice < 0")}, "order_revenue")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'buil%'")
def ilike_segment(spark, folder):
    return _t(spark, folder, "customer")["customer"].filter(F.col("c_mktsegment").ilike("buil%")).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INT) AS place FROM customer")
def rank_in_nation(spark, folder):
    return _t(spark, folder, "customer")["customer"].selectExpr("c_custkey", "rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place")


@query(f"WITH q AS ({BY_REGION}) SELECT region_name AS label, total_revenue AS value, round(total_revenue / (SELECT SUM(total_revenue) FROM q), 9) AS share FROM q")
def pie_share(spark, folder):
    return chart_data(revenue_by_region(spark, folder), ChartSpec("pie", "region_name", "total_revenue")).withColumn("share", F.round("share", 9))


@query(f"WITH q AS ({BY_MONTH}) SELECT month AS label, monthly_revenue AS value, row_number() OVER (ORDER BY month) - 1 AS pos FROM q")
def line_positions(spark, folder):
    return chart_data(monthly_revenue(spark, folder), ChartSpec("line", "month", "monthly_revenue")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH q AS ({BY_CATEGORY}) SELECT category AS label, total_revenue AS value FROM q")
def bar_labels(spark, folder):
    return chart_data(revenue_by_category(spark, folder), ChartSpec("bar", "category", "total_revenue"))


GRID_SQL = """WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem),
    r AS (SELECT MIN(x) AS x0, (MAX(x) - MIN(x)) / 50 AS dx, MIN(y) AS y0, (MAX(y) - MIN(y)) / 50 AS dy FROM p)
    SELECT (least(floor((x - x0) / dx), 49) + 0.5) * dx + x0 AS x, (least(floor((y - y0) / dy), 49) + 0.5) * dy + y0 AS y, COUNT(*) AS n FROM p, r GROUP BY ALL"""


@query(GRID_SQL)
def scatter_grid(spark, folder):
    return chart_data(_t(spark, folder, "lineitem")["lineitem"], ChartSpec("scatter", "l_quantity", "l_extendedprice"), max_points=2_500)


@query("SELECT p_size AS x, p_retailprice AS y, COUNT(*) AS n FROM part GROUP BY p_size, p_retailprice")
def scatter_points(spark, folder):
    return chart_data(_t(spark, folder, "part")["part"], ChartSpec("scatter", "p_size", "p_retailprice"), max_points=1 << 30)


def _sql_count(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{w}') AS INT)" for w in words) + ")"


_N = _sql_count("q", HARD)
HARDNESS_SQL = f"CASE WHEN {_N} = 0 AND n <= 1 THEN 'easy' WHEN {_N} <= 1 AND n <= 1 THEN 'medium' WHEN {_N} <= 2 THEN 'hard' ELSE 'extra' END"


def _sql_cases(texts: list[str], n: str = "(conv_id + turn)") -> str:
    """The text whose turn it is in a row of conversations, as SQL."""
    return f"(CASE {n} % {len(texts)} " + " ".join(f"WHEN {k} THEN '" + t.replace("'", "''") + "'" for k, t in enumerate(texts)) + " END)"


def _cases(texts: list[str]) -> Column:
    return F.element_at(F.lit(texts), ((F.col("conv_id") + F.col("turn")) % len(texts) + 1).cast("int"))


@query(f"SELECT conv_id, turn, {HARDNESS_SQL} AS hardness FROM (SELECT conv_id, turn, q, (length(q) - length(replace(lower(q), 'select', ''))) / 6 AS n FROM (SELECT conv_id, turn, {_sql_cases(GRADED)} || ' -- ' || text AS q FROM conversations))")
def hardness_classes(spark, folder):
    turns = _t(spark, folder, "conversations")["conversations"]
    return turns.select("conv_id", "turn", hardness(F.concat(_cases(GRADED), F.lit(" -- "), F.col("text"))).alias("hardness"))


@query("""WITH c AS (SELECT COUNT(*) AS t, COUNT(*) FILTER (quality = 1 AND toxic = 1) AS b, COUNT(*) FILTER (quality = 1 AND toxic <> 1) AS x,
    COUNT(*) FILTER (quality <> 1 AND toxic = 1) AS y, COUNT(*) FILTER (quality <> 1 AND toxic <> 1) AS z FROM labels)
    SELECT 'both' AS outcome, b AS n, b * 100.0::DOUBLE / t AS percent FROM c UNION ALL SELECT 'only_a', x, x * 100.0::DOUBLE / t FROM c
    UNION ALL SELECT 'only_b', y, y * 100.0::DOUBLE / t FROM c UNION ALL SELECT 'neither', z, z * 100.0::DOUBLE / t FROM c""")
def agreement_report(spark, folder):
    return reports.agreement(_t(spark, folder, "labels")["labels"], F.col("quality") == 1, F.col("toxic") == 1)


@query("""SELECT lang AS "group", COUNT(*) AS n, COUNT(*) FILTER (quality = 1) * 100.0::DOUBLE / COUNT(*) AS a_percent, COUNT(*) FILTER (toxic = 1) * 100.0::DOUBLE / COUNT(*) AS b_percent
    FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def accuracy_by_group(spark, folder):
    t = _t(spark, folder, "labels", "documents")
    return reports.accuracy_by(t["labels"].join(t["documents"].select("doc_id", "lang"), "doc_id"), F.col("lang"), F.col("quality") == 1, F.col("toxic") == 1)


@query("""SELECT COUNT(*) AS total, COUNT(*) FILTER (quality = 1) AS a_correct, COUNT(*) FILTER (toxic = 1) AS b_correct,
    COUNT(*) FILTER (quality = 1) * 100.0::DOUBLE / COUNT(*) AS a_percent, COUNT(*) FILTER (toxic = 1) * 100.0::DOUBLE / COUNT(*) AS b_percent FROM labels""")
def accuracy_report(spark, folder):
    return reports.accuracy(_t(spark, folder, "labels")["labels"], F.col("quality") == 1, F.col("toxic") == 1)


@query("""WITH a AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY k), b AS (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY k)
    SELECT coalesce(a.k, b.k) AS _0, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_diff(spark, folder):
    t = _t(spark, folder, "customer", "supplier")
    return multiset_difference(t["customer"].select("c_nationkey"), t["supplier"].select("s_nationkey")).select(F.col("_0").cast("int"), "surplus")


#: Model output in the shapes that it comes in, around a query and what a user said.
OUTPUTS = ["```sql\n{sql};\n```", "{text}\n```\n{sql}\n```\nThat is all.", "{sql} ;", "SELECT Based on the tables, to find it: ```SQL {sql} ```", "The answer is {sql}. It counts rows."]


def _around(shape: str) -> Column:
    parts = re.split(r"(\{sql\}|\{text\})", shape)
    said = F.concat(F.lit("SELECT n FROM conv_"), F.col("conv_id").cast("string"), F.lit(" WHERE t = "), F.col("turn").cast("string"))
    return F.concat(*(said if p == "{sql}" else F.col("text") if p == "{text}" else F.lit(p) for p in parts))


def _outputs(spark, folder) -> DataFrame:
    shape = (F.col("conv_id") + F.col("turn")) % len(OUTPUTS)
    raw = reduce(lambda c, k: c.when(shape == k, _around(OUTPUTS[k])), range(1, len(OUTPUTS)), F.when(shape == 0, _around(OUTPUTS[0])))
    return _t(spark, folder, "conversations")["conversations"].select("conv_id", "turn", shape.alias("shape"), raw.alias("raw"))


SAID = "'SELECT n FROM conv_' || conv_id || ' WHERE t = ' || turn"


@query(f"SELECT conv_id, turn, {SAID} AS fenced FROM conversations WHERE (conv_id + turn) % {len(OUTPUTS)} IN (0, 1, 3)")
def extract_fenced_sql(spark, folder):
    return _outputs(spark, folder).filter("shape in (0, 1, 3)").select("conv_id", "turn", extract_sql(F.col("raw")).alias("fenced"))


@query(f"SELECT conv_id, turn, {SAID} AS sql FROM conversations")
def extract_batch(spark, folder):
    return _outputs(spark, folder).select("conv_id", "turn", extract_batch_sql(F.col("raw")).alias("sql"))


@query("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN '> ' || text ELSE text END AS answer FROM conversations")
def answers_of_servers(spark, folder):
    said = F.col("text")
    shapes = [
        F.to_json(F.struct(F.concat(F.lit("> "), said).alias("response"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices"))),
        F.to_json(F.struct(F.struct(said.alias("content")).alias("message"))),
        F.concat(F.lit('{"response": "first part"}\n'), F.to_json(F.struct(said.alias("response"))), F.lit('\n{"done": true}')),
    ]
    n = (F.col("conv_id") + F.col("turn")) % 4
    raw = reduce(lambda c, k: c.when(n == k, shapes[k]), range(1, 4), F.when(n == 0, shapes[0]))
    return _t(spark, folder, "conversations")["conversations"].select("conv_id", "turn", response_text(raw).alias("answer"))


@query("SELECT conv_id, turn, regexp_replace(chr(27) || '[1;31m' || text || chr(27) || '[0m', chr(27) || '\\[[0-9;]*m', '', 'g') AS plain FROM conversations")
def strip_ansi(spark, folder):
    colored = F.concat(F.lit("\x1b[1;31m"), F.col("text"), F.lit("\x1b[0m"))
    return _t(spark, folder, "conversations")["conversations"].select("conv_id", "turn", without_ansi(colored).alias("plain"))


def _sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(nfc_normalize(lower({column})), '{w}')" for w in words) + ")"


def _route_sql(column: str, compat: bool) -> str:
    from tallyglass.plans.router import _order

    return "CASE " + " ".join(f"WHEN {_sql_any(column, words)} THEN '{name}'" for name, words in _order(compat)) + " ELSE 'default' END"


def _chart_sql(column: str) -> str:
    from tallyglass.operators.charts import CHART_WORDS

    return "CASE " + " ".join(f"WHEN {_sql_any(column, words)} THEN '{name}'" for name, words in CHART_WORDS) + " ELSE 'bar' END"


ASKED = f"(SELECT conv_id, turn, {_sql_cases(QUESTIONS)} || ' ' || role AS question FROM conversations)"


def _asked(spark, folder) -> DataFrame:
    return _t(spark, folder, "conversations")["conversations"].select("conv_id", "turn", F.concat(_cases(QUESTIONS), F.lit(" "), F.col("role")).alias("question"))


@query(f"SELECT conv_id, turn, {_route_sql('question', False)} AS route, {_route_sql('question', True)} AS compat_route FROM {ASKED}")
def route_questions(spark, folder):
    return _asked(spark, folder).select("conv_id", "turn", route(F.col("question")).alias("route"), route(F.col("question"), compat=True).alias("compat_route"))


@query(f"SELECT conv_id, turn, {_chart_sql('question')} AS chart FROM {ASKED}")
def chart_type_of_questions(spark, folder):
    return _asked(spark, folder).select("conv_id", "turn", chart_type(F.col("question")).alias("chart"))


@query(f"SELECT conv_id, turn, {_route_sql('text', False)} AS route, {_chart_sql('text')} AS chart FROM conversations")
def route_turns(spark, folder):
    return routed(_t(spark, folder, "conversations")["conversations"]).select("conv_id", "turn", "route", "chart")


#: DuckDB's names of types, and Spark's.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "FLOAT[]": "array<float>", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "TIMESTAMP_NS": "timestamp_ntz"}
_TYPE = "CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " ELSE lower(column_type) END"
DESCRIBED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(row_number() OVER () - 1 AS INT) AS position, column_name, {_TYPE} AS type FROM (DESCRIBE {t})" for t in TABLES)


@query(DESCRIBED)
def schema_ddl(spark, folder):
    return spark.createDataFrame(schema_rows(_t(spark, folder, *TABLES)), "table_name string, position int, column_name string, type string")


def _sql_keys(table: str) -> str:
    own = [f", PRIMARY KEY ({', '.join(STAR_KEYS.primary[table])})"] if table in STAR_KEYS.primary else []
    return "".join([*own, *(f", FOREIGN KEY ({', '.join(c)}) REFERENCES {other} ({', '.join(theirs)})" for c, other, theirs in STAR_KEYS.foreign.get(table, []))])


@query(f"""SELECT table_name, 'CREATE TABLE ' || table_name || ' (' || string_agg(column_name || ' ' || upper(type), ', ' ORDER BY position) || CASE table_name
    {' '.join(f"WHEN '{t}' THEN '{_sql_keys(t)}'" for t in TABLES)} END || ');' AS statement FROM ({DESCRIBED}) GROUP BY table_name""")
def ddl_statements(spark, folder):
    return spark.createDataFrame([(s.split(" ")[2], s) for s in ddl(_t(spark, folder, *TABLES)).split("\n\n")], "table_name string, statement string")


def _sql_text(name: str, sqlite: str, same: str) -> None:
    """Registers a SQL text in SQLite's wording, run as a predicted or typed query is run, and what it must equal."""

    def run(spark, folder):
        for table, df in _t(spark, folder, *STAR, "supplier").items():
            df.createOrReplaceTempView(table)
        found = execute(spark, sqlite, sqlite_dialect=True)
        if found.df is None:
            raise ValueError(found.error)
        return found.df

    QUERIES[name], ORACLE_SQL[name] = run, same


_sql_text("sql_regions", "SELECT r_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY n DESC;", "SELECT r_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_sql_text("sql_alias_in_where", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE twice > 600000", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 > 600000")
_sql_text("sql_bare_column", "SELECT c_nationkey, c_name, MAX(c_acctbal) AS most FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_name, c_acctbal) AS c_name, MAX(c_acctbal) AS most FROM customer GROUP BY c_nationkey")
_sql_text(
    "sql_dates",
    "SELECT strftime('%Y-%m', o_orderdate) AS month, date(MAX(o_orderdate)) AS last_day, strftime('%j', date(MIN(o_orderdate))) AS first_day, COUNT(*) AS n FROM orders GROUP BY strftime('%Y-%m', o_orderdate)",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last_day, strftime(MIN(o_orderdate), '%j') AS first_day, COUNT(*) AS n FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')",
)
_sql_text("sql_rounded", "SELECT o_orderkey, round(o_totalprice) AS whole, o_totalprice / (o_custkey - o_custkey) AS nothing FROM orders", "SELECT o_orderkey, round(o_totalprice) AS whole, CAST(NULL AS DOUBLE) AS nothing FROM orders")
_sql_text("sql_totals", "SELECT c_mktsegment, total(c_nationkey) AS t, ifnull(MAX(NULL), 'none') AS x FROM customer WHERE c_name LIKE 'customer%' GROUP BY c_mktsegment", "SELECT c_mktsegment, CAST(SUM(c_nationkey) AS DOUBLE) AS t, 'none' AS x FROM customer GROUP BY c_mktsegment")
for _kind in ("FULL", "RIGHT"):
    _sql = f"SELECT c_custkey, o_orderkey FROM customer {_kind} JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey AND c_acctbal > 0"
    _sql_text(f"sql_{_kind.lower()}_join", _sql, _sql)
_sql_text("sql_self_join", *["SELECT a.n_name AS earlier, b.n_name AS later FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"] * 2)
_sql_text("sql_theta_join", *["SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON n_regionkey < r_regionkey GROUP BY r_name"] * 2)
_sql_text("sql_cross_join", *["SELECT r_name, n_name FROM region CROSS JOIN nation"] * 2)

#: Gold queries and two methods' predictions.
PREDICTED = [
    ("SELECT r_name FROM region", "SELECT r_name FROM region ORDER BY r_name DESC", "SELECT n_name FROM nation"),
    ("SELECT COUNT(*) FROM orders WHERE o_totalprice > 100000", "SELECT COUNT(o_orderkey) FROM orders WHERE o_totalprice > 100000", "SELECT COUNT(*) FROM orders"),
    ("SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name AS other FROM nation ORDER BY n_name"),
    ("SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, SUM(1) FROM customer GROUP BY 1", "SELECT DISTINCT c_mktsegment FROM customer"),
    ("SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT DISTINCT c_nationkey FROM customer", "SELECT nothing FROM customer"),
    ("SELECT r_name, COUNT(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING COUNT(*) > 4 ORDER BY r_name", "SELECT r_name, 5 FROM region ORDER BY 1", "SELECT r_name, 5 FROM region ORDER BY r_name DESC"),
    ("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')", "SELECT n_name FROM nation WHERE n_regionkey > 1"),
]


def _sql_match(gold: str, predicted: str) -> str:
    """Whether two results match, by DuckDB."""
    if "nothing" in predicted:
        return "false"
    if gold.count(" FROM ") and gold.split(" FROM ")[0].count(",") != predicted.split(" FROM ")[0].count(","):
        return "false"
    placed = (lambda q: f"SELECT row_number() OVER () AS pos, * FROM ({q})") if "ORDER BY" in gold else (lambda q: f"SELECT * FROM ({q})")
    g, p = placed(gold), placed(predicted)
    return f"NOT EXISTS (SELECT * FROM (({g}) EXCEPT ALL ({p}))) AND NOT EXISTS (SELECT * FROM (({p}) EXCEPT ALL ({g})))"


def _evaluated(spark, folder, method: int) -> DataFrame:
    def open_database(db_id: str) -> bool:
        for table, df in _t(spark, folder, *STAR, "supplier").items():
            df.createOrReplaceTempView(table)
        return db_id == "star"

    run = Evaluator(spark, open_database)
    gold = spark.createDataFrame([(k, g[0], "star") for k, g in enumerate(PREDICTED)], "idx int, gold_sql string, db_id string")
    out = run.evaluate(spark.createDataFrame([(k, g[method]) for k, g in enumerate(PREDICTED)], "idx int, pred_sql string"), gold)
    run.close()
    return out


EVALUATED = " UNION ALL ".join(f"SELECT {k} AS idx, " + "'" + g.replace("'", "''") + f"' AS q, {_sql_match(g, a)} AS a, {_sql_match(g, b)} AS b" for k, (g, a, b) in enumerate(PREDICTED))
EVALUATED = f"(SELECT idx, a, b, {HARDNESS_SQL} AS hardness FROM (SELECT *, (length(q) - length(replace(lower(q), 'select', ''))) / 6 AS n FROM ({EVALUATED})))"


def _merged(spark, folder) -> DataFrame:
    return reports.merge(_evaluated(spark, folder, 1), _evaluated(spark, folder, 2), "a", "b")


@query(f"SELECT idx, hardness, a AS a_correct, b AS b_correct FROM {EVALUATED}")
def evaluation(spark, folder):
    return _merged(spark, folder).select("idx", "hardness", "a_correct", "b_correct")


@query(f"""SELECT hardness AS "group", COUNT(*) AS n, COUNT(*) FILTER (a) * 100.0::DOUBLE / COUNT(*) AS a_percent, COUNT(*) FILTER (b) * 100.0::DOUBLE / COUNT(*) AS b_percent FROM {EVALUATED} GROUP BY hardness""")
def evaluation_by_hardness(spark, folder):
    return reports.accuracy_by_hardness(_merged(spark, folder), F.col("a_correct"), F.col("b_correct"))


@query("SELECT round(AVG(CAST(value AS DECIMAL(18,4))), 4)::DOUBLE AS avg_latency, AVG(event_id) AS avg_tokens FROM events")
def evaluation_cost(spark, folder):
    details = _t(spark, folder, "events")["events"].select(F.col("value").cast("decimal(18,4)").alias("latency"), F.col("event_id").alias("tokens"))
    return reports.cost(details).select(F.round("avg_latency", 4).cast("double").alias("avg_latency"), "avg_tokens")


def _ask(question: str) -> Query:
    def run(spark, folder):
        return ask(spark, _t(spark, folder, *STAR), question).data

    return run


QUERIES["ask_regions"] = _ask("Revenue by region")
ORACLE_SQL["ask_regions"] = f"WITH q AS ({BY_REGION}) SELECT region_name AS label, total_revenue AS value FROM q"
QUERIES["ask_months"] = _ask("Doanh thu theo tháng")
ORACLE_SQL["ask_months"] = f"WITH q AS ({BY_MONTH}) SELECT month AS label, monthly_revenue AS value, CAST(row_number() OVER (ORDER BY month) - 1 AS INT) AS pos FROM q"
QUERIES["ask_top_products"] = _ask("Top 5 best-selling products")
ORACLE_SQL["ask_top_products"] = f"WITH q AS ({TOP}) SELECT product_name AS label, total_qty AS value FROM q"
