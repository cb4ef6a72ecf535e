import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.functions import text as tx
from tallyglass.functions.dialect import to_spark


def apply(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_extract_sql(spark):
    cases = {
        "SELECT a FROM t;": "SELECT a FROM t", "```sql\nSELECT a\nFROM t;\n```": "SELECT a\nFROM t", "Here it is:\n```\nselect 1\n```\nDone.": "select 1", "```SQLite\nSELECT 2\n```": "SELECT 2", " a FROM t ;; ": "SELECT a FROM t",
        "WITH q AS (SELECT 1) SELECT * FROM q": "WITH q AS (SELECT 1) SELECT * FROM q", "DROP TABLE t": None, "delete from t": None, "": None, "``` ```": None,
    }
    assert apply(spark, tx.extract_sql, cases) == list(cases.values())


def test_extract_batch(spark):
    cases = {
        "SELECT a FROM t;": "SELECT a FROM t", "SELECT Based on it: ```sql SELECT b FROM t ; ```": "SELECT b FROM t", "``` SELECT c   FROM t ```": "SELECT c FROM t", "You want SELECT d FROM t. Then more.": "SELECT d FROM t",
        "SELECT to find rows we run SELECT e FROM t WHERE x = 1.5": "SELECT e FROM t WHERE x = 1.5", "f FROM t": "SELECT f FROM t", "": "SELECT",
    }
    assert [(x or "").strip() for x in apply(spark, tx.extract_batch_sql, cases)] == list(cases.values())
    once = apply(spark, tx.extract_batch_sql, cases)
    assert apply(spark, tx.extract_batch_sql, once) == once


def test_code(spark):
    cases = {"```python\nplt.plot(1)\n```": "plt.plot(1)", "\x1b[31mplt.bar\x1b[0m\x07(2)": "plt.bar(2)", "``` x": "x", "a\n\tb\r": "a\n\tb"}
    assert apply(spark, tx.clean_code, cases) == list(cases.values())


def test_response_text(spark):
    cases = {
        '{"response": "a"}': "a", '{"choices": [{"text": "b"}]}': "b", '{"choices": [{"message": {"content": "c"}}]}': "c", '{"message": {"content": "d"}}': "d", '{"response": "e"}\n{"response": "f"}\n{"done": true}': "f", "plain": "plain",
    }
    assert apply(spark, tx.response_text, cases) == list(cases.values())
    from tallyglass.plans.providers import text_of

    assert [text_of(c) for c in cases] == list(cases.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="sSelect x;`\n", max_size=30), min_size=1, max_size=8))
def test_counts_and_ends(spark, values):
    assert apply(spark, lambda c: tx.occurrences(c, "select"), values) == [v.count("select") for v in values]
    assert all(not re.search(r"[;\s]$", x) for x in apply(spark, tx.without_end, values))


def test_dialect(spark):
    run = lambda sql: spark.sql(to_spark(sql)).first()[0]
    day = "'2024-03-09 10:20:30'"
    for code, want in {"%Y": "2024", "%m": "03", "%d": "09", "%H:%M:%S": "10:20:30", "%j": "069", "%w": "6", "%s": "1709979630"}.items():
        assert run(f"SELECT strftime('{code}', {day})") == want
    assert run("SELECT strftime('%m', 'no date')") is None and run(f"SELECT date({day})") == "2024-03-09"
    assert abs(run(f"SELECT julianday({day})") - 2460378.930902778) < 1e-6
    assert run("SELECT 'ABC' LIKE 'a%'") is True and run("SELECT 'like date(x)'") == "like date(x)"
    assert run("SELECT total(x) FROM (SELECT 1 AS x WHERE false)") == 0.0 and run("SELECT ifnull(NULL, 4)") == 4
    assert sorted(run("SELECT group_concat(x) FROM VALUES (1), (2) AS t(x)").split(",")) == ["1", "2"]
