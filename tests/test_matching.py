from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.operators import reports
from tallyglass.operators.matching import hardness, matches, multiset_difference, numbered, order_sensitive, same_rows

A = "(SELECT * FROM VALUES (1, 'a'), (2, 'b'), (2, 'b'), (NULL, 'c') AS t(x, y))"

CASES = [
    (f"SELECT * FROM {A}", f"SELECT * FROM {A} ORDER BY y DESC", False, True),
    (f"SELECT * FROM {A} ORDER BY y", f"SELECT * FROM {A} ORDER BY y DESC", True, False),
    (f"SELECT * FROM {A} ORDER BY y", f"SELECT x AS other, y FROM {A} ORDER BY y", True, True),
    (f"SELECT DISTINCT * FROM {A}", f"SELECT * FROM {A}", False, False),
    ("SELECT 1", "SELECT 1.0", False, True),
    ("SELECT 1.0D", "SELECT 1", True, True),
    ("SELECT '1'", "SELECT 1", False, False),
    ("SELECT NULL", "SELECT 'x' WHERE false UNION ALL SELECT NULL", False, True),
    ("SELECT 1, 2", "SELECT 1", False, False),
    ("SELECT 1 WHERE false", "SELECT 2 WHERE false", False, True),
    ("SELECT 1 WHERE false", "SELECT 2", True, False),
]


@pytest.mark.parametrize("predicted, gold, ordered, want", CASES)
def test_matches(spark, predicted, gold, ordered, want):
    assert matches(spark.sql(predicted), spark.sql(gold), ordered) is want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3, None]), max_size=8), st.lists(st.sampled_from([1, 2, 3, None]), max_size=8))
def test_multisets(spark, a, b):
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "v int")
    want = {k: n for k in {*a, *b} if (n := Counter(a)[k] - Counter(b)[k])}
    assert {r["_0"]: r["surplus"] for r in multiset_difference(frame(a), frame(b)).collect()} == want
    assert same_rows(frame(a), frame(b)) is (not want)


def test_numbered(spark):
    df = spark.range(1_000, numPartitions=7).orderBy(F.desc("id")).persist()
    assert [r["pos"] for r in numbered(df).orderBy(F.desc("id")).collect()] == list(range(1_000))
    assert numbered(df.filter("false")).count() == 0
    df.unpersist()


def test_hardness(spark):
    cases = {"SELECT a FROM t": "easy", "SELECT a FROM t GROUP BY a": "medium", "SELECT a FROM (SELECT a FROM t)": "hard", "SELECT a FROM t JOIN u GROUP BY a": "hard", "SELECT a FROM t JOIN u GROUP BY a HAVING x": "extra"}
    got = spark.createDataFrame([(q,) for q in cases], "q string").select(hardness(F.col("q"))).collect()
    assert [r[0] for r in got] == list(cases.values())
    assert order_sensitive("select a Order By b") and not order_sensitive("select a")


def test_reports(spark):
    rows = [(0, "easy", True, True), (1, "easy", True, False), (2, "extra", False, False), (3, "hard", False, True)]
    df = spark.createDataFrame(rows, "idx int, hardness string, a boolean, b boolean")
    assert tuple(reports.accuracy(df, F.col("a"), F.col("b")).first()) == (4, 2, 2, 50.0, 50.0)
    assert [tuple(r) for r in reports.accuracy_by_hardness(df, F.col("a"), F.col("b")).collect()] == [("easy", 2, 100.0, 50.0), ("hard", 1, 0.0, 100.0), ("extra", 1, 0.0, 0.0)]
    assert {tuple(r) for r in reports.agreement(df, F.col("a"), F.col("b")).collect()} == {("both", 1, 25.0), ("only_a", 1, 25.0), ("only_b", 1, 25.0), ("neither", 1, 25.0)}
    none = df.filter("false")
    assert reports.accuracy(none, F.col("a"), F.col("b")).first()["a_percent"] is None
    assert reports.agreement(none, F.col("a"), F.col("b")).first()["percent"] is None
