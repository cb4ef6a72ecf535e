"""What the operators share: where results are stored, what may be broadcast, how texts are cut into words."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyglass.llm.common import alnum_words, ascii_lower, free, shared_dir, small, space_words, table_bytes


class Session:
    """As much of a session as shared_dir() asks for."""

    def __init__(self, master, folder=None, conf=None):
        self.given = []
        self.sparkContext = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=self.given.append)
        self.conf = SimpleNamespace(get=lambda key, default: conf)


def test_shared_dir():
    assert shared_dir(Session("yarn", conf="s3://b/x/")) == "s3://b/x"
    assert shared_dir(Session("yarn", folder="hdfs://n/y")) == "hdfs://n/y"
    assert shared_dir(local := Session("local[8]")).startswith("file:///") and len(local.given) == 1
    for master in ("yarn", "spark://h:1", "local-cluster[3,2,1024]", "k8s://https://h"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(Session(master))


def test_table_bytes(spark):
    df = spark.createDataFrame([(1, "ab", ["xyz", ""], [1, 2], (1, "q")), (None, None, None, None, None)], "a long, b string, c array<string>, d array<long>, e struct<x: long, y: string>")
    assert 100 < table_bytes(df) < 400 and table_bytes(df.filter("false")) == 0
    big = df.selectExpr("repeat(b, 1000) AS b").filter("b is not null")
    assert table_bytes(big) > 2_000
    plan = lambda x: x._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(small(big, 10_000)) and "strategy=broadcast" not in plan(small(big, 1_000))


def test_words(spark):
    texts = [None, "", " \t\x0b", "a  B\x1cc", "É é A-b_9", "\x00x\x7fy", "日本 X\u00a0y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(space_words(F.col("t")), alnum_words(F.col("t")), ascii_lower(F.col("t"))).collect()]
    assert got == [
        ([], [], None), ([], [], ""), ([], [], " \t\x0b"), (["a", "B\x1cc"], ["a", "b", "c"], "a  b\x1cc"), (["É", "é", "A-b_9"], ["É", "é", "a", "b", "9"], "É é a-b_9"), (["\x00x\x7fy"], ["x", "y"], "\x00x\x7fy"),
        (["日本", "X\u00a0y"], ["日本", "x\u00a0y"], "日本 x\u00a0y"),
    ]
    assert free("doc", ["Doc", "doc_"]) == "doc__"
