import pytest

SF = "/root/testdata/sf0.001"
LONG = "many words in one very long text " * 6_000

#: (doc_id, text): null, empty, blank, short, very long, repeated, tied and oddly spaced texts.
ODD = [
    (9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9005, LONG), (9006, LONG + "tail"), (9007, "one"), (9008, "a b \x1c c d İß é,"),
    (9009, "don't stop! <|endoftext|> now\r\n\r\nthen"), (9010, "日本語 テキスト 🙂🙂"), (9011, "x " * 300), (9012, "tie tie tie"), (9012, "tie tie tie"), (None, "no id here"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents table, odd rows, and extra columns whose names clash with those that operators make."""
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    extra = [f"'{c}' AS {c}" for c in ("doc", "key", "n", "words", "hash", "size", "shard", "item", "stratum", "host", "kept", "component_id")]
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars", *extra).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
