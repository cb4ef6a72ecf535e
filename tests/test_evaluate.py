import json
import sqlite3

import pytest
from tallyglass.operators import reports
from tallyglass.plans.evaluate import Evaluator, clean_outputs, sqlite_databases
from tallyglass.sources import files
from tallyglass.sources.sqlite import SQLiteSource, spark_type


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("databases")
    (root / "shop").mkdir()
    con = sqlite3.connect(root / "shop" / "shop.sqlite")
    con.executescript(
        "CREATE TABLE item (id INTEGER PRIMARY KEY, name TEXT NOT NULL, price REAL, bought DATE, raw BLOB); CREATE TABLE \"odd name\" (k INT, v TEXT, PRIMARY KEY (k, v)) WITHOUT ROWID; CREATE VIEW seen AS SELECT 1;"
        "INSERT INTO item VALUES (1, 'Tea', 2.5, '2024-01-05', x'00ff'), (2, 'cup', NULL, '2024-02-05', NULL), (3, 'tea', 'cheap', '2024-02-09', NULL), (9, 'pot', 8, NULL, NULL); INSERT INTO \"odd name\" VALUES (1, 'x'), (2, 'y');"
    )
    con.commit()
    con.close()
    return root


def test_sqlite_source(spark, folder):
    spark.dataSource.register(SQLiteSource)
    read = lambda t, **o: spark.read.format("sqlite").options(path=str(folder / "shop" / "shop.sqlite"), table=t, **o).load()
    item = read("item")
    assert item.dtypes == [("id", "bigint"), ("name", "string"), ("price", "double"), ("bought", "string"), ("raw", "binary")]
    assert [tuple(r)[:4] for r in item.orderBy("id").collect()] == [(1, "Tea", 2.5, "2024-01-05"), (2, "cup", None, "2024-02-05"), (3, "tea", None, "2024-02-09"), (9, "pot", 8.0, None)]
    assert bytes(item.filter("id = 1").first()["raw"]) == b"\x00\xff"
    for where, want in {"id > 1 AND id <= 3": [2, 3], "name = 'Tea'": [1], "name IN ('cup', 'pot')": [2, 9], "price IS NULL": [2, 3], "bought IS NULL OR id = 1": [1, 9], "upper(name) = 'TEA' AND id >= 2": [3]}.items():
        assert [r["id"] for r in item.filter(where).orderBy("id").collect()] == want
    assert read("item", partitions="2").rdd.getNumPartitions() == 2 and read("odd name").count() == 2
    assert spark_type("VARCHAR(9)").simpleString() == "string" and spark_type("DECIMAL").simpleString() == "double"
    with pytest.raises(Exception, match="no table"):
        read("nothing").schema  # noqa: B018


GOLD = ["SELECT name FROM item WHERE price > 1\tshop", "", "no tab here", "SELECT count(*) FROM item\tshop", "SELECT name FROM item ORDER BY id\tshop", "SELECT strftime('%m', bought), count(*) FROM item GROUP BY 1\tshop", "SELECT 1\tnowhere"]
PRED = ["SELECT name FROM item WHERE price >= 2.5", "SELECT max(id) FROM item", "SELECT name FROM item ORDER BY id DESC", "SELECT substr(bought, 6, 2) AS m, count(*) FROM item GROUP BY m", "SELECT 1"]


def test_evaluation(spark, folder, tmp_path):
    (tmp_path / "gold.sql").write_text("\n".join(GOLD))
    (tmp_path / "pred.txt").write_bytes(b"\xef\xbb\xbf" + "\n\n".join(PRED).encode())
    (tmp_path / "latin.txt").write_bytes("SELECT 'é'\nSELECT 2\nSELECT 3\nSELECT 4\nDROP TABLE item".encode("latin-1"))
    (tmp_path / "dev.json").write_text(json.dumps([{"question": "one?", "db_id": "shop"}, {"question": "two?", "db_id": "shop"}], indent=1))
    gold, questions = files.read_gold(spark, str(tmp_path / "gold.sql")), files.read_questions(spark, str(tmp_path / "dev.json"))
    assert [r["idx"] for r in gold.orderBy("idx").collect()] == list(range(5))
    run = Evaluator(spark, sqlite_databases(spark, str(folder)))
    a = run.evaluate(files.read_predictions(spark, str(tmp_path / "pred.txt")), gold, questions)
    b = run.evaluate(files.read_predictions(spark, str(tmp_path / "latin.txt")), gold, questions)
    got = [(r["question"], r["correct"], bool(r["error"]), r["hardness"]) for r in a.orderBy("idx").collect()]
    assert got == [("one?", True, False, "easy"), ("two?", False, False, "easy"), ("", False, False, "medium"), ("", True, False, "medium"), ("", False, True, "easy")]
    assert b.filter("idx = 0").first()["pred_sql"] == "SELECT 'é'"
    merged = reports.merge(a, b, "a", "b")
    files.write_report_csv(merged, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes().startswith(b"\xef\xbb\xbfidx,") and merged.count() == 5
    with pytest.raises(ValueError):
        run.evaluate(files.read_predictions(spark, str(tmp_path / "pred.txt")).limit(2), gold)
    run.close()


def test_cleaning(spark, tmp_path):
    (tmp_path / "raw.txt").write_bytes("```sql SELECT a FROM t; ```\n\nb FROM t\n".encode())
    cleaned = clean_outputs(files.read_raw_outputs(spark, str(tmp_path / "raw.txt")))
    assert [tuple(r) for r in cleaned.orderBy("idx").collect()] == [(0, "SELECT a FROM t", True), (1, "SELECT", False), (2, "SELECT b FROM t", True)]
    files.write_queries(cleaned, str(tmp_path / "clean"))
    assert spark.read.text(str(tmp_path / "clean")).count() == 3


def test_details(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Latency,TOKENS\n1.0,100\n3.0,x\n")
    assert tuple(reports.cost(files.read_details(spark, str(tmp_path / "d.csv"))).first()) == (2.0, 100.0)
    (tmp_path / "e.csv").write_text("other\n1\n")
    assert tuple(reports.cost(files.read_details(spark, str(tmp_path / "e.csv"))).first()) == (None, None)
