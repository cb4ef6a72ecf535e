"""Files of an evaluation: gold queries, predictions, questions, run details; and the sinks for what comes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyglass.functions.text import squeezed


def _lines(spark: SparkSession, path: str, text: Column) -> DataFrame:
    """(idx, line): the lines of one file that are not blank, trimmed and numbered from 0 in order. A file is one row here,
    as positions have to be kept: for files of queries, one for each question, not for data."""
    split = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(text, "\r\n|\n|\r")).alias("pos", "line"))
    kept = split.select("pos", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("line")).filter("line <> ''")
    return kept.select((F.row_number().over(W.orderBy("pos")) - 1).alias("idx"), "line")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(idx, gold_sql, db_id) of lines "SQL<TAB>db_id"; the last tab counts, lines without one are left out."""
    cut = F.regexp_extract
    rows = _lines(spark, path, F.col("content").cast("string")).filter(F.contains("line", F.lit("\t")))
    rows = rows.select("idx", F.trim(cut("line", "^(.*)\t([^\t]*)$", 1)).alias("gold_sql"), F.trim(cut("line", "^(.*)\t([^\t]*)$", 2)).alias("db_id"))
    return rows.withColumn("idx", F.row_number().over(W.orderBy("idx")) - 1)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, pred_sql): one query a line. UTF-8 (a byte order mark is dropped), or Latin-1 where a file is not UTF-8."""
    content = F.col("content")
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = F.coalesce(F.regexp_replace(utf8, "^﻿", ""), F.decode(content, "ISO-8859-1"))
    return _lines(spark, path, text).withColumnRenamed("line", "pred_sql")


def read_raw_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(idx, raw): model output, one answer a line, Latin-1; blank lines keep their place."""
    split = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(F.regexp_replace(F.decode("content", "ISO-8859-1"), "(\r\n|\n|\r)$", ""), "\r\n|\n|\r")).alias("idx", "raw"))
    return split


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, question, db_id) of a JSON array, in its order."""
    parsed = F.from_json(F.col("content").cast("string"), "array<struct<question: string, db_id: string>>")
    return spark.read.format("binaryFile").load(path).select(F.posexplode(parsed).alias("idx", "q")).select("idx", "q.question", "q.db_id")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """(latency, tokens) of a CSV file with either column, in any case; null where there is none or no number."""
    df = spark.read.csv(path, header=True)
    by_name = {c.lower(): c for c in df.columns}
    number = lambda *names: next((F.col(f"`{by_name[n]}`").try_cast("double") for n in names if n in by_name), F.lit(None).cast("double"))
    return df.select(number("latency").alias("latency"), number("tokens", "token").alias("tokens"))


def write_queries(cleaned: DataFrame, path: str) -> None:
    """One query a line in order of idx; line breaks inside a query become spaces."""
    cleaned.orderBy("idx").select(squeezed(F.col("sql")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_report_csv(report: DataFrame, path: str) -> None:
    """A report (a row for each question, ordered by idx) as one CSV file with a byte order mark, for spreadsheets."""
    report.orderBy("idx").toPandas().to_csv(path, index=False, encoding="utf-8-sig")
