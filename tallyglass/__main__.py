"""python -m tallyglass clean RAW OUT | evaluate --gold F --pred NAME=F [--pred NAME=F] --questions F --databases DIR [--details F] [--out CSV]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tallyglass.operators import reports
from tallyglass.plans.evaluate import Evaluator, clean_outputs, sqlite_databases
from tallyglass.session import session
from tallyglass.sources import files


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser("tallyglass", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    clean = sub.add_parser("clean")
    clean.add_argument("raw")
    clean.add_argument("out")
    evaluate = sub.add_parser("evaluate")
    evaluate.add_argument("--gold", required=True)
    evaluate.add_argument("--pred", action="append", required=True, help="NAME=FILE, once or twice")
    evaluate.add_argument("--questions", required=True)
    evaluate.add_argument("--databases", required=True)
    evaluate.add_argument("--details")
    evaluate.add_argument("--out")
    a = parser.parse_args(args)
    spark = session()
    if a.command == "clean":
        cleaned = clean_outputs(files.read_raw_outputs(spark, a.raw)).cache()
        files.write_queries(cleaned, a.out)
        cleaned.agg(F.count("*").alias("cleaned"), F.count_if("query_shaped").alias("query_shaped")).show()
        return 0
    gold, questions = files.read_gold(spark, a.gold), files.read_questions(spark, a.questions)
    run = Evaluator(spark, sqlite_databases(spark, a.databases))
    done = {name: run.evaluate(files.read_predictions(spark, path), gold, questions) for name, _, path in (p.partition("=") for p in a.pred)}
    names = list(done)
    one, two = names[0], names[-1]
    merged = reports.merge(done[one], done[two], one, two) if one != two else done[one].withColumnsRenamed({"pred_sql": f"{one}_pred", "correct": f"{one}_correct"})
    x, y = F.col(f"{one}_correct"), F.col(f"{two}_correct")
    reports.accuracy(merged, x, y).show()
    reports.accuracy_by_hardness(merged, x, y).show()
    reports.agreement(merged, x, y).show()
    if a.details:
        reports.cost(files.read_details(spark, a.details)).show()
    if a.out:
        files.write_report_csv(merged, a.out)
    run.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
