"""spark-submit or python -m ticketflow: run one step on a shared folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ticketflow.fixed_values import DEMO_TEXTS, SEED
from ticketflow.operators import profile
from ticketflow.plans import steps
from ticketflow.sources import tickets as files


def main() -> None:
    parser = argparse.ArgumentParser(prog="ticketflow")
    parser.add_argument("step", choices=["prepare", "train", "automate", "errors", "predict", "compare"])
    parser.add_argument("folder", help="shared folder for tables and models")
    parser.add_argument("texts", nargs="*", help="texts to predict")
    parser.add_argument("--method", choices=list(steps.METHODS), default="full")
    parser.add_argument("--scale", type=int, default=1)
    parser.add_argument("--seed", type=int, default=SEED)
    parser.add_argument("--input", help="a ticket table to prepare instead of a generated one")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet", "json", "orc"])
    parser.add_argument("--csv", action="store_true", help="store splits or scores as CSV, too")
    args = parser.parse_args()
    spark = SparkSession.builder.appName(f"ticketflow {args.step}").getOrCreate()
    if args.step == "prepare":
        if args.input:
            tickets = files.read_tickets(spark, args.input, args.format, strict=True)
            table = steps.prepare_from(tickets, args.folder, args.seed, args.csv)
        else:
            table = steps.prepare(spark, args.folder, args.scale, args.seed)
        shown = [profile.class_counts(table, pct=True), profile.class_counts_by_split(table), profile.row_counts(table)]
    elif args.step == "train":
        shown = [steps.train(spark, args.folder, args.method, args.seed)]
    elif args.step == "automate":
        shown = steps.automate(spark, args.folder, args.method, args.csv)
    elif args.step == "errors":
        shown = steps.new_examples(spark, args.folder, args.method)
    elif args.step == "predict":
        shown = [steps.predict(spark, args.folder, args.texts or list(DEMO_TEXTS), args.method)]
    else:
        shown = [*steps.compare(spark, args.folder), steps.class_scores(spark, args.folder)]
    for df in shown:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
