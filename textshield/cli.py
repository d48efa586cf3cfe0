"""Scan a file, or standard input: python -m textshield.cli [FILE] [--json] [--threshold X]. Exit 1: injection found."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textshield import runtime
from textshield.operators import detect
from textshield.plans import guard
from textshield.sources import files

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textshield", description="Scan text for prompt injection.")
    parser.add_argument("file", nargs="?", help="file to scan (else standard input)")
    parser.add_argument("--json", action="store_true", help="print JSON")
    parser.add_argument("--threshold", type=float, default=0.5, help="score from which a text counts as injected")
    parser.add_argument("--version", action="version", version=f"textshield {VERSION}")
    args = parser.parse_args(argv)
    spark = runtime.prepare(SparkSession.builder.getOrCreate())
    df = files.read_texts(spark, args.file) if args.file else spark.createDataFrame([("-", sys.stdin.buffer.read().decode("utf-8", "replace"))], "path string, text string")
    s = F.col("scan")
    shown = guard.to_json(s["score"], s["risk"], s["injected"], s["threshold"], s["findings"]) if args.json else files.text_report(s)
    row = detect.scan(df, threshold=args.threshold).select(shown.alias("shown"), s["injected"].alias("injected")).first()
    print(json.dumps(json.loads(row["shown"]), indent=2) if args.json else row["shown"])
    return int(row["injected"])


if __name__ == "__main__":
    sys.exit(main())
