"""Command line: scan a file or a folder, report, and exit with 1 where something is flagged."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from . import reach, report
from .config import DEFAULT
from .plans.scan import exit_code, findings, scan_files
from .sources.files import files


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="glyphtrace")
    p.add_argument("target", nargs="?", default=".")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-b", "--binary-check", action="store_true", help="skip statistics for a single file")
    p.add_argument("--json", action="store_true")
    p.add_argument("-s", "--statistical", action="store_true", help="on by default")
    p.add_argument("--no-statistical", action="store_true")
    p.add_argument("-a", "--advanced", action="store_true")
    p.add_argument("--fixed", action="store_true", help="mend the quirks of the published checks")
    p.add_argument("--markdown", action="store_true")
    p.add_argument("--since", help="only files modified at this time or later, such as 2026-08-02")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("glyphtrace").getOrCreate()
    reach(spark)
    single = os.path.isfile(a.target)
    plain = single and (a.binary_check or a.target.lower().endswith((".png", ".jpg", ".jpeg")))
    config = replace(DEFAULT, compat=not a.fixed, statistical=not (a.no_statistical or plain), advanced=a.advanced and not plain)
    if not os.path.exists(a.target) and "://" not in a.target:
        print("No findings")
        return 0
    results = scan_files(files(spark, a.target, hidden="://" not in a.target, since=a.since), config)
    results = (results if single else findings(results)).cache()
    try:
        if a.json:
            for row in report.to_json(results).toLocalIterator():
                print(row["value"])
        else:
            for line in report.to_markdown(results) if a.markdown else report.lines(results, a.verbose):
                print(line)
        return exit_code(results)
    finally:
        results.unpersist()


if __name__ == "__main__":
    sys.exit(main())
