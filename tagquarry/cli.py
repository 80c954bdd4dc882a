"""Command line: query HTML files, or standard input (-), with a selector."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.project import selected_html, selected_markdown, texts
from .operators.relation import Options, trees
from .plans.selectors import SelectorError, first, query
from .sources.readers import files, joined, write_text

VERSION = "0.1.0"


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tagquarry", description=__doc__)
    p.add_argument("path", nargs="?")
    p.add_argument("--selector")
    p.add_argument("--format", choices=("html", "text", "markdown"), default="html")
    p.add_argument("--first", action="store_true")
    p.add_argument("--fragment", action="store_true")
    p.add_argument("--separator", default=" ")
    p.add_argument("--strip", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--output", help="a folder for a text file a partition, instead of standard output")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    if not a.path:
        arguments().print_help(sys.stderr)
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    options = Options(fragment=("div", None) if a.fragment else None)
    docs = spark.createDataFrame([("-", sys.stdin.buffer.read())], "path string, content binary") if a.path == "-" else files(spark, a.path)
    found = trees(docs, "path", "content", options)
    try:
        if a.format == "text":
            rows = query(found, a.selector, "path", text="out", separator=a.separator, strip=a.strip) if a.selector else texts(found, "path", a.separator, a.strip, "out").withColumn("pre", F.lit(0))
        elif a.format == "markdown":
            rows = selected_markdown(found, a.selector, "path", "out")
        else:
            rows = selected_html(found, a.selector, "path", out="out")
    except SelectorError as e:
        print(e, file=sys.stderr)
        return 2
    rows = rows.select("path", "pre", "out")
    if a.first:
        rows = first(rows, "path")
    separator = "\n\n" if a.format == "markdown" else "\n"
    if a.output:
        write_text(joined(rows, "path", "pre", "out", a.format == "markdown"), a.output)
        return 1 if spark.read.text(a.output).isEmpty() else 0
    results = (r["out"] for r in rows.orderBy("path", "pre").toLocalIterator())
    if (one := next(results, None)) is None:
        return 1
    print(one, end="")
    for r in results:
        print(separator + r, end="")
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
