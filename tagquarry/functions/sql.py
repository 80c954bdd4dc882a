"""Functions for SQL: html_unescape, html_unescape_attribute, html_to_text, html_to_markdown, and the table functions html_events and parse_html.

html_tree parses in Python; text and Markdown are SQL functions over what it gives, and references are SQL alone. As Spark
analyses html_to_markdown for very long beside another function that runs in Python, give it a SELECT of its own.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.relation import NODE, flat
from ..operators.treebuilder import parse
from ..plans import folds
from . import tables
from .references import unescaped

#: The type of relation.TREE.
TREE_TYPE = f"array<struct<{NODE}>>"
#: Steps that one SQL function takes: Spark's analysis of lambdas within lambdas takes too long for more.
NESTED = 3


def html_tree(html: pd.Series) -> pd.Series:
    return html.map(lambda h: flat(parse(h)[0]))


def of_tree(spark: SparkSession, name: str, steps: folds.Steps, value: str) -> None:
    """A SQL function of html for a value of its tree: functions of some steps each, that hand on a struct of what has been computed."""
    made = spark.createDataFrame([], f"tree {TREE_TYPE}")
    call, known = "named_struct('tree', html_tree(html))", [("tree", TREE_TYPE)]

    def kind(fields: list[tuple[str, str]]) -> str:
        return "struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">"

    def of_struct(sql: str) -> str:
        return re.sub(r"(?<!['.\w])(" + "|".join(n for n, _ in known) + r")(?!['\w])", r"so_far.\1", sql)

    for at in range(0, len(steps), NESTED):
        part = steps[at : at + NESTED]
        for step, sql in part:
            made = made.select("*", F.explode(F.array(F.expr(sql))).alias(step))
        new = [(step, made.schema[step].dataType.simpleString()) for step, _ in part]
        fields = [f"'{n}', so_far.{n}" for n, _ in known] + [f"'{n}', {n}" for n, _ in new]
        body = folds.let([(step, of_struct(sql)) for step, sql in part], f"named_struct({', '.join(fields)})")
        spark.sql(f"create or replace temporary function {name}_{at}(so_far {kind(known)}) returns {kind(known + new)} return {body}")
        known += new
        call = f"{name}_{at}({call})"
    spark.sql(f"create or replace temporary function {name}_value(so_far {kind(known)}) returns string return {of_struct(value)}")
    spark.sql(f"create or replace temporary function {name}(html string) returns string return {name}_value({call})")


def register(spark: SparkSession) -> None:
    for name, attribute in (("html_unescape", False), ("html_unescape_attribute", True)):
        spark.sql(f"create or replace temporary function {name}(text string) returns string return {unescaped('text', attribute)}")
    spark.udf.register("html_tree", F.pandas_udf(html_tree, TREE_TYPE))
    of_tree(spark, "html_to_text", [], folds.plain_text())
    of_tree(spark, "html_to_markdown", folds.MARKDOWN_STEPS, folds.MARKDOWN)
    spark.udtf.register("html_events", tables.html_events())
    spark.udtf.register("parse_html", tables.parse_html())
