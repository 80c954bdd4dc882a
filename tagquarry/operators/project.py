"""Trees to values: text, HTML, tree dump, Markdown.

All are expressions over `trees` (plans/folds.py has those that carry state along a tree);
rows of nodes are gathered by document first. What a selector matches is cut out as a tree
of its own and then treated like a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import folds
from ..plans.selectors import TextIndex, stripped, subtrees
from .relation import TREE, Options, Steps, as_trees, rebased, trees

__all__ = ["children", "compact_html", "escaped", "parents", "selected_html", "selected_markdown", "stripped", "texts", "to_html", "to_markdown", "tree_dump", "with_text"]


def texts(found: DataFrame, key: str, separator: str = " ", strip: bool = True, out: str = "text") -> DataFrame:
    """(key, text) of whole documents, script and template content included."""
    data = F.transform(F.filter(TREE, lambda x: x["kind"] == "text"), lambda x: stripped(x["data"]) if strip else x["data"])
    return as_trees(found, key).select(key, F.array_join(F.filter(data, lambda t: t != ""), separator).alias(out))


def with_text(found: DataFrame, key: str, out: str = "text", separator: str = " ", strip: bool = True) -> DataFrame:
    """All nodes, a row each, with the text of their subtrees; query(text=...) gives that of matches alone."""
    steps = Steps(found, key)
    texts = TextIndex(steps, separator, strip)
    return steps.trees.select(key, F.inline(F.transform(TREE, lambda x: x.withField(out, texts.of(x)))))


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def compact_html(found: DataFrame, key: str, out: str = "html") -> DataFrame:
    """(key, html) of whole documents, on one line; template content is left out."""
    return folds.folded(as_trees(found, key), [key], folds.CONTENT, folds.COMPACT, out)


def pretty_html(found: DataFrame, key: str, indent_size: int = 2, out: str = "pretty") -> DataFrame:
    """(key, pretty) of whole documents, indented."""
    return folds.folded(as_trees(found, key), [key], *folds.pretty(indent_size), out)


def markdown(found: DataFrame, key: str, out: str = "markdown") -> DataFrame:
    """(key, markdown) of whole documents."""
    return folds.folded(as_trees(found, key), [key], folds.MARKDOWN_STEPS, folds.MARKDOWN, out)


def tree_dump(found: DataFrame, key: str, out: str = "dump") -> DataFrame:
    """(key, dump): a line a node or attribute, as tree-construction tests write them."""
    def lines(x: Column) -> Column:
        pad = F.concat(F.lit("| "), F.repeat(F.lit("  "), x["depth"] - 1))
        foreign = F.coalesce(x["ns"].isin("svg", "math"), F.lit(False))
        space = F.when(foreign, F.concat(x["ns"], F.lit(" "))).otherwise("")
        ids = F.when(x["public_id"].isNotNull() | x["system_id"].isNotNull(), F.concat(F.lit(' "'), F.coalesce(x["public_id"], F.lit("")), F.lit('" "'), F.coalesce(x["system_id"], F.lit("")), F.lit('"'))).otherwise("")
        body = (
            F.when(x["kind"] == "element", F.concat(F.lit("<"), space, x["name"], F.lit(">")))
            .when(x["kind"] == "text", F.concat(F.lit('"'), x["data"], F.lit('"')))
            .when(x["kind"] == "comment", F.concat(F.lit("<!-- "), x["data"], F.lit(" -->")))
            .when(x["kind"] == "doctype", F.concat(F.lit("<!DOCTYPE "), x["data"], ids, F.lit(">")))
            .otherwise("content")
        )
        named = F.transform(x["attrs"], lambda a: F.struct(F.when(foreign & a["name"].rlike("^(xlink|xml|xmlns):"), F.regexp_replace(a["name"], "^([a-z]+):", "$1 ")).otherwise(a["name"]).alias("n"), a["value"].alias("v")))
        return F.concat(F.array(F.concat(pad, body)), F.transform(F.array_sort(named), lambda a: F.concat(pad, F.lit("  "), a["n"], F.lit('="'), a["v"], F.lit('"'))))

    kept = F.filter(TREE, lambda x: ~x["kind"].isin("document", "fragment"))
    return Steps(found, key).trees.select(key, F.array_join(F.flatten(F.transform(kept, lines)), "\n").alias(out))


def to_markdown(docs: DataFrame, key: str, column: str = "html", options: Options = Options(), out: str = "markdown") -> DataFrame:
    return markdown(trees(docs, key, column, options), key, out)


def to_html(docs: DataFrame, key: str, column: str = "html", options: Options = Options(), indent_size: int = 2, out: str = "pretty") -> DataFrame:
    """Indented HTML."""
    return pretty_html(trees(docs, key, column, options), key, indent_size, out)


def _selected(found: DataFrame, selector: str | None, key: str, out: str, steps: folds.Steps, value: str, options: dict) -> DataFrame:
    """(key, pre, out) of what a selector matches, or of whole documents."""
    some = rebased(subtrees(found, selector, key, **options)) if selector else as_trees(found, key).select(key, F.lit(0).alias("pre"), TREE)
    return folds.folded(some, [key, "pre"], steps, value, out)


def selected_html(found: DataFrame, selector: str | None, key: str, indent_size: int = 2, indented: bool = True, out: str = "html", **options) -> DataFrame:
    """(key, pre, html) of what a selector matches, indented or on one line."""
    return _selected(found, selector, key, out, *(folds.pretty(indent_size) if indented else (folds.CONTENT, folds.COMPACT)), options)


def selected_markdown(found: DataFrame, selector: str | None, key: str, out: str = "markdown", **options) -> DataFrame:
    return _selected(found, selector, key, out, folds.MARKDOWN_STEPS, folds.MARKDOWN, options)


def children(nodes: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is a row of `of`, with it as `of_pre`."""
    some = of.select(F.col(key).alias("__key"), F.col("pre").alias("of_pre"))
    return nodes.join(some, (F.col(key) == F.col("__key")) & (F.col("parent") == F.col("of_pre"))).drop("__key")


def parents(nodes: DataFrame, of: DataFrame, key: str) -> DataFrame:
    some = of.select(F.col(key).alias("__key"), F.col("pre").alias("of_pre"), F.col("parent").alias("__parent"))
    return nodes.join(some, (F.col(key) == F.col("__key")) & (F.col("pre") == F.col("__parent"))).drop("__key", "__parent")
