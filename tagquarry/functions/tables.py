"""Table functions over documents: html_events and parse_html, whose columns follow from their arguments.

    select * from docs, lateral html_events(docs.html)
    select * from html_events(table(docs), column => 'html')
    select * from parse_html(table(docs), column => 'html', keys => 'url, fetched', fields => 'pre, lname, attrs')
    select * from parse_html(table(parts), column => 'part', keys => 'url', pieces => 'at')

Of a table each row is a document. Its columns named in `keys`, or all others, come back before the function's own, of which
`fields` names those that are wanted; only the columns named are handed to Python. With `pieces`, the rows that agree in their
keys are pieces of one document, joined in the order of that column: Spark partitions and sorts by them, and a document must fit
a task. A null document or piece is empty. Names that the table has not got, that no field has, or that would occur twice are
errors of analysis. An empty table has no rows, and rows of nulls are documents like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from ..operators.relation import EVENT, NODE, events_of, flat
from ..operators.treebuilder import parse
from .encoding import decode


@dataclass
class Plan(AnalyzeResult):
    """What analysis has found out: how many keys stand before the document, and the fields after them."""

    keys: int = 0
    fields: list[str] = field(default_factory=list)


def names(listed: AnalyzeArgument | None) -> list[str] | None:
    """Names in a constant like 'a, `b c`', or None."""
    if listed is None or listed.value is None:
        return None
    return [m[1].replace("``", "`") if m[1] is not None else m[2] for m in re.finditer(r"`((?:[^`]|``)*)`|([^,`\s]+)", listed.value)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def of_table(schema: StructType, wanted: list[str], what: str) -> list[str]:
    """The table's own spelling of names."""
    own = {n.lower(): n for n in schema.fieldNames()}
    if missing := [n for n in wanted if n.lower() not in own]:
        raise ValueError(f"{what}: the table has no column {missing[0]}")
    return [own[n.lower()] for n in wanted]


def analyzed(kind: StructType, html: AnalyzeArgument, column, keys, fields, pieces) -> Plan:
    wanted = names(fields) or kind.fieldNames()
    if unknown := [n for n in wanted if n not in kind.fieldNames()]:
        raise ValueError(f"fields: there is no {unknown[0]}, only {', '.join(kind.fieldNames())}")
    own = [kind[n] for n in wanted]
    if not html.isTable:
        if any(names(x) for x in (column, keys, pieces)):
            raise ValueError("column, keys and pieces are for tables")
        return Plan(StructType(own), fields=wanted)
    table = html.dataType
    document = of_table(table, names(column) or ["html"], "column")
    order = of_table(table, names(pieces) or [], "pieces")
    if len(document) > 1 or len(order) > 1:
        raise ValueError("column and pieces name one column each")
    if table[document[0]].dataType not in (StringType(), BinaryType()):
        raise ValueError("column: documents are strings or bytes")
    before = of_table(table, names(keys), "keys") if names(keys) else [n for n in table.fieldNames() if n not in document + order]
    if order and not before:
        raise ValueError("pieces: there is no key to join them by")
    lower = [n.lower() for n in before + wanted]
    if twice := [n for n in lower if lower.count(n) > 1]:
        raise ValueError(f"the column {twice[0]} would occur twice; name others in keys or fields")
    handed = list(dict.fromkeys(before + document + order))
    return Plan(
        StructType([table[n] for n in before] + own),
        partitionBy=[PartitioningColumn(quoted(n)) for n in before] if order else [],
        orderBy=[OrderingColumn(quoted(n)) for n in order],
        select=[SelectedColumn(quoted(n)) for n in handed],
        keys=handed.index(document[0]) if document[0] in before else len(before),
        fields=wanted,
    )


class Documents:
    """Documents to rows of a function, of which those of a table carry their keys."""

    def __init__(self, plan: Plan):
        self.plan, self.n = plan, len(plan.schema.fields) - len(plan.fields)
        self.key, self.parts = None, []

    def own(self, document) -> Iterator[tuple]:
        html = decode(bytes(document))[0] if isinstance(document, (bytes, bytearray)) else document
        for r in self.rows_of(html):
            yield tuple([(a["name"], a["value"]) for a in r[n]] if n == "attrs" and r[n] is not None else r[n] for n in self.plan.fields)

    def eval(self, html, column=None, keys=None, fields=None, pieces=None):
        if not self.plan.select:
            yield from self.own(html)
        elif self.plan.orderBy:
            self.key = tuple(html[: self.n])
            self.parts.append(html[self.plan.keys])
        else:
            for row in self.own(html[self.plan.keys]):
                yield tuple(html[: self.n]) + row

    def terminate(self):
        if self.parts:
            given = [p for p in self.parts if p is not None]
            for row in self.own((b"" if given and not isinstance(given[0], str) else "").join(given)):
                yield self.key + row


def function(kind: str, rows_of):
    """A table function of a kind of rows. Spark analyses calls in a worker, which reads no DDL, so a session must be there before."""
    schema = StructType.fromDDL(kind)

    class Rows(Documents):
        @staticmethod
        def analyze(html: AnalyzeArgument, column: AnalyzeArgument = None, keys: AnalyzeArgument = None, fields: AnalyzeArgument = None, pieces: AnalyzeArgument = None) -> Plan:
            return analyzed(schema, html, column, keys, fields, pieces)

    Rows.rows_of = staticmethod(rows_of)
    return F.udtf(Rows)


def html_events():
    return function(EVENT, events_of)


def parse_html():
    return function(NODE, lambda html: flat(parse(html)[0]))
