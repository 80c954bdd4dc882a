"""A parsed tree as rows in preorder, and the parse operators that make them.

A document's nodes are numbered in preorder (children, then a template's content); a
node's descendants are those with pre in (pre, last]. `trees` is a row a document, its
nodes in one array in that order, so that `tree[pre]` is a node and `parent` and `prev`
(the sibling element before) are places in it; `nodes` is a row a node. One Arrow pass
parses each document once; everything after it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructType

from ..functions import charsets
from ..functions.encoding import decoded_as
from .tokenizer import Token, Tokenizer
from .treebuilder import Node, parse

NODE = (
    "pre int, last int, parent int, host int, depth int, sib_idx int, elem_idx int, elem_ridx int, type_idx int, type_ridx int, prev int, kind string, name string, lname string, ns string, "
    "attrs array<struct<name:string,value:string>>, data string, public_id string, system_id string, is_top boolean, is_empty boolean"
)
ERROR = "ord int, source string, code string, line int, col int"
EVENT = "ord int, event string, name string, attrs array<struct<name:string,value:string>>, data string, public_id string, system_id string"
#: Documents that Spark hands to Python at a time, and nodes in a batch that goes back.
DOCS, ROWS = 64, 20_000
#: The column of trees.
TREE = "tree"


@dataclass(frozen=True)
class Options:
    """How to parse. fragment: (context tag, None | 'svg' | 'math'). strict: documents with errors are rejected."""

    fragment: tuple[str, str | None] | None = None
    srcdoc: bool = False
    xml: bool = False
    keep_bom: bool = False
    strict: bool = False
    #: The encoding that came with the bytes.
    transport: str | None = None


def related(rows: list[dict]) -> list[dict]:
    """Rows in preorder, whose pre, parent, host, kind, lname and data are right, with all that follows from these."""
    children: dict[int, list[dict]] = {}
    for r in rows:
        up = r["parent"] if r["parent"] is not None else r["host"]
        r.update(last=r["pre"], depth=0 if up is None else rows[up]["depth"] + 1, sib_idx=0, elem_idx=None, elem_ridx=None, type_idx=None, type_ridx=None, prev=None, is_empty=True)
        r["is_top"] = r["parent"] is not None and rows[r["parent"]]["kind"] in ("document", "fragment", "content")
        if r["parent"] is not None:
            children.setdefault(r["parent"], []).append(r)
    for r in reversed(rows):
        up = r["parent"] if r["parent"] is not None else r["host"]
        if up is not None:
            rows[up]["last"] = max(rows[up]["last"], r["last"])
    for parent, every in children.items():
        own = [r for r in every if r["kind"] in ("element", "doctype")]
        rows[parent]["is_empty"] = not own and not any(r["kind"] == "text" and r["data"].strip() for r in every)
        for i, r in enumerate(every):
            r["sib_idx"] = i
        types: dict[str, list[dict]] = {}
        for i, r in enumerate(own):
            r["elem_idx"], r["elem_ridx"], r["prev"] = i + 1, len(own) - i, own[i - 1]["pre"] if i else None
            types.setdefault(r["lname"], []).append(r)
        for same in types.values():
            for i, r in enumerate(same):
                r["type_idx"], r["type_ridx"] = i + 1, len(same) - i
    return rows


def flat(root: Node) -> list[dict]:
    rows: list[dict] = []
    todo: list = [(root, None, None)]
    while todo:
        n, parent, host = todo.pop()
        pre, doctype = len(rows), n.kind == "doctype"
        rows.append({
            "pre": pre, "parent": parent, "host": host, "kind": n.kind, "name": n.name, "lname": n.name.lower(), "ns": n.ns if n.kind == "element" else None, "attrs": [{"name": k, "value": v} for k, v in n.attrs.items()],
            "data": (n.data.name or "") if doctype else n.data, "public_id": n.data.public if doctype else None, "system_id": n.data.system if doctype else None,
        })
        if n.content is not None:
            todo.append((n.content, None, pre))
        todo += [(c, pre, None) for c in reversed(n.children)]
    return related(rows)


def found_errors(builder) -> list[dict]:
    """Those of the tokenizer first, then those of the tree builder."""
    out = []
    for source, found in (("tokenizer", builder.tokens.errors), ("treebuilder", builder.errors)):
        for code, at in found:
            line, col = builder.tokens.place(at)
            out.append({"ord": len(out), "source": source, "code": code, "line": line, "col": col})
    return out


def _html(value) -> tuple[str | None, str | None]:
    """Text and, of what was bytes, encoding."""
    if not isinstance(value, dict):
        return value, None
    return value["text"] if value["rest"] is None else decoded_as(value["rest"], value["encoding"]), value["encoding"]


def events_of(html: str | None, keep_bom: bool = False, xml: bool = False) -> list[dict]:
    """Tokens as events, without a tree: no implied tags, all end tags. Runs of text between tags are one event each."""
    tokens, out = Tokenizer(html, keep_bom=keep_bom, xml=xml), []
    while (t := tokens.next()).type != "eof":
        tokens.foreign = False
        event = {"ord": len(out), "event": t.type, "name": t.name if t.type in ("start", "end", "doctype") else None, "attrs": None, "data": t.data, "public_id": t.public, "system_id": t.system}
        if t.type == "start":
            event["attrs"] = [{"name": k, "value": v} for k, v in t.attrs.items()]
        out.append(event)
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = DOCS) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few documents and what becomes of them are held at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _exploded(docs: DataFrame, key: str, column: str, schema: str | StructType, rows_of, options: Options) -> DataFrame:
    """A Python pass over (key, column): the rows that rows_of gives for each document, behind its key. Bytes are decoded before, by expressions as far as these can."""
    whole = StructType([docs.schema[key], *(StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields])
    arrow = to_arrow_schema(whole)
    names = [f.name for f in whole.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows: list[dict] = []
            size = 0
            for k, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in rows_of(value):
                    r[names[0]] = k
                    rows.append(r)
                    size += len(r[TREE]) if TREE in r else 1
                if size >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    docs = docs.select(key, column)
    if docs.schema[column].dataType == BinaryType():
        label = F.lit(options.transport).cast(StringType())
        docs = charsets.with_text(docs.withColumn("__label", label), column, "__decoded", "__label", python=False).select(key, "__decoded")
    return docs.mapInArrow(run, whole)


def _parsed(value, o: Options):
    return parse(_html(value)[0], fragment=o.fragment, srcdoc=o.srcdoc, xml=o.xml, keep_bom=o.keep_bom)


def trees(docs: DataFrame, key: str, column: str = "html", options: Options = Options()) -> DataFrame:
    """(key, tree) of each document's text or bytes; null is the empty document. Strict: documents with errors have no row."""
    def rows_of(value):
        root, builder = _parsed(value, options)
        if options.strict and (builder.tokens.errors or builder.errors):
            return []
        return [{TREE: flat(root)}]

    return _exploded(docs, key, column, f"{TREE} array<struct<{_typed(NODE)}>>", rows_of, options)


def _typed(ddl: str) -> str:
    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def nodes(docs: DataFrame, key: str, column: str = "html", options: Options = Options()) -> DataFrame:
    """(key, NODE), a row a node."""
    return exploded(trees(docs, key, column, options), key)


def exploded(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, F.inline(TREE))


def as_trees(found: DataFrame, key: str) -> DataFrame:
    """Trees as they are; rows of nodes gathered by document, in order."""
    if TREE in found.columns:
        return found
    others = [c for c in found.columns if c not in (key, "pre")]
    return found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pre", *others))).alias(TREE))


class Steps:
    """Trees to which arrays are added, a value a node each, one after the other.

    Each is a Generate of its own: as columns of projections, which Spark merges, an array that a lambda looks at would be computed anew for each element."""

    def __init__(self, found: DataFrame, key: str):
        self.trees, self.key, self.n = as_trees(found, key), key, 0
        if TREE not in found.columns:
            self.trees = self.trees.select(key, F.explode(F.array(TREE)).alias(TREE))

    def add(self, value: Column) -> Column:
        self.n += 1
        name = f"__step{self.n}"
        self.trees = self.trees.select("*", F.explode(F.array(value)).alias(name))
        return F.col(name)

    def last(self) -> str:
        """The name of the column that was added last, for SQL text."""
        return f"__step{self.n}"


def nearest(start: str, hit: Column, hosts: bool = False) -> Column:
    """For each node of a tree, the first one with `hit` (an array of booleans by place) on the way along `start` (parent or prev), or null. hosts: from a template's content on to the template.

    All pointers jump at once, each as far as the one it points at, until they stand on hits; so the rounds are the logarithm of the longest way."""
    way = F.array_max(F.transform(TREE, lambda x: x["depth" if start == "parent" else "sib_idx"]))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(way + 2)).cast("int"))
    first = F.transform(TREE, lambda x: F.coalesce(x[start], x["host"]) if hosts else x[start])
    return F.aggregate(rounds, first, lambda now, _: F.transform(now, lambda j: F.when(j.isNull() | F.get(hit, j), j).otherwise(F.get(now, j))))


def rebased(some: DataFrame) -> DataFrame:
    """(…, pre, tree) of subtrees() as trees of their own: numbered from 0, with a root that has no parent and no siblings."""
    def own(x: Column, name: str, start: Column) -> Column:
        return F.when(x[name] >= start, x[name] - start)

    def moved(x: Column) -> Column:
        start, root = F.col("pre"), x["pre"] == F.col("pre")
        new = {"pre": x["pre"] - start, "last": x["last"] - start, "depth": x["depth"] - F.get(TREE, F.lit(0))["depth"], "sib_idx": F.when(root, 0).otherwise(x["sib_idx"]), "is_top": x["is_top"] & ~root}
        new |= {n: own(x, n, start) for n in ("parent", "host")} | {"prev": F.when(~root, x["prev"] - start)}
        for name, value in (new | {n: F.when(~root, x[n]) for n in ("elem_idx", "elem_ridx", "type_idx", "type_ridx")}).items():
            x = x.withField(name, value)
        return x

    return some.withColumn(TREE, F.transform(TREE, moved))


def errors(docs: DataFrame, key: str, column: str = "html", options: Options = Options()) -> DataFrame:
    return _exploded(docs, key, column, ERROR, lambda v: found_errors(_parsed(v, options)[1]), options)


def events(docs: DataFrame, key: str, column: str = "html", options: Options = Options()) -> DataFrame:
    return _exploded(docs, key, column, EVENT, lambda v: events_of(_html(v)[0], options.keep_bom, options.xml), options)


def documents(docs: DataFrame, key: str, column: str = "html", transport: str | None = None, options: Options = Options(), text: bool = True) -> DataFrame:
    """A row a document: status (ok, or rejected by strict), encoding, quirks, errors and, with text, decoded text."""
    options = replace(options, transport=transport or options.transport)

    def rows_of(value):
        html, encoding = _html(value)
        _, builder = parse(html, fragment=options.fragment, srcdoc=options.srcdoc, xml=options.xml, keep_bom=options.keep_bom)
        found = found_errors(builder)
        return [{"status": "rejected" if options.strict and found else "ok", "encoding": encoding, "quirks": builder.quirks, "n_errors": len(found), "first_error": found[0]["code"] if found else None} | ({"text": html} if text else {})]

    return _exploded(docs, key, column, "status string, encoding string, quirks string, n_errors int, first_error string" + ", text string" * text, rows_of, options)


def attribute(name: str, exact: bool = False, attrs: Column | None = None) -> Column:
    """The value of an attribute, or null. attrs: of another node than the row's."""
    attrs = F.col("attrs") if attrs is None else attrs
    own = (lambda a: a["name"] == name) if exact else (lambda a: F.lower(a["name"]) == name.lower())
    return F.get(F.filter(attrs, own), F.lit(0))["value"]


def highlighted(found: DataFrame, docs: DataFrame, key: str, column: str = "html") -> DataFrame:
    """Errors with the line of text they stand in (err_text), and the range there to point at: columns `offset` up to, but not with, `end_offset`, from 1.

    The range is the tag around the error: it begins with a `<` at most ten characters before, or else at the error, and ends with the next `>`, or else with the line."""
    line = F.get(F.split(F.regexp_replace(F.col(column), "\r\n?", "\n"), "\n", -1), F.col("line") - 1)
    # from the last < before the error on
    tag = "length(left(err_text, col - 1)) - instr(reverse(left(err_text, col - 1)), '<') + 1"
    near = f"contains(left(err_text, col - 1), '<') and col - 1 - ({tag}) <= 10"
    offset = f"case when err_text is null then null when substr(err_text, col, 1) <> '<' and {near} then {tag} else col end"
    end = "case when locate('>', err_text, col) > 0 then locate('>', err_text, col) + 1 else greatest(length(err_text) + 1, col) end"
    lines = found.join(docs.select(key, column), key).withColumn("err_text", line).drop(column)
    return lines.withColumns({"offset": F.expr(offset), "end_offset": F.when(F.col("err_text").isNotNull(), F.expr(end))})
