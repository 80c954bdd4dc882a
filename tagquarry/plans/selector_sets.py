"""Many selectors at once, from a table: an inverted index of selectors joined to the nodes of pages.

A selector that matches a node has in its last compound an id, an attribute's value, a class
or a tag that the node has. So each alternative of a selector is filed under the rarest kind
of these, each node under all that it has, and one join by that key gives the candidates. A
candidate is confirmed step by step in its document's tree: parents and siblings are looked
up, for a space or ~ the nodes on the way are tried, nearest first. So the work grows with
the candidates and their depth, not with selectors times nodes; only selectors that end in
nothing but `*`, pseudo-classes or other comparisons are tried on all elements.

Selectors are parsed in a task, a row each, to steps as data. Conditions are those of
selectors.py; :contains, and :not of more than one condition, need an expression of their
own and are rejected here, like bad syntax: such selectors have `error` set by `steps_of`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relation import TREE
from . import folds
from .selectors import EXTENSIONS, INDEXED, NTH, WS, Parser, SelectorError, Simple, nth

CONDITION = "struct<kind:string,name:string,op:string,value:string,a:int,b:int,negated:boolean>"
STEPS = f"array<struct<combinator:string,conditions:array<{CONDITION}>>>"


def conditions(simple: Simple, negated: bool = False) -> list[tuple]:
    """A simple selector as data: (kind, name, op, value, a, b, negated). Ordinals are kind `nth`: name is a field that a * n + b gives."""
    def one(kind: str, name: str = "", op: str = "", value: str | None = None, a: int = 0, b: int = 0) -> tuple:
        return kind, name, op, value, a, b, negated

    if simple.kind != "pseudo":
        return [one(simple.kind, simple.name, simple.op, simple.value)]
    if simple.name in INDEXED:
        if negated and len(INDEXED[simple.name]) > 1:
            raise SelectorError(f":not(:{simple.name}) in a set")
        return [one("nth", field, b=1) for field in INDEXED[simple.name]]
    if simple.name in NTH or simple.name in EXTENSIONS:
        found = nth(simple.value)
        return [one("nth", (NTH | EXTENSIONS)[simple.name], a=found[0], b=found[1]) if found else one("never")]
    if simple.name in ("empty", "root"):
        return [one(simple.name)]
    if simple.name == "not" and not negated:
        if not simple.value:
            return []
        inner = Parser(simple.value).parse()
        if any(c.combinators or len(c.compounds[0]) != 1 for c in inner):
            raise SelectorError(":not of more than one condition in a set")
        return [x for c in inner for x in conditions(c.compounds[0][0], True)]
    raise SelectorError(f":{simple.name} in a set")


def filed(last: list[tuple]) -> str:
    """The key of a compound: an id, an attribute's value, a class, a tag, or nothing."""
    keys = {}
    for kind, name, op, value, _, _, negated in last:
        if negated:
            continue
        if kind in ("id", "class", "tag"):
            keys.setdefault(kind, f"{kind} {name}")
        elif kind == "attr" and op == "=":
            keys.setdefault("attr", f"attr {name.lower()} {value}")
    return next((keys[k] for k in ("id", "attr", "class", "tag") if k in keys), "any")


def steps_of(selectors: DataFrame, name: str, text: str) -> DataFrame:
    """(name, key, steps, error): a row for each alternative of a selector, its steps from the last one on; or one with an error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for label, selector in zip(b[name], b[text]):
                try:
                    for c in Parser(selector or "").parse():
                        steps = [[x for s in compound for x in conditions(s)] for compound in c.compounds]
                        joined = list(zip([*c.combinators[::-1], ""], steps[::-1]))
                        rows.append((label, filed(steps[-1]), [{"combinator": k, "conditions": [dict(zip(("kind", "name", "op", "value", "a", "b", "negated"), x)) for x in s]} for k, s in joined], None))
                except SelectorError as e:
                    rows.append((label, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[name, "key", "steps", "error"])

    return selectors.select(name, text).mapInPandas(run, f"`{name}` {selectors.schema[name].dataType.simpleString()}, key string, steps {STEPS}, error string")


#: What a node is filed under.
KEYS = f"""array_distinct(concat(array('any', concat('tag ', x.lname)), flatten(transform(x.attrs, a -> concat(array(concat('attr ', lower(a.name), ' ', a.value)),
    case a.name when 'id' then array(concat('id ', a.value)) when 'class' then transform(filter(split(a.value, r'[{WS}]+'), w -> w <> ''), w -> concat('class ', w)) else array() end)))))"""

VALUE = "get(filter(x.attrs, a -> {0}), 0).value"
#: Whether node x meets condition c.
MEETS = f"""coalesce(case c.kind
    when 'any' then true when 'tag' then x.lname = c.name when 'id' then {VALUE.format("a.name = 'id'")} = c.name
    when 'class' then array_contains(split({VALUE.format("a.name = 'class'")}, r'[{WS}]+'), c.name) and c.name <> ''
    when 'nth' then {{ordinal}} when 'empty' then x.is_empty when 'root' then x.is_top
    when 'attr' then {folds.let([("v", VALUE.format("lower(a.name) = lower(c.name)"))], f'''case c.op
        when '' then v is not null when '=' then v = c.value when '~=' then array_contains(split(v, r'[{WS}]+'), c.value) and c.value <> ''
        when '|=' then v = c.value or startswith(v, concat(c.value, '-')) when '^=' then c.value <> '' and startswith(v, c.value)
        when '$=' then c.value <> '' and endswith(v, c.value) else c.value <> '' and contains(v, c.value) end''')}
    else false end, false) <> c.negated""".replace(
    "{ordinal}", folds.let([("i", "case c.name when 'elem_idx' then x.elem_idx when 'elem_ridx' then x.elem_ridx when 'type_idx' then x.type_idx else x.type_ridx end - c.b")], "if(c.a = 0, i = 0, i % c.a = 0 and i * sign(c.a) >= 0)")
)
FITS = f"x.kind in ('element', 'doctype') and forall({{0}}, c -> {MEETS})"
#: Nodes from one on along `parent` or `prev`, nearest first.
WAY = "filter(aggregate(sequence(1, greatest(tree[{0}].{2}, 1)), array({0}), (w, k) -> concat(w, array(tree[element_at(w, -1)].{1}))), (j, k) -> k > 0 and j is not null)"
NEXT = f"""aggregate(slice(s.steps, 2, size(s.steps)), struct(s.pre as at, s.steps[0].combinator as way), (now, step) -> struct(case
    when now.at is null then null
    when now.way = '>' then get(filter(filter(array(tree[now.at].parent), j -> j is not null), j -> {{fits}}), 0)
    when now.way = '+' then get(filter(filter(array(tree[now.at].prev), j -> j is not null), j -> {{fits}}), 0)
    when now.way = ' ' then get(filter({WAY.format('now.at', 'parent', 'depth')}, j -> {{fits}}), 0)
    else get(filter({WAY.format('now.at', 'prev', 'sib_idx')}, j -> {{fits}}), 0) end as at, step.combinator as way)).at is not null""".replace(
    "{fits}", folds.let([("x", "tree[j]")], FITS.format("step.conditions"))
)


def matched(trees: DataFrame, selectors: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """(key, pre, name) of all nodes of trees that the selectors of a table (name, text) match, once each. Selectors with an error match nothing."""
    steps = steps_of(selectors, name, text).where("error is null").select(name, F.col("key").alias("__key"), "steps")
    nodes = trees.select(key, F.inline(F.filter(TREE, lambda x: x["kind"].isin("element", "doctype"))))
    filed_nodes = nodes.select(key, "pre", F.explode(F.expr(KEYS.replace("x.", ""))).alias("__key"))
    candidates = filed_nodes.join(steps, "__key").groupBy(key).agg(F.collect_list(F.struct("pre", F.col(name).alias("label"), "steps")).alias("some"))
    whole = candidates.join(trees.select(key, F.col(TREE).alias("tree")), key)
    sure = f"filter(some, s -> {folds.let([('x', 'tree[s.pre]')], FITS.format('s.steps[0].conditions'))} and {NEXT})"
    found = folds.folded(whole, [key, "some"], [], sure, "sure")
    return found.select(key, F.inline(F.expr("array_distinct(transform(sure, s -> struct(s.pre as pre, s.label as label)))"))).withColumnRenamed("label", name)
