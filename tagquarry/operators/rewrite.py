"""Changes of trees: each returns new ones, numbered anew, in the form it was given (trees, or rows of nodes).

Nodes keep the order of keys: a node's own key is its number, and what is inserted gets a key
between those of its neighbours, so an edit takes nodes away and adds others without touching
the rest, and one sort puts all in place. Their order and depths are a tree; `numbered` gets
parents, ends and ordinals back from these alone: by sorts, in which a node's place tells how
many of another kind come before it, and by pointers that jump. Documents without edits pass
through as they are, as rows without being gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans import folds
from ..plans.selectors import Compiled, subtrees
from .relation import NODE, TREE, Steps, as_trees, exploded, nearest, rebased


def grouped(name: str, rows: str, same: str) -> folds.Steps:
    """Steps for sorted rows (…, i): for each node i its rank in its group (from 0), the group's size, and the node before it there; by node."""
    first = f"k = 0 or not ({same})".replace("before.", f"{name}_rows[k - 1].")
    return [
        (f"{name}_rows", rows),
        (f"{name}_firsts", f"filter(transform({name}_rows, (e, k) -> if({first}, k, null)), k -> k is not null)"),
        (f"{name}_spans", f"flatten(transform({name}_firsts, (f, k) -> array_repeat(struct(f as low, coalesce(get({name}_firsts, k + 1), size({name}_rows)) as high), coalesce(get({name}_firsts, k + 1), size({name}_rows)) - f)))"),
        (name, f"""array_sort(transform({name}_rows, (e, k) -> struct(e.i as i, k - {name}_spans[k].low as rank, {name}_spans[k].high - {name}_spans[k].low as size,
            if(k > {name}_spans[k].low, {name}_rows[k - 1].i, null) as previous)))"""),
        (f"{name}_places", f"transform({name}, e -> e.i)"),
        (f"{name}_before", folds.ranks(f"{name}_places")),
    ]


def at(name: str) -> str:
    """What grouped() found of node i, or null."""
    return f"if({name}_before[i + 1] > {name}_before[i], {name}[{name}_before[i]], null)"


OWN = "x.kind in ('element', 'doctype') and ups[i] is not null"
NUMBERS: folds.Steps = [
    # nodes give themselves to their level and ask the level above; in order of levels, a question's place less the questions before it says which giver comes last before it
    ("levels", "array_sort(flatten(transform(tree, (x, i) -> array(struct(x.depth as level, i as i, 0 as asks), struct(x.depth - 1 as level, i as i, 1 as asks)))))"),
    ("givers", "transform(filter(levels, e -> e.asks = 0), e -> e.i)"),
    ("questions", "filter(transform(levels, (e, m) -> struct(e.i as i, e.asks as asks, e.level as level, m as m)), e -> e.asks = 1)"),
    ("ups", "transform(array_sort(transform(questions, (e, j) -> struct(e.i as i, if(e.level < 0, null, givers[e.m - j - 1]) as up))), e -> e.up)"),
    *grouped("family", "array_sort(transform(tree, (x, i) -> struct(coalesce(ups[i], -1) as up, i as i)))", "e.up = before.up"),
    ("nexts", "transform(array_sort(transform(family_rows, (e, k) -> struct(e.i as i, if(k + 1 < family_spans[k].high, family_rows[k + 1].i, null) as next))), e -> e.next)"),
    # a node ends before its next sibling, or else where its parent does
    ("ends", """transform(aggregate(sequence(1, coalesce(cast(ceil(log2(array_max(transform(tree, x -> x.depth)) + 2)) as int), 1)),
        transform(nexts, (v, i) -> struct(if(v is null, ups[i], null) as j, case when v is not null then v - 1 when ups[i] is null then size(tree) - 1 end as last)),
        (now, r) -> transform(now, c -> if(c.j is null, c, now[c.j]))), c -> c.last)"""),
    *grouped("elements", f"array_sort(filter(transform(tree, (x, i) -> if({OWN}, struct(ups[i] as up, i as i), null)), e -> e is not null))", "e.up = before.up"),
    *grouped("types", f"array_sort(filter(transform(tree, (x, i) -> if({OWN}, struct(ups[i] as up, x.lname as lname, i as i), null)), e -> e is not null))", "e.up = before.up and e.lname <=> before.lname"),
    ("holders", f"array_sort(array_distinct(filter(transform(tree, (x, i) -> if(x.kind in ('element', 'doctype') or x.kind = 'text' and {folds.stripped('x.data')} <> '', ups[i], null)), v -> v is not null)))"),
    ("holds", folds.scattered("holders")),
]
FIELDS = {
    "pre": "i", "last": "ends[i]", "parent": "if(x.kind = 'content', null, ups[i])", "host": "if(x.kind = 'content', ups[i], null)", "sib_idx": "if(x.kind = 'content' or ups[i] is null, 0, family[i].rank)",
    "elem_idx": f"{at('elements')}.rank + 1", "elem_ridx": f"({at('elements')}.size - {at('elements')}.rank)", "type_idx": f"{at('types')}.rank + 1", "type_ridx": f"({at('types')}.size - {at('types')}.rank)",
    "prev": f"{at('elements')}.previous", "is_top": "coalesce(x.kind <> 'content' and tree[ups[i]].kind in ('document', 'fragment', 'content'), false)", "is_empty": "not holds[i]",
}


def numbered(trees: DataFrame, keep: list[str], out: str = TREE) -> DataFrame:
    """Trees whose nodes are in order and have their depths, but numbers, parents and ordinals of before."""
    names = trees.schema[TREE].dataType.elementType.names
    fields = ", ".join(f"'{n}', {FIELDS.get(n, f'x.{n}')}" for n in names)
    return folds.folded(trees, keep, NUMBERS, f"transform(tree, (x, i) -> named_struct({fields}))", out)


def _like(found: DataFrame, trees: DataFrame, key: str) -> DataFrame:
    return trees if TREE in found.columns else exploded(trees, key)


def remove(found: DataFrame, selector: str, key: str) -> DataFrame:
    """Trees without the subtrees that match."""
    steps = Steps(found, key)
    gone = Compiled(selector, key).mark(steps)
    below = steps.add(nearest("parent", gone, hosts=True))
    kept = F.filter(TREE, lambda x: ~F.get(gone, x["pre"]) & F.get(below, x["pre"]).isNull())
    return _like(found, numbered(steps.trees.select(key, kept.alias(TREE)), [key]), key)


#: Steps before NUMBERS for a tree and its edits, in order.
EDITS: folds.Steps = [
    ("replaced", "array_sort(array_distinct(filter(transform(edits, e -> if(e.how = 'replace' and get(tree, e.at).parent is not null, e.at, null)), v -> v is not null)))"),
    ("gone", folds.scattered("replaced")),
    ("lower", folds.within("gone", True)),
    ("contents", "filter(tree, x -> x.host is not null)"),
]


def edited(found: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Trees after edits (key, at, how, tree, and ord, if their order matters): the nodes of `tree` (of relation.trees() of a fragment, or of subtrees()) are appended to node `at`, put before it, or replace it.

    Edits at one place take effect in the order of `ord`, or of `how`. Those of nodes that aren't there, or lie within what is replaced, have no effect; `before` and `replace` need a parent."""
    order = ["ord", "at", "how"] if "ord" in edits.columns else ["at", "how"]
    listed = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, TREE))).alias("edits"))
    rows = TREE not in found.columns
    touched = found.join(listed.select(key), key, "left_semi") if rows else found
    trees = as_trees(touched, key).join(listed, key, "left")
    element = trees.schema[TREE].dataType.elementType
    own = StructType.fromDDL(NODE).names
    node = ", ".join(f"'{f.name}', " + ("cast(top + y.depth - base as int)" if f.name == "depth" else f"y.{f.name}" if f.name in own else f"cast(null as {f.dataType.simpleString()})") for f in element.fields)
    place = f"""case when e.how <> 'append' then struct(x.pre as a, -1 as b, 0 as c)
        when exists(contents, c -> c.host = x.pre) then struct(filter(contents, c -> c.host = x.pre)[0].pre as a, -2 as b, 0 as c)
        else struct(x.last as a, 1 as b, -x.depth as c) end"""
    added = folds.let(
        [("top", "if(e.how = 'append', x.depth + 1, x.depth)"), ("base", "e.tree[0].depth + if(e.tree[0].kind in ('document', 'fragment'), 1, 0)"), ("place", place)],
        f"transform(filter(e.tree, y -> y.kind not in ('document', 'fragment')), (y, j) -> struct(place.a as a, place.b as b, place.c as c, k as k, j as j, named_struct({node}) as x))",
    )
    fits = "x is not null and not lower[x.pre] and if(e.how = 'append', not gone[x.pre], x.parent is not null)"
    kept = "transform(filter(tree, x -> not gone[x.pre] and not lower[x.pre]), x -> struct(x.pre as a, 0 as b, 0 as c, 0 as k, 0 as j, x as x))"
    all_added = f"flatten(transform(edits, (e, k) -> {folds.let([('x', 'get(tree, e.at)')], f'if({fits}, {added}, slice(kept, 1, 0))')}))"
    # of a document without edits nothing is looked at; only it keeps its old tree, as each step copies what is kept
    work = trees.select(key, F.expr(f"if(edits is null, {TREE}, null)").alias("whole"), "edits", F.expr(f"if(edits is null, slice({TREE}, 1, 0), {TREE})").alias(TREE))
    steps = [*EDITS, ("kept", kept), ("ordered", f"transform(array_sort(concat(kept, coalesce({all_added}, slice(kept, 1, 0)))), p -> p.x)")]
    ordered = folds.folded(work, [key, "whole", "edits"], steps, "ordered", TREE).drop("edits")
    done = numbered(ordered, [key, "whole"], "made").select(key, F.coalesce("whole", "made").alias(TREE))
    if not rows:
        return done
    return found.join(listed.select(key), key, "left_anti").unionByName(exploded(done, key).select(*found.columns))


def insert(found: DataFrame, added: DataFrame, key: str, before: bool = False) -> DataFrame:
    """Adds one childless node for each row of added: (key, at, kind, name, data, and ord, if their order matters), as the last child of node `at` or, with before, in front of it."""
    own = {"pre": F.lit(0), "depth": F.lit(0), "kind": F.col("kind"), "name": F.col("name"), "lname": F.lower("name"), "ns": F.when(F.col("kind") == "element", "html"), "attrs": F.array(), "data": F.col("data")}
    node = F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(NODE).fields])
    order = ["ord"] if "ord" in added.columns else []
    return edited(found, added.select(key, *order, "at", F.lit("before" if before else "append").alias("how"), F.array(node).alias(TREE)), key)


def set_text(nodes: DataFrame, where: Column, text: Column) -> DataFrame:
    """Rows of nodes, of which text rows that fit have another text."""
    return nodes.withColumn("data", F.when((F.col("kind") == "text") & where, text).otherwise(F.col("data")))


def set_attribute(nodes: DataFrame, where: Column, name: str, value: Column) -> DataFrame:
    """Rows of nodes with an attribute set, in place or at the end; a null value removes it."""
    others = F.filter("attrs", lambda a: a["name"] != name)
    one = F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    replaced = F.transform("attrs", lambda a: F.when(a["name"] == name, one).otherwise(a))
    has = F.exists("attrs", lambda a: a["name"] == name)
    new = F.when(value.isNull(), others).when(has, replaced).otherwise(F.concat("attrs", F.array(one)))
    return nodes.withColumn("attrs", F.when(where & (F.col("kind") == "element"), new).otherwise(F.col("attrs")))


def cloned(found: DataFrame, key: str, new_key: Column) -> DataFrame:
    """Copies of whole documents under other keys."""
    return found.withColumn(key, new_key)


def cloned_nodes(found: DataFrame, selector: str, key: str, deep: bool = True) -> DataFrame:
    """(key, pre, tree): a copy of each match as a tree of its own, with all below it or, deep=False, alone."""
    copies = rebased(subtrees(found, selector, key, deep))
    if deep:
        return copies
    return copies.withColumn(TREE, F.transform(TREE, lambda x: x.withField("last", F.lit(0)).withField("is_empty", F.lit(True))))
