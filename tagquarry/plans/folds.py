"""Values of whole trees as SQL expressions: HTML on one line, indented HTML, Markdown, text.

A value is a list of named steps, each over those before it, and an expression over them.
`folded` computes the steps one after the other, each once; `let` makes one expression of
them, which Spark analyses in reasonable time for few steps only. They read a column or step
`tree` (relation.NODE structs in preorder) and nothing else. All take time linear in the
nodes, but for sorting and for pointers that jump along ancestors in rounds (the logarithm
of the depth).

Places: of the 2 n beginnings and ends of n nodes in document order, a node of preorder
number p at depth d begins at 2 p - d and ends at 2 last - d + 1. So what a subtree gives is
a slice.

Markdown is seen as hard pieces (words, marks) with gaps between them. What stands between
two hard pieces - white space, line breaks, beginnings and ends of blocks - are weak events,
and a gap is a fold over these alone. A gap at the beginning or end of a quotation falls
away, and so do events deeper within quotations than the gap's shallowest place: that is how
quotations are trimmed, without taking them apart. Lines get the marks of the quotations
that they stand in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.treebuilder import SPECIAL, VOID

Steps = list[tuple[str, str]]

#: What str.strip() takes for white space, as a SQL literal.
BLANKS = "'" + "".join(f"\\u{n:04x}" for n in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + "'"


def let(steps: Steps, value: str) -> str:
    for name, sql in reversed(steps):
        value = f"transform(array({sql}), {name} -> {value})[0]"
    return value


def folded(trees: DataFrame, keep: list[str], steps: Steps, value: str, out: str) -> DataFrame:
    """The columns `keep` of trees, and a value of each tree.

    Each step is a Generate of its own: of columns of projections, which Spark merges, those within lambdas would be computed for each element anew."""
    for name, sql in [("tree", "tree"), *steps]:
        trees = trees.select("*", F.explode(F.array(F.expr(sql))).alias(name)) if name != "tree" else trees.select(*keep, F.explode(F.array("tree")).alias("tree"))
    return trees.select(*keep, F.expr(value).alias(out))


def names(some) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(some)) + ")"


def nearest(hit: str, hosts: bool = False) -> str:
    """For each node the first ancestor with `hit` (an array of booleans), or null. hosts: from a template's content on to the template."""
    up = "coalesce(x.parent, x.host)" if hosts else "x.parent"
    rounds = "sequence(1, cast(ceil(log2(array_max(transform(tree, x -> x.depth)) + 2)) as int))"
    return f"aggregate({rounds}, transform(tree, x -> {up}), (now, r) -> transform(now, j -> if(j is null or get({hit}, j), j, get(now, j))))"


def within(hit: str, hosts: bool = False) -> str:
    """Whether each node has an ancestor with `hit`; where no node has it, none is looked for."""
    return f"if(exists({hit}, v -> v), transform({nearest(hit, hosts)}, j -> j is not null), array_repeat(false, size(tree)))"


def scattered(places: str) -> str:
    """For each node whether `places`, sorted and distinct, has it."""
    fill = "array_repeat(false, {0} - coalesce(get({1}, {2}), -1) - 1)"
    some = f"flatten(transform({places}, (v, i) -> concat({fill.format('v', places, 'i - 1')}, array(true))))"
    return f"concat({some}, {fill.format('size(tree)', places, f'size({places}) - 1')})"


def ranks(places: str) -> str:
    """For each node, and one more, how many of `places` (sorted and distinct) come before it."""
    return f"flatten(transform(sequence(0, size({places})), k -> array_repeat(k, coalesce(get({places}, k), size(tree)) - coalesce(get({places}, k - 1), -1))))"


def stripped(text: str) -> str:
    return f"trim(both {BLANKS} from {text})"


def escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


ATTRIBUTE = r"""concat(' ', a.name, case
    when coalesce(a.value, '') = '' then ''
    when not rlike(a.value, '[> "\'=\t\n\f\r]') then concat('=', replace(a.value, '&', '&amp;'))
    when contains(a.value, '"') and not contains(a.value, '\'') then concat('=\'', replace(a.value, '&', '&amp;'), '\'')
    else concat('="', replace(replace(a.value, '&', '&amp;'), '"', '&quot;'), '"') end)""".replace("\\f", "\\u000c")
START_TAG = f"concat('<', x.name, array_join(transform(x.attrs, a -> {ATTRIBUTE}), ''), '>')"
BEGIN = f"""case x.kind when 'element' then {START_TAG} when 'text' then {escaped("coalesce(x.data, '')")}
    when 'comment' then concat('<!--', coalesce(x.data, ''), '-->') when 'doctype' then '<!DOCTYPE html>' else '' end"""
END = f"if(x.kind = 'element' and x.name not in {names(VOID)}, concat('</', x.name, '>'), '')"


def ordered(begin: str, end: str, of: str = "tree") -> str:
    """What all beginnings and ends of nodes x give, in order."""
    both = f"transform({of}, x -> array(struct(2 * x.pre - x.depth as at, {begin} as e), struct(2 * x.last - x.depth + 1 as at, {end} as e)))"
    return f"transform(array_sort(flatten({both})), p -> p.e)"


#: Whether a node is template content, which HTML leaves out.
CONTENT: Steps = [("contents", "transform(tree, x -> x.host is not null)"), ("inside", within("contents")), ("hidden", "transform(tree, x -> x.host is not null or inside[x.pre])")]


def pieces(begin: str = BEGIN, end: str = END) -> str:
    return ordered(f"if(hidden[x.pre], '', {begin})", f"if(hidden[x.pre], '', {end})")


#: The pieces of the subtree x.
OF_SUBTREE = "array_join(slice({0}, 2 * x.pre - x.depth + 1, 2 * (x.last - x.pre + 1)), '')"
COMPACT = f"array_join({pieces()}, '')"

#: Pieces of text, and how many come before each node; a subtree's text is a slice.
TEXTS: Steps = [("texts", "filter(tree, x -> x.kind = 'text' and x.data <> '')"), ("places", "transform(texts, x -> x.pre)"), ("before", ranks("places")), ("words", "transform(texts, x -> x.data)")]
TEXT_OF = "array_join(slice(words, before[x.pre] + 1, before[x.last + 1] - before[x.pre]), '')"


def plain_text(separator: str = "' '", strip: bool = True) -> str:
    """The text of the whole tree, script and template content included."""
    data = f"transform(filter(tree, x -> x.kind = 'text'), x -> {stripped('x.data') if strip else 'x.data'})"
    return f"array_join(filter({data}, t -> t <> ''), {separator})"


def pretty(indent: int = 2) -> tuple[Steps, str]:
    """Steps and value. A node a line; elements stay on one line that are empty, preformatted, or hold text or what isn't known to be a block."""
    top = "if(tree[0].kind in ('document', 'fragment', 'content'), 1, 0)"
    parents = "array_sort(array_distinct(transform(filter(tree, x -> x.parent is not null and {0}), x -> x.parent)))"
    line, pad = "lined[x.pre]", f"concat('\\n', repeat(' ', {indent} * (x.depth - base)))"
    text = f"if({stripped('x.data')} = '', '', concat({pad}, {escaped(stripped('x.data'))}))"
    steps: Steps = CONTENT + [
        ("base", top),
        ("branched", parents.format("x.kind <> 'text'")),
        ("mixed", parents.format(f"case x.kind when 'text' then {stripped('x.data')} <> '' when 'element' then x.name not in {names(SPECIAL)} else true end")),
        ("branches", scattered("branched")),
        ("mixes", scattered("mixed")),
        ("flat", f"transform(tree, x -> x.kind = 'element' and (x.name in {names(VOID)} or x.name in ('pre', 'textarea') or not branches[x.pre] or mixes[x.pre]))"),
        ("lower", within("flat")),
        ("lined", "transform(tree, x -> not lower[x.pre] and x.kind not in ('document', 'fragment', 'content'))"),
    ]
    begin = f"case when not {line} then {BEGIN} when x.kind = 'text' then {text} else concat({pad}, {BEGIN}) end"
    end = f"concat(if({line} and not flat[x.pre] and x.kind = 'element', {pad}, ''), {END})"
    return steps, f"substr(array_join({pieces(begin, end)}, ''), 2)"


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What is followed by a blank line, besides headings and what has rules of its own; what keeps white space, and what ends that.
BLOCKS = ("div", "section", "article", "header", "footer", "main", "nav", "aside")
KEEP = ("textarea", "script", "style")
COLLAPSE = (*HEADINGS, "p", "blockquote", "ul", "ol", "em", "i", "strong", "b", "a")
WHITE = "' \\t\\n'"


def event(kind: str, text: str = "''") -> str:
    return f"struct('{kind}' as k, {text} as s, quotes[x.pre] as q)"


def raw(text: str) -> str:
    """Text as it is: white space around it can fall away, the rest can't."""
    return let([("s", text), ("core", f"trim(both {WHITE} from s)")], f"""filter(array(
        if(core = '', {event('blank', 's')}, {event('blank', f"left(s, length(s) - length(trim(leading {WHITE} from s)))")}), {event('raw', 'core')},
        if(core = '', {event('blank')}, {event('blank', f"right(s, length(s) - length(trim(trailing {WHITE} from s)))")})), e -> e.s <> '')""")


def mark(text: str) -> str:
    return f"array({event('raw', text)})"


def many(*some: str) -> str:
    return f"concat({', '.join(some)})"


GAP, BREAK, NONE = f"array({event('gap')})", f"array({event('break')})", f"filter(array({event('gap')}), e -> false)"
SPACED = r"[ \t\n\u000c\r]"
#: A text's words; its characters that mean something in Markdown are escaped.
WORDS = let([("t", f"regexp_replace(x.data, r'([\\\\`*_\\[\\]])', r'\\\\$1')"), ("core", "trim(both ' \\t\\n\\u000c\\r' from t)")], f"""filter(array(
    if(rlike(t, '^{SPACED}'), {event('space')}, null), if(core = '', null, {event('words', f"regexp_replace(core, '{SPACED}+', ' ')")}),
    if(rlike(t, '{SPACED}$'), {event('space')}, null)), e -> e is not null)""")
FENCE = "repeat('`', coalesce(array_max(transform(regexp_extract_all(t, '(`+)', 1), f -> length(f))), 0) + 1)"
CODE = let([("t", TEXT_OF), ("f", FENCE)], "if(startswith(t, '`') or endswith(t, '`'), concat(f, ' ', t, ' ', f), concat(f, t, f))")
HREF = "coalesce(get(filter(x.attrs, a -> a.name = 'href'), 0).value, '')"
MARKDOWN_BEGIN = f"""case
    when x.kind = 'text' then if(kept[x.pre], {raw('x.data')}, {WORDS})
    when x.kind <> 'element' then {NONE}
    when x.lname = 'br' then {BREAK}
    when x.lname = 'img' then {raw(START_TAG)}
    when x.lname = 'table' then {many(GAP, raw(OF_SUBTREE.format('html')), GAP)}
    when x.lname in {names(HEADINGS)} then {many(GAP, raw("concat(repeat('#', cast(substr(x.lname, 2) as int)), ' ')"))}
    when x.lname = 'hr' then {many(GAP, mark("'---'"), GAP)}
    when x.lname = 'pre' then {many(GAP, mark("'```'"), BREAK, f"if({TEXT_OF} = '', {NONE}, {many(raw(f"trim(trailing '\\n' from {TEXT_OF})"), BREAK)})", mark("'```'"), GAP)}
    when x.lname = 'code' and not kept[x.pre] then {raw(CODE)}
    when x.lname in ('p', 'blockquote', 'ul', 'ol') then {GAP}
    when listed[x.pre] then {many(f"if(x.type_idx > 1, {BREAK}, {NONE})", raw("repeat('  ', lists[x.pre])"), raw("if(tree[x.parent].lname = 'ol', concat(x.type_idx, '. '), '- ')"))}
    when x.lname in ('em', 'i') then {mark("'*'")}
    when x.lname in ('strong', 'b') then {mark("'**'")}
    when x.lname = 'a' then {mark("'['")}
    else {NONE} end"""
MARKDOWN_END = f"""case
    when x.kind <> 'element' then {NONE}
    when x.lname in {names((*HEADINGS, 'p', 'blockquote', 'ul', 'ol', *BLOCKS))} then {GAP}
    when x.lname = 'li' and not listed[x.pre] then {GAP}
    when x.lname in ('em', 'i') then {mark("'*'")}
    when x.lname in ('strong', 'b') then {mark("'**'")}
    when x.lname = 'a' then {mark(f"if({HREF} = '', ']', concat('](', {HREF}, ')'))")}
    else {NONE} end"""
#: Ancestors that are listed items, and quotations, counted by pointers that jump.
ABOVE = """transform(aggregate(
    sequence(1, cast(ceil(log2(array_max(transform(tree, x -> x.depth)) + 2)) as int)),
    transform(tree, x -> let_up),
    (now, r) -> transform(now, c -> if(c.j is null, c, struct(now[c.j].j as j, c.n + now[c.j].n as n, c.m + now[c.j].m as m)))), c -> struct(c.n as n, c.m as m))""".replace(
    "let_up", let([("up", "coalesce(x.parent, x.host)")], "struct(up as j, if(get(listed, up), 1, 0) as n, if(get(tree, up).lname = 'blockquote', 1, 0) as m)")
)
#: One event more in a gap: its text, line breaks at its end (two at most count), whether a space is due, the length of the blanks at its end that a break takes away.
FOLD = """aggregate(within_gap, struct('' as g, 0 as breaks, false as due, 0 as tail), (a, e) -> case
    when e.k = 'space' then struct(a.g as g, a.breaks as breaks, a.breaks = 0 as due, a.tail as tail)
    when e.k = 'blank' then struct(concat(a.g, e.s) as g, least(2, length(e.s) - length(trim(trailing '\\n' from e.s))) as breaks, false as due, length(e.s) as tail)
    when e.k = 'break' or a.breaks < 2 then struct(
        concat(left(a.g, length(a.g) - a.tail), trim(trailing ' \\t' from right(a.g, a.tail)), if(e.k = 'gap' and a.breaks = 0, '\\n\\n', '\\n')) as g,
        if(e.k = 'gap', 2, least(2, a.breaks + 1)) as breaks, false as due, 0 as tail)
    else a end)"""
TRIMMED_LINES = "regexp_replace({0}, '[ \\t]+(?=\\n)', '')"
#: The hard event number k and the gap after it.
PIECE = let(
    [
        ("h", "events[hard[k]]"), ("next", "get(events, hard[k] + size(weak[k]) + 1)"),
        ("low", "if(k + 1 = size(hard), 0, least(h.q, next.q, array_min(transform(weak[k], e -> e.q))))"),
        ("within_gap", "if(k + 1 = size(hard), slice(weak[k], 1, 0), filter(weak[k], e -> e.q = low))"),
        ("gap", FOLD),
        ("space", "if(gap.due and gap.breaks = 0 and next.s not like '\\r%' and next.s not like '\\u000c%', ' ', '')"),
        ("own", "if(h.q = 0, h.s, replace(h.s, '\\n', concat('\\n', repeat('> ', h.q))))"),
        ("after", "if(low = 0, gap.g, replace(gap.g, '\\n', concat('\\n', repeat('> ', low))))"),
    ],
    f"""concat(if(k = 0, repeat('> ', h.q), ''),
        case when low > 0 then {TRIMMED_LINES.format('concat(own, after)')} when h.q > 0 then concat({TRIMMED_LINES.format('own')}, after) else concat(own, after) end,
        space, if(k + 1 = size(hard), '', repeat('> ', next.q - low)))""",
)
MARKDOWN_STEPS: Steps = TEXTS + [
    # of the HTML of tables the content of templates is left out, but not of templates around a table
    ("tables", "transform(tree, x -> x.kind = 'element' and x.lname = 'table')"), ("tabled", within("tables", True)),
    ("contents", "transform(tree, x -> x.host is not null and tabled[x.pre])"), ("inside", within("contents", True)), ("hidden", "transform(tree, x -> contents[x.pre] or inside[x.pre])"),
    ("html", f"if(exists(tables, v -> v), {pieces()}, array(''))"),
    ("setters", f"transform(tree, x -> x.kind = 'element' and x.lname in {names((*KEEP, *COLLAPSE))})"),
    ("kept", f"transform({nearest('setters', True)}, j -> coalesce(get(tree, j).lname in {names(KEEP)}, false))"),
    ("off", "transform(tree, x -> coalesce(get(tree, x.parent).lname in ('ol', 'ul') and (x.kind <> 'element' or x.lname <> 'li'), false))"),
    ("listed", "transform(tree, x -> coalesce(get(tree, x.parent).lname in ('ol', 'ul') and x.kind = 'element' and x.lname = 'li', false))"),
    ("whole", "transform(tree, x -> off[x.pre] or x.kind = 'element' and (x.lname in ('br', 'hr', 'img', 'pre', 'table') or x.lname = 'code' and not kept[x.pre]))"),
    ("covered", within("whole", True)),
    ("above", ABOVE),
    ("lists", "transform(above, c -> c.n)"),
    ("quotes", "transform(above, c -> c.m)"),
    ("quoted", "exists(quotes, q -> q > 0)"),
    ("shown", "filter(tree, x -> not covered[x.pre] and not off[x.pre])"),
    ("events", f"flatten({ordered(MARKDOWN_BEGIN, MARKDOWN_END, 'shown')})"),
    ("hard", "filter(transform(events, (e, i) -> if(e.k in ('raw', 'words'), i, null)), i -> i is not null)"),
    ("weak", "transform(hard, (i, k) -> slice(events, i + 2, coalesce(get(hard, k + 1), i + 1) - i - 1))"),
]
#: Most pieces stand outside quotations before a plain gap.
MARKDOWN = f"""array_join(transform(hard, (i, k) -> case
    when quoted or k + 1 = size(hard) then {PIECE}
    when size(weak[k]) = 0 then events[i].s
    when forall(weak[k], e -> e.k = 'gap') then concat(events[i].s, '\\n\\n')
    else {PIECE} end), '')"""
