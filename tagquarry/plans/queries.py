"""Named queries over the pages and documents tables, and SQL with the same rows where regular expressions can follow the markup."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets, tables
from ..functions.references import unescaped
from ..operators import project, relation, rewrite
from ..operators.relation import TREE, Options, Steps, attribute
from ..sources.store import stored
from .selector_sets import matched
from .selectors import Compiled, matches, query

KEY = "page_id"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages; dealt out over the cores where the source gives fewer partitions than there are, as parsing is the work."""
    docs = spark.read.parquet(f"{sf_dir}/pages.parquet").select(KEY, "html")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores, KEY) if size < cores * byte_count(spark.conf.get("spark.sql.files.maxPartitionBytes")) else docs


def byte_count(text: str) -> int:
    """A size as Spark's settings write it."""
    number, unit = re.fullmatch("([0-9]+)([a-z]*)", text.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1]]


def trees(spark: SparkSession, sf_dir: str, options: Options = Options()) -> DataFrame:
    return relation.trees(pages(spark, sf_dir), KEY, "html", options)


def nodes(spark: SparkSession, sf_dir: str, options: Options = Options()) -> DataFrame:
    return relation.exploded(trees(spark, sf_dir, options), KEY)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation.events(pages(spark, sf_dir), KEY)


def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all pages as a table that is written once."""
    return stored(spark, f"nodes {sf_dir}", lambda: nodes(spark, sf_dir))


def stored_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, f"trees {sf_dir}", lambda: trees(spark, sf_dir))


def _inserted(s: SparkSession, d: str) -> DataFrame:
    """Two list items at the end of each list and one before each first item, in this order."""
    found = stored_trees(s, d)
    places = query(found, "nav ul, nav li:first-child", KEY).select(KEY, F.col("pre").alias("at"), "lname")
    item = F.struct(F.lit("element").alias("kind"), F.lit("li").alias("name"), F.lit(None).cast("string").alias("data"))
    rule = F.struct(F.lit("element").alias("kind"), F.lit("hr").alias("name"), F.lit(None).cast("string").alias("data"))
    ends = places.where("lname = 'ul'").select(KEY, "at", F.posexplode(F.array(item, rule)).alias("ord", "node")).select(KEY, "at", "ord", "node.*")
    starts = places.where("lname = 'li'").select(KEY, "at", F.lit("comment").alias("kind"), F.lit("#comment").alias("name"), F.lit("first").alias("data"))
    # the second edit is of a tree that has been numbered anew: places before the lists' ends are as they were
    return project.compact_html(rewrite.insert(rewrite.insert(found, ends, KEY), starts, KEY, before=True), KEY)


def _replaced(s: SparkSession, d: str) -> DataFrame:
    """Each page's heading replaced by one of its own number and a rule."""
    found = stored_trees(s, d)
    parts = found.select(KEY, F.concat(F.lit("<h2>page <b>"), KEY, F.lit("</b></h2><hr>")).alias("part"))
    new = relation.trees(parts, KEY, "part", Options(fragment=("div", None)))
    edits = query(found, "h1", KEY).select(KEY, F.col("pre").alias("at"), F.lit("replace").alias("how")).join(new, KEY)
    return query(rewrite.edited(found, edits, KEY), "article > hr + p, article > h2:first-child + hr, article:not(h1) > p:nth-of-type(2)", KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.max("elem_idx").cast("long").alias("at"))


def _selector_set(s: SparkSession, d: str) -> DataFrame:
    """A selector for each place that any page links to, and for each language; how many nodes on how many pages each matches."""
    places = query(stored_trees(s, d), "nav a[href]", KEY).select(HREF()).distinct().where("href <> '' and not contains(href, '\\'')")
    langs = query(stored_trees(s, d), "html[lang]", KEY).select(attr("lang")()).distinct()
    rules = places.select(F.concat(F.lit("nav > ul li > a[href='"), "href", F.lit("']")).alias("rule")).unionByName(langs.select(F.concat(F.lit("[lang='"), "lang", F.lit("'] li:first-child + li")).alias("rule")))
    found = matched(stored_trees(s, d), rules.select("rule", F.col("rule").alias("text")), KEY, "rule", "text")
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct(KEY).alias("pages"))


def _stored(selector: str, *columns, **options) -> Callable[[SparkSession, str], DataFrame]:
    """Matches, or without columns their number, among stored nodes."""
    def run(s: SparkSession, d: str) -> DataFrame:
        found = query(stored_nodes(s, d), selector, KEY, **options)
        return found.select(KEY, *[c() for c in columns]) if columns else found.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))

    return run


def _selected(selector: str, *columns, only: tuple[str, ...] = (), **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: query(trees(s, d), selector, KEY, **options).select(KEY, *only, *[c() if callable(c) else c for c in columns])


def _counted(selector: str, out: str = "n", **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: query(trees(s, d), selector, KEY, **options).groupBy(KEY).agg(F.count(F.lit(1)).alias(out))


def attr(name: str) -> Callable:
    """A column that is made when there is a session."""
    return lambda: attribute(name).alias(name)


HREF = attr("href")


def with_text_of(selector: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: query(trees(s, d), selector, KEY, text="text").select(KEY, "text")


def _kinds(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _encodings(s: SparkSession, d: str) -> DataFrame:
    docs = pages(s, d).select(KEY, F.encode("html", "UTF-8").alias("content"))
    return relation.documents(docs, KEY, "content", text=False).select(KEY, "status", "encoding", "quirks")


def _mixed_encodings(s: SparkSession, d: str) -> DataFrame:
    """The pages in four encodings, told by a mark or by a declaration, and decoded again."""
    html, marked = F.col("html"), F.regexp_replace("html", "<meta charset=\"[^\"]*\">", "<meta charset=latin1>")
    content = F.when(F.col(KEY) % 4 == 0, F.encode(html, "UTF-8")).when(F.col(KEY) % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE")))
    content = content.when(F.col(KEY) % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(html, "UTF-16BE"))).otherwise(F.encode(marked, "ISO-8859-1"))
    return relation.documents(pages(s, d).select(KEY, content.alias("content")), KEY, "content").select(KEY, "encoding", F.md5("text").alias("md5"))


def _told_encodings(s: SparkSession, d: str) -> DataFrame:
    """The pages as bytes in eight ways that say their encoding, told and decoded by expressions alone."""
    way, html = F.col(KEY) % 8, F.col("html")

    def declared(meta: str) -> Column:
        return F.regexp_replace("html", "<meta charset=\"[^\"]*\">", meta)

    latin = declared("<meta charset=latin1>")
    ways = [
        F.encode(html, "UTF-8"),
        F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE")),
        F.concat(F.unhex(F.lit("FEFF")), F.encode(html, "UTF-16BE")),
        F.encode(latin, "ISO-8859-1"),
        F.concat(F.unhex(F.lit("EFBBBF")), F.encode(latin, "UTF-8")),
        F.encode(declared("<!--<meta charset=utf-8>-->"), "ISO-8859-1"),
        F.encode(declared("<meta http-equiv=Content-Type content='text/html; charset = utf8'>"), "UTF-8"),
        F.encode(latin, "UTF-8"),
    ]
    content = F.coalesce(*[F.when(way == i, w) for i, w in enumerate(ways)])
    docs = pages(s, d).select(KEY, content.alias("content"), F.when(way == 7, " UTF8 ").alias("label"))
    return charsets.with_text(docs, "content", "told", "label", python=False).select(KEY, "told.encoding", F.md5("told.text").alias("md5"))


def _lateral_links(s: SparkSession, d: str) -> DataFrame:
    """Links by a table function called for each page."""
    found = pages(s, d).lateralJoin(tables.html_events()(F.col("html").outer(), fields=F.lit("event, name, attrs")))
    return found.where("event = 'start' and name = 'a'").select(KEY, HREF())


def _table_comments(s: SparkSession, d: str) -> DataFrame:
    """Comments by a table function of the table of pages."""
    found = tables.parse_html()(pages(s, d).asTable(), column=F.lit("html"), keys=F.lit(KEY), fields=F.lit("kind, data"))
    return found.where("kind = 'comment'").select(KEY, F.col("data").alias("comment"))


def _joined_pieces(s: SparkSession, d: str) -> DataFrame:
    """Sizes of pages that are stored in pieces of 500 characters, joined by the table function."""
    parts = pages(s, d).select(KEY, F.posexplode(F.expr("transform(sequence(0, length(html) div 500), i -> substr(html, i * 500 + 1, 500))")).alias("at", "part"))
    found = tables.parse_html()(parts.asTable(), column=F.lit("part"), keys=F.lit(KEY), pieces=F.lit("at"), fields=F.lit("depth"))
    return found.groupBy(KEY).agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("long").alias("depth"))


def _error_ranges(s: SparkSession, d: str) -> DataFrame:
    docs = pages(s, d)
    return relation.highlighted(relation.errors(docs, KEY), docs, KEY).select(KEY, "ord", "code", "line", "col", "offset", "end_offset", F.md5("err_text").alias("md5"))


def _fragments(s: SparkSession, d: str) -> DataFrame:
    docs = pages(s, d).select(KEY, F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1).alias("part"))
    found = relation.trees(docs, KEY, "part", Options(fragment=("nav", None)))
    return query(found, "li > a", KEY).select(KEY, HREF())


def _pruned(s: SparkSession, d: str) -> DataFrame:
    rest = relation.exploded(rewrite.remove(trees(s, d), "script, style, nav", KEY), KEY)
    return rest.groupBy(KEY).agg(F.count(F.when(F.col("lname") == "a", 1)).alias("links"), F.count(F.when(F.col("lname") == "h1", 1)).alias("headings"))


def _links_by_language(s: SparkSession, d: str) -> DataFrame:
    """The number of links of each page beside its language, by one pass over its nodes, then a sum."""
    steps = Steps(trees(s, d), KEY)
    link, root = Compiled("nav a[href]", KEY).fits(steps), Compiled("html[lang]", KEY).fits(steps)
    lang = attribute("lang", attrs=F.get(F.filter(TREE, root), F.lit(0))["attrs"])
    each = steps.trees.select(lang.alias("lang"), F.size(F.filter(TREE, link)).cast("long").alias("links"))
    return each.where("lang is not null and links > 0").groupBy("lang").agg(F.sum("links").alias("links"))


def _flags(s: SparkSession, d: str) -> DataFrame:
    return matches(trees(s, d), "nav li:first-child", KEY).groupBy("matches").agg(F.count(F.lit(1)).alias("n")).where("matches").select("n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "nav_links": lambda s, d: events(s, d).where("event = 'start' and name = 'a'").select(KEY, HREF()),
    "nav_links_tree": _selected("nav > ul > li > a[href]", HREF),
    "first_link": lambda s, d: query(trees(s, d), "nav a", KEY, only_first=True).select(KEY, HREF()),
    "titles": with_text_of("title"),
    "h1_text": with_text_of("article h1"),
    "page_lang": _selected("html", attr("lang")),
    "meta_charset": _selected("head > meta[charset]", attr("charset")),
    "a_count": _counted("a"),
    "li_count": _counted("li"),
    "p_count": _counted("p"),
    "br_count": _counted("br"),
    "comments": lambda s, d: nodes(s, d).where("kind = 'comment'").select(KEY, F.col("data").alias("comment")),
    "doctypes": lambda s, d: nodes(s, d).where("kind = 'doctype'").select(KEY, F.col("data").alias("name")),
    "first_li": _selected("nav li:first-child > a", HREF),
    "last_li": _selected("nav li:last-child > a", HREF),
    "odd_li": _selected("nav li:nth-child(odd) > a", HREF),
    "li_not_first": _selected("nav li:not(:first-child) > a", HREF),
    "li_after_li": _counted("nav li + li"),
    "li_siblings": _counted("nav li:nth-child(2) ~ li"),
    "every_element": _counted("*"),
    "lang_en": _counted("[lang|=en]"),
    "class_word": _counted("[class~=ad]"),
    "second_p": _selected("article p:nth-of-type(2)", text="text", only=("text",)),
    "links_within": lambda s, d: query(trees(s, d), "a[href]", KEY, within="nav").groupBy(KEY).agg(F.count(F.lit(1)).alias("n")),
    "body_parts": _selected("body > *:not(nav):not(.ad)", "lname"),
    "p_in_css": _counted("body p b", css=True),
    "h1_plus_p": _counted("h1 + p"),
    "style_or_script": _counted("style, script"),
    "links_prefix": _counted("nav a[href^='/t']"),
    "links_suffix": _counted("nav a[href$='n']"),
    "links_contain": _counted("nav a[href*='he']"),
    "ad_class": _counted("div.ad"),
    "only_nav": _counted("nav:only-of-type"),
    "links_by_language": _links_by_language,
    "matching_flags": _flags,
    "start_tags": lambda s, d: events(s, d).where("event = 'start'").groupBy("name").agg(F.count(F.lit(1)).alias("n")),
    "fragment_links": _fragments,
    "pruned": _pruned,
    "pruned_links": lambda s, d: query(rewrite.remove(trees(s, d), "nav li:first-child, script, article", KEY), "nav ul > li:first-child > a", KEY).select(KEY, HREF()),
    "pruned_html": lambda s, d: project.compact_html(rewrite.remove(trees(s, d), "nav li:nth-child(2), style, article > p, div.ad", KEY), KEY),
    "inserted": _inserted,
    "replaced": _replaced,
    "encodings": _encodings,
    "escaped_documents": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(project.escaped(F.col("text"))).alias("md5")),
    "unescaped_documents": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", project.escaped(F.col("text")).alias("html")).select("doc_id", F.md5(F.expr(unescaped("html"))).alias("md5")),
    "unescaped_pages": lambda s, d: pages(s, d).select(KEY, F.regexp_extract("html", "(?s)<footer>([^<]*)", 1).alias("foot"), F.regexp_extract("html", "(?s)<h1>([^<]*)", 1).alias("head")).select(KEY, F.expr(unescaped("foot")).alias("foot"), F.expr(unescaped("head", True)).alias("head")),
    "node_kinds": _kinds,
    "dom_size": lambda s, d: nodes(s, d).groupBy(KEY).agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("long").alias("depth")),
    "b_depth": lambda s, d: query(trees(s, d), "b", KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.max("depth").cast("long").alias("depth")),
    "footer_in_b": _counted("b footer, footer b"),
    "root_nodes": _selected(":root", "kind", "lname"),
    "empty_elements": _counted(":empty"),
    "contains_text": _counted("article p:contains(the)"),
    "parse_errors": lambda s, d: relation.errors(pages(s, d), KEY).groupBy("source", "code").agg(F.count(F.lit(1)).alias("n")),
    "strict_pages": lambda s, d: relation.documents(pages(s, d), KEY, options=Options(strict=True), text=False).select(KEY, "status", "n_errors", "first_error"),
    "mixed_encodings": _mixed_encodings,
    "told_encodings": _told_encodings,
    "lateral_links": _lateral_links,
    "table_comments": _table_comments,
    "joined_pieces": _joined_pieces,
    "error_ranges": _error_ranges,
    "page_text": lambda s, d: project.texts(trees(s, d), KEY),
    "compact_html": lambda s, d: project.compact_html(trees(s, d), KEY),
    "pretty_html": lambda s, d: project.to_html(pages(s, d), KEY),
    "markdown": lambda s, d: project.to_markdown(pages(s, d), KEY),
    "tree_dump": lambda s, d: project.tree_dump(trees(s, d), KEY),
    "stored_nav_links": _stored("nav > ul > li > a[href]", HREF),
    "stored_li_siblings": _stored("nav li:nth-child(2) ~ li"),
    "stored_footer_in_b": _stored("b footer, footer b"),
    "stored_links": _stored("ul li:not(p li) + li a, nav li:first-child > a", HREF, within="nav"),
    "stored_contains": _stored("nav:contains('e, '), nav ul:contains('e a'), li:contains(th), article:contains('. A'), body:contains('. A')"),
    "selector_set": _selector_set,
    "nested_texts": with_text_of("nav, ul, li, article"),
    "contains_nested": _counted("nav:contains('e, '), nav ul:contains('e a'), li:contains(th), article:contains('. A'), body:contains('. A')"),
}


#: The pages' regular markup as the parser completes it: the <b> of a paragraph is never closed, so all that follows opens it again, three of them at most
#: besides a new one; paragraphs end where the next begins; attributes lose their quotes and texts their entities.
_BOLD = "len(list_filter(paras[1:{0}], lambda u: starts_with(u, '<p><b>')))"
_DEPTH = f"least(3, {_BOLD.format('i')} - cast(starts_with(v, '<p><b>') as int)) + cast(starts_with(v, '<p><b>') as int)"
_PARA = f"'<p>' || repeat('<b>', {_DEPTH}) || regexp_extract(v, '^<p>(?:<b>)?([^<]*)', 1) || case when starts_with(v, '<p><b>') then '<br>' else '' end || repeat('</b>', {_DEPTH}) || '</p>'"
_LAST = f"least(3, {_BOLD.format('len(paras)')})"
_WHOLE = f"head || array_to_string(list_transform(paras, lambda v, i: {_PARA}), '') || '</article><footer>' || repeat('<b>', {_LAST}) || foot || repeat('</b>', {_LAST}) || '</footer></body></html>'"
_STEPS = [("replace", "\"</p>\"", "\"&lt;/p&gt;\""), ("replace", "&quot;", "\""), ("replace", "&#x27;", "'"), ("replace", "&copy;", "\u00a9"), ("replace", "&middot;", "\u00b7"), ("regexp_replace", "(lang|charset|class|href)=\"([^\"> '=\\s]+)\"", "\\1=\\2"), ("replace", "href=\"\"", "href")]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _compact() -> str:
    out = "h"
    for kind, old, new in _STEPS:
        more = ", 'g'" if kind == "regexp_replace" else ""
        out = f"{kind}({out}, {_quoted(old)}, {_quoted(new)}{more})"
    return out


_CUT = "select page_id, regexp_extract(html, '(?s)^(.*?</h1>)', 1) as head, regexp_extract_all(html[strpos(html, '</h1>') :], '<p>(?:<b>)?[^<]*') as paras, regexp_extract(html, '<footer>([^<]*)', 1) as foot from pages"
_PAGES = f"with cut as ({_CUT}), whole as (select page_id, {_WHOLE} as h from cut), made as (select page_id, {_compact()} as h from whole), parts as (select page_id, h, regexp_extract_all(h, '>([^<]+)<', 1) as t from made)"
_TEXT = "trim(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ' ' || chr(10) || chr(9))"


#: The texts in the order of the tree, of parts of a page that nest.
_JOINED = "array_to_string(list_filter({0}, lambda v: v <> ''), ' ')"
_PARTS = _PAGES[: _PAGES.rindex(", parts as")] + ", parts as (select page_id, " + ", ".join(f"list_transform(regexp_extract_all(regexp_extract(h, '(?s)<{n}>.*</{n}>'), '>([^<]+)<', 1), lambda v: {_TEXT.format('v')}) as {n}" for n in ("nav", "article", "body")) + " from made)"


def _of(pattern: str) -> str:
    return f"len(regexp_extract_all(h, {_quoted(pattern)}))"


def _made(n: str, out: str = "n", more: str = "") -> str:
    return f"{_PAGES} select page_id, cast({n} as bigint) as {out}{more} from parts where {n} > 0"


_DEEP = "case when contains(h, '<b><b><b><b>') then 8 when contains(h, '<b><b><b>') then 7 when contains(h, '<b><b>') then 6 else 5 end"
_NODES = f"1 + len(regexp_extract_all(h, '<!DOCTYPE|<!--|<[a-z]')) + len(t)"
_P = "regexp_extract_all(h, '<p>(?:<b>)*([^<]*)', 1)"


_PLAIN = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
#: Indented: the body has a comment, so it stays on one line.
_INDENTED = r"""regexp_replace(h, '(?s)^(<!DOCTYPE html>)(<html[^>]*>)<head>(<meta[^>]*>)(<title>.*?</title>)(<style>.*?</style>)(<script>.*?</script>)</head>(<body>.*</body>)</html>$',
'\\1\n\\2\n  <head>\n    \\3\n    \\4\n    \\5\n    \\6\n  </head>\n  \\7\n</html>')""".replace("\\n", "' || chr(10) || '").replace("\\\\", "\\")


def _inline(text: str) -> str:
    """Markdown of a text between marks: characters escaped, white space collapsed."""
    text = _PLAIN.format(f"replace(replace({text}, '&copy;', '©'), '&middot;', '·')")
    return f"regexp_replace(regexp_replace({text}, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')"


def _markdown() -> str:
    """Each paragraph of the page as parsed has as many pairs of asterisks around it as it has bold elements, and a break in it if it opens one."""
    inner = _inline("regexp_extract(v, '^<p>(?:<b>)?([^<]*)', 1)")
    stars, own = f"repeat('**', {_DEPTH})", "starts_with(v, '<p><b>')"
    para = f"case when {_DEPTH} = 0 then trim({inner}) else {stars} || (case when {own} then rtrim({inner}) || chr(10) else {inner} end) || {stars} end"
    link = f"'- [' || {_inline('t[2]')} || ']' || case when t[1] = '' then '' else '(' || {_PLAIN.format('t[1]')} || ')' end"
    links = f"array_to_string(list_transform(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*'), lambda u: list_transform([regexp_extract(u, '<li><a href=\"([^\"]*)\">([^<]*)', ['a', 'b'])], lambda s: list_transform([[s.a, s.b]], lambda t: {link})[1])[1]), chr(10))"
    foot = f"repeat('**', {_LAST}) || case when {_LAST} = 0 then trim({_inline('foot')}) else {_inline('foot')} end || repeat('**', {_LAST})"
    head = f"ltrim({_inline(_first('<title>([^<]*)'))}) || {_first('(?s)<style>(.*?)</style>')} || {_first('(?s)<script>(.*?)</script>')}"
    blocks = f"[{head}, {links}, trim({_inline(_first('<div class=\"ad\">([^<]*)'))}), '# ' || trim({_inline(_first('<h1>([^<]*)'))})] || list_transform(paras, lambda v, i: {para}) || [{foot}]"
    return f"with cut as ({_CUT}), whole as (select cut.*, html from cut join pages using (page_id)) select page_id, array_to_string(list_filter({blocks}, lambda z: z <> ''), chr(10) || chr(10)) as markdown from whole"


def _first(pattern: str) -> str:
    return f"regexp_extract(html, '{pattern}', 1)"


_A = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


def _count(pattern: str, out: str = "n") -> str:
    n = f"len(regexp_extract_all(html, '{pattern}'))"
    return f"select page_id, cast({n} as bigint) as {out} from pages where {n} > 0"


def _list(condition: str) -> str:
    return f"select page_id, x.v as href from (select page_id, unnest(list_transform({_A}, lambda v, i: {{'v': v, 'i': i, 'n': len({_A})}})) as x from pages) where {condition}"


def _links(test: str) -> str:
    n = f"len(list_filter({_A}, lambda v: {test}))"
    return f"select page_id, cast({n} as bigint) as n from pages where {n} > 0"


SQL: dict[str, str] = {
    "nav_links": f"select page_id, unnest({_A}) as href from pages",
    "nav_links_tree": f"select page_id, unnest({_A}) as href from pages",
    "first_link": f"select page_id, {_A}[1] as href from pages where len({_A}) > 0",
    "titles": f"select page_id, trim({_PLAIN.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, ' ' || chr(10)) as text from pages",
    "h1_text": f"select page_id, trim({_PLAIN.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, ' ' || chr(10)) as text from pages",
    "page_lang": "select page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang from pages",
    "meta_charset": "select page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) as charset from pages",
    "a_count": _count("<a href"),
    "li_count": _count("<li>"),
    "p_count": _count("<p>"),
    "br_count": _count("<br>"),
    "comments": "select page_id, unnest(regexp_extract_all(html, '<!--([^-]*)-->', 1)) as comment from pages",
    "doctypes": "select page_id, 'html' as name from pages where html like '<!DOCTYPE html>%'",
    "first_li": _list("x.i = 1"),
    "last_li": _list("x.i = x.n"),
    "odd_li": _list("x.i % 2 = 1"),
    "li_not_first": _list("x.i > 1"),
    "li_after_li": f"select page_id, cast(len({_A}) - 1 as bigint) as n from pages where len({_A}) > 1",
    "li_siblings": f"select page_id, cast(len({_A}) - 2 as bigint) as n from pages where len({_A}) > 2",
    "every_element": _made(_of("<!DOCTYPE|<[a-z]")),
    "lang_en": _count("<html lang=\"en[\"-]"),
    "class_word": _count("<div class=\"ad\">"),
    "second_p": f"{_PAGES} select page_id, {_TEXT.format(_P + '[2]')} as text from parts where len({_P}) > 1",
    "links_within": f"select page_id, cast(len({_A}) as bigint) as n from pages where len({_A}) > 0",
    "body_parts": f"{_PAGES} select page_id, unnest(regexp_extract_all(h, '<(article|footer)>', 1)) as lname from parts",
    "p_in_css": _made(_of("<b>") + f" - {_of('<footer><b>')} - {_of('<footer><b><b>')} - {_of('<footer><b><b><b>')}"),
    "node_kinds": f"{_PAGES} select kind, cast(sum(n) as bigint) as n from (select 'document' as kind, 1 as n from parts union all select 'doctype', {_of("<!DOCTYPE")} from parts union all select 'comment', {_of("<!--")} from parts union all select 'element', {_of("<[a-z]")} from parts union all select 'text', len(t) from parts) group by kind",
    "dom_size": f"{_PAGES} select page_id, cast({_NODES} as bigint) as nodes, cast(greatest(case when regexp_matches(h, '<a[^>]*>[^<]') then 7 else 6 end, {_DEEP} + 1) as bigint) as depth from parts",
    "b_depth": _made(_of("<b>"), "n", f", cast({_DEEP} as bigint) as depth"),
    "footer_in_b": _made(f"{_of('<footer><b>')} + {_of('<footer><b><b>')} + {_of('<footer><b><b><b>')}"),
    "root_nodes": "select page_id, unnest(['doctype', 'element']) as kind, unnest(['!doctype', 'html']) as lname from pages where html like '<!DOCTYPE html><html %'",
    "empty_elements": _made(_of("<!DOCTYPE|<meta|<br>") + " + " + _of("<(?:title|li|a|h1|b|div|p|footer|ul|nav|article)(?: [^>]*)?>\\s*</")),
    "contains_text": _made(f"len(list_filter({_P}, lambda v: contains(v, 'the')))"),
    "page_text": f"{_PAGES} select page_id, array_to_string(list_filter(list_transform(t, lambda v: {_TEXT.format('v')}), lambda v: v <> ''), ' ') as text from parts",
    "compact_html": f"{_PAGES} select page_id, h as html from parts",
    "pretty_html": f"{_PAGES} select page_id, {_INDENTED} as pretty from parts",
    "markdown": _markdown(),
    "nested_texts": f"{_PARTS} select page_id, unnest([{_JOINED.format('nav')}, {_JOINED.format('nav')}, {_JOINED.format('article')}] || nav) as text from parts",
    "contains_nested": f"{_PARTS}, counts as (select page_id, cast(contains({_JOINED.format('nav')}, 'e, ') as int) + cast(contains({_JOINED.format('nav')}, 'e a') as int) + len(list_filter(nav, lambda v: contains(v, 'th'))) + cast(contains({_JOINED.format('article')}, '. A') as int) + cast(contains({_JOINED.format('body')}, '. A') as int) as n from parts) select page_id, cast(n as bigint) as n from counts where n > 0",
    "h1_plus_p": _count("</h1><p>"),
    "style_or_script": _count("<style>|<script>"),
    "links_prefix": _links("starts_with(v, '/t')"),
    "links_suffix": _links("ends_with(v, 'n')"),
    "links_contain": _links("contains(v, 'he')"),
    "ad_class": _count("<div class=\"ad\">"),
    "only_nav": _count("<nav>"),
    "links_by_language": f"select regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang, cast(sum(len({_A})) as bigint) as links from pages where len({_A}) > 0 group by 1",
    "stored_nav_links": f"select page_id, unnest({_A}) as href from pages",
    "stored_li_siblings": f"select page_id, cast(len({_A}) - 2 as bigint) as n from pages where len({_A}) > 2",
    "stored_footer_in_b": _made(f"{_of('<footer><b>')} + {_of('<footer><b><b>')} + {_of('<footer><b><b><b>')}"),
    "stored_links": f"select page_id, unnest({_A}) as href from pages",
    "matching_flags": f"select count(*) as n from pages where len({_A}) > 0",
    "start_tags": "select name, count(*) as n from (select unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as name from pages) group by 1",
    "fragment_links": f"select page_id, unnest({_A}) as href from pages",
    "pruned": f"select page_id, cast(len({_A}) - len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=')) as bigint) as links, cast(len(regexp_extract_all(html, '<h1>')) as bigint) as headings from pages",
    "encodings": "select page_id, 'ok' as status, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) as encoding, case when html like '<!DOCTYPE html>%' then 'no-quirks' else 'quirks' end as quirks from pages",
    "escaped_documents": "select doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as md5 from documents",
    "unescaped_documents": "select doc_id, md5(text) as md5 from documents",
}
SQL["pruned_links"] = _list("x.i = 2")
SQL["pruned_html"] = f"{_PAGES} select page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?s)<style>.*?</style>|<div class=ad>[^<]*</div>', '', 'g'), '<p>(?:<b>)*[^<]*(?:<br>)?(?:</b>)*</p>', '', 'g'), '(<ul><li>[^\\n]*?</li>)<li>.*?</li>', '\\1') as html from parts"
SQL["inserted"] = f"{_PAGES} select page_id, replace(replace(h, '</ul>', '<li></li><hr></ul>'), '<ul><li>', '<ul><!--first--><li>') as html from parts"
SQL["replaced"] = f"select page_id, cast(case when len(paras) > 1 then 3 when len(paras) > 0 then 2 else 1 end as bigint) as n, cast(case when len(paras) > 1 then 4 when len(paras) > 0 then 3 else 2 end as bigint) as at from ({_CUT})"
SQL["stored_contains"] = SQL["contains_nested"]
_FOOT = f"replace(replace({_first('<footer>([^<]*)')}, '&copy;', '©'), '&middot;', '·')"
SQL["unescaped_pages"] = f"select page_id, {_PLAIN.format(_FOOT)} as foot, {_PLAIN.format(_first('<h1>([^<]*)'))} as head from pages"
SQL["mixed_encodings"] = "select page_id, ['utf-8', 'utf-16le', 'utf-16be', 'windows-1252'][page_id % 4 + 1] as encoding, md5(case when page_id % 4 = 3 then regexp_replace(html, '<meta charset=\"[^\"]*\">', '<meta charset=latin1>') else html end) as md5 from pages"
_DECLARED = ["'<meta charset=latin1>'", "'<!--<meta charset=utf-8>-->'", "'<meta http-equiv=Content-Type content=''text/html; charset = utf8''>'"]
_TOLD = f"case page_id % 8 when 5 then {_DECLARED[1]} when 6 then {_DECLARED[2]} else {_DECLARED[0]} end"
SQL["told_encodings"] = f"select page_id, ['utf-8', 'utf-16le', 'utf-16be', 'windows-1252', 'utf-8', 'windows-1252', 'utf-8', 'utf-8'][page_id % 8 + 1] as encoding, md5(case when page_id % 8 < 3 then html else regexp_replace(html, '<meta charset=\"[^\"]*\">', {_TOLD}) end) as md5 from pages"
SQL["lateral_links"], SQL["table_comments"], SQL["joined_pieces"] = SQL["nav_links"], SQL["comments"], SQL["dom_size"]
#: Errors of the pages: once a paragraph has opened a <b>, all ends of paragraphs find it open, and so do the starts or the end of the article that close paragraphs, and the footer's end.
_OPENS = "starts_with({0}, '<p><b>')"
_ANY = f"len(list_filter(paras, lambda u: {_OPENS.format('u')})) > 0"
_ERRORS = f"select page_id, len(list_filter(paras, lambda v, i: len(list_filter(paras[1:i], lambda u: {_OPENS.format('u')})) > 0)) + cast({_ANY} as int) as n, cast({_OPENS.format('paras[len(paras)]')} as int) + cast({_ANY} as int) as early, {_OPENS.format('paras[len(paras)]')} and len(list_filter(paras, lambda u: {_OPENS.format('u')})) = 1 as late from ({_CUT})"
SQL["strict_pages"] = f"select page_id, case when n > 0 then 'rejected' else 'ok' end as status, cast(n as int) as n_errors, case when n = 0 then null when late then 'end-tag-too-early' else 'expected-closing-tag-but-got-another' end as first_error from ({_ERRORS})"
SQL["parse_errors"] = f"select 'treebuilder' as source, code, cast(sum(x) as bigint) as n from (select 'end-tag-too-early' as code, early as x from ({_ERRORS}) union all select 'expected-closing-tag-but-got-another', n - early from ({_ERRORS})) group by code having sum(x) > 0"
_LINKS = f"links as (select page_id, {_PLAIN.format('u')} as href from (select page_id, unnest({_A}) as u from pages)), langs as (select page_id, {_first('<html lang=\"([^\"]*)\"')} as lang, len({_A}) as n from pages)"
_QUOTE = _quoted("'")
SQL["selector_set"] = (
    f"with {_LINKS} select 'nav > ul li > a[href=' || {_QUOTE} || href || {_QUOTE} || ']' as rule, count(*) as nodes, count(distinct page_id) as pages from links where href <> '' and not contains(href, {_QUOTE}) group by 1 "
    f"union all select '[lang=' || {_QUOTE} || lang || {_QUOTE} || '] li:first-child + li', count(*), count(*) from langs where n > 1 group by 1"
)
#: A line a node: the depth is how many elements are open.
_TOKENS = "regexp_extract_all(h, '(?s)<!DOCTYPE[^>]*>|<!--.*?-->|</?[a-z][^>]*>|[^<]+')"
_VALUE = "replace(replace(regexp_extract(t, '^<[a-z0-9]+ [a-z]+=[\"'']?(.*?)[\"'']?>$', 1), '&quot;', '\"'), '&amp;', '&')"
SQL["tree_dump"] = f"""{_PAGES}, listed as (select page_id, unnest({_TOKENS}) as t, unnest(range(len({_TOKENS}))) as i from parts),
leveled as (select *, regexp_matches(t, '^<[a-z]') as element, sum(case when t like '</%' then -1 when regexp_matches(t, '^<[a-z]') and not regexp_matches(t, '^<(meta|br)') then 1 else 0 end) over (partition by page_id order by i)
    - cast(regexp_matches(t, '^<[a-z]') and not regexp_matches(t, '^<(meta|br)') as int) as depth from listed),
lines as (select page_id, i, '| ' || repeat('  ', cast(depth as int)) || case when t like '<!D%' then '<!DOCTYPE html>' when t like '<!--%' then '<!-- ' || regexp_extract(t, '(?s)<!--(.*)-->', 1) || ' -->'
    when element then '<' || regexp_extract(t, '^<([a-z0-9]+)', 1) || '>' || case when regexp_matches(t, '^<[a-z0-9]+ ') then chr(10) || '| ' || repeat('  ', cast(depth as int) + 1) || regexp_extract(t, ' ([a-z]+)', 1) || '=\"' || {_VALUE} || '\"' else '' end
    else '\"' || replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') || '\"' end as line from leveled where t not like '</%')
select page_id, string_agg(line, chr(10) order by i) as dump from lines group by page_id"""
