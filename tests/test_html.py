import random

import pytest
from pyspark.sql import functions as F

from tagquarry.functions import encoding
from tagquarry.functions.entities import decode
from tagquarry.operators import project, relation, rewrite
from tagquarry.operators.relation import Options, events_of, flat
from tagquarry.operators.treebuilder import parse
from tagquarry.plans.selectors import Compiled, SelectorError, first, nth, query
from tagquarry.streaming import parse as streaming

#: html, fragment, dump
TREES = [
    ("<p>a<p>b", None, "| <html>\n|   <head>\n|   <body>\n|     <p>\n|       \"a\"\n|     <p>\n|       \"b\""),
    ("<!DOCTYPE html><b><p>x</b>y", None, "| <!DOCTYPE html>\n| <html>\n|   <head>\n|   <body>\n|     <b>\n|     <p>\n|       <b>\n|         \"x\"\n|       \"y\""),
    ("<table>x<tr><td>y", None, "| <html>\n|   <head>\n|   <body>\n|     \"x\"\n|     <table>\n|       <tbody>\n|         <tr>\n|           <td>\n|             \"y\""),
    ("<svg viewbox=1><lineargradient/></svg>", None, "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|       viewBox=\"1\"\n|       <svg linearGradient>"),
    ("<template><i>t</i></template>", None, "| <html>\n|   <head>\n|     <template>\n|       content\n|         <i>\n|           \"t\"\n|   <body>"),
    ("<td>x", ("tr", None), "| <td>\n|   \"x\""),
    ("<select><option>a<option>b</select>", None, "| <html>\n|   <head>\n|   <body>\n|     <select>\n|       <option>\n|         \"a\"\n|       <option>\n|         \"b\""),
    ("<frameset><frame></frameset>", None, "| <html>\n|   <head>\n|   <frameset>\n|     <frame>"),
    ("<b><frameset><frame><html><frameset></frameset>", None, "| <html>\n|   <head>\n|   <frameset>\n|     <frame>"),
    ("<a>1<a>2", None, "| <html>\n|   <head>\n|   <body>\n|     <a>\n|       \"1\"\n|     <a>\n|       \"2\""),
    ("<math><mi>\0\fx</mi></math>", None, "| <html>\n|   <head>\n|   <body>\n|     <math math>\n|       <math mi>\n|         \"x\""),
    ("<select><plaintext></select>", None, "| <html>\n|   <head>\n|   <body>\n|     <select>\n|       <plaintext>\n|         \"</select>\""),
    ("<select><img><br>a", None, "| <html>\n|   <head>\n|   <body>\n|     <select>\n|       <img>\n|       <br>\n|       \"a\""),
    ("<table>\f</table>", None, "| <html>\n|   <head>\n|   <body>\n|     <table>"),
    ("<!--c-->", None, "| <!-- c -->\n| <html>\n|   <head>\n|   <body>"),
]
PAGE = "<!DOCTYPE html><html lang=en><body><section><div id=a class='x y'><p>one</p><p class=y>two <b>bold</b></p></div><div><div><p>deep</p></div></div></section><ul><li>1<li>2<li>3</ul><template><p>t</p></template></body></html>"


@pytest.fixture(scope="module")
def nodes(spark):
    return relation.nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "k int, html string"), "k").cache()


def test_trees(spark):
    for fragment in {f for _, f, _ in TREES}:
        cases = [(i, h) for i, (h, f, _) in enumerate(TREES) if f == fragment]
        found = relation.nodes(spark.createDataFrame(cases, "k int, html string"), "k", options=Options(fragment=fragment))
        for r in project.tree_dump(found, "k").collect():
            assert r["dump"] == TREES[r["k"]][2], TREES[r["k"]][0]


def test_intervals_nest():
    rows = flat(parse(PAGE)[0])
    assert [r["pre"] for r in rows] == list(range(len(rows)))
    for r in rows:
        up = r
        while (at := up["parent"] if up["parent"] is not None else up["host"]) is not None:
            up = rows[at]
            assert up["pre"] < r["pre"] <= up["last"]


def test_never_fails():
    for html in ("<div>" * 5000, "&#²;" + "&#" + "9" * 5000 + ";", "<select><selectedcontent>", "</p></br>", "<a b='", "<!doctype", "<svg><![CDATA[x", "<script><!--<script></script>", "<table><table><tr><caption>", "\0<p>\0"):
        assert flat(parse(html)[0])


def test_entities():
    assert decode("&amp &notit; &copy; &#x80; &#0; &#xD800; &unknown;") == "& ¬it; © € � � &unknown;"
    assert decode("?a=1&copy=2&lt;", True) == "?a=1&copy=2<"


def test_references_in_sql_equal_the_tokenizers(spark):
    """All names with and without semicolons, before what may and may not follow, and numbers of all kinds."""
    from html.entities import html5

    from tagquarry.functions.references import unescaped

    r = random.Random(1)
    bits = ["&", "#", "x", "amp", "lt", ";", "&#", "&#X", "0", "9", "f", "41", "&not", "it;", "in;", " ", "=", "é", "😀", "&#128;", "&#xD800;", "&#x110000;", "&#0;", "&#1114111;", "&#99999999999;", "&#x0000000000041"]
    texts = [f.format(n.rstrip(";")) for n in html5 for f in ("a &{}; b", "&{}", "&{}x;", "&{}=1&{}1 ".replace("1&{}", "1"))] + ["".join(r.choice(bits) for _ in range(8)) for _ in range(800)] + [None, "", "&", "no"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.expr(unescaped("t")).alias("text"), F.expr(unescaped("t", True)).alias("value"))
    assert "Python" not in docs._jdf.queryExecution().executedPlan().toString()
    for x in docs.collect():
        t = texts[x["i"]]
        assert (x["text"], x["value"]) == ((None, None) if t is None else (decode(t), decode(t, True))), t


def test_encoding():
    assert encoding.decode(b"\xef\xbb\xbfa")[0] == "a"
    assert encoding.decode("é".encode(), "utf8") == ("é", "utf-8")
    assert encoding.decode(b"<meta charset=utf-8>\xc3\xa9")[1] == "utf-8"
    assert encoding.decode(b"<meta http-equiv=content-type content='text/html; charset=latin2'>")[1] == "iso-8859-2"
    assert encoding.decode(b"<!-- <meta charset=utf-8> -->\x81\x80") == ("<!-- <meta charset=utf-8> -->\x81€", "windows-1252")
    assert encoding.normalized("utf-7") == "windows-1252" and encoding.normalized("koi8-r") is None


def test_events():
    found = [(e["event"], e["name"] or e["data"]) for e in events_of("<div class=a>Hi <b>x</b></div><br><script>a<b</script></p><!--c-->")]
    assert found == [("start", "div"), ("text", "Hi "), ("start", "b"), ("text", "x"), ("end", "b"), ("end", "div"), ("start", "br"), ("start", "script"), ("text", "a<b"), ("end", "script"), ("end", "p"), ("comment", "c")]


@pytest.mark.parametrize(
    ("selector", "n"),
    [("p", 4), ("#a > p", 2), (".y", 2), ("[class~=x]", 1), ("[lang|=en]", 1), ("li:first-child", 1), ("li:nth-child(2n+1)", 2), ("li + li", 2), ("li ~ li", 2), ("p:not(.y)", 3), ("p:not(section p)", 1),
     ("section > div p", 2), ("div p", 3), ("p:contains(bold)", 1), ("li, b", 4), (":root", 3), ("html:first-child", 0), ("li:last-of-type", 1), ("b:only-child", 1), ("[id^=a][id$=a][id*=a]", 1), ("[class*='']", 0), ("template p", 0)],
)
def test_selectors(nodes, selector, n):
    assert query(nodes.where("k = 1"), selector, "k").count() == n


def test_css_mode(nodes):
    one = nodes.where("k = 1")
    assert query(one, "section > div p", "k", css=True).count() == 3
    assert query(one, "html:first-child", "k", css=True).count() == 0
    assert query(one, "li:nth-last-child(1)", "k", extensions=True).count() == 1
    assert [r["data"] for r in first(query(one, "li", "k"), "k").collect()] == [None]
    assert query(one, "p", "k", within="#a").count() == 2


@pytest.mark.parametrize("selector", ["", " ", "p >", "> p", "p > > b", "[a", "[a='x", "p:bogus", ".", "#", ",p", "p:not(", "!"])
def test_selector_errors(selector):
    with pytest.raises(SelectorError):
        Compiled(selector, "k")


def test_nth():
    assert [nth(x) for x in ("odd", "even", "3", "-n+2", "2n", "n", "x", None)] == [(2, 1), (2, 0), (0, 3), (-1, 2), (2, 0), (1, 0), None, None]


def test_projections(spark, nodes):
    text = {r["k"]: r["text"] for r in project.texts(nodes, "k").collect()}
    assert text == {1: "one two bold deep 1 2 3 t", 2: "", 3: ""}
    own = project.with_text(nodes, "k").where("lname = 'div'").orderBy("pre").first()["text"]
    assert own == "one two bold"
    html = {r["k"]: r["html"] for r in project.compact_html(nodes, "k").collect()}
    assert html[1] == (
        "<!DOCTYPE html><html lang=en><head></head><body><section><div id=a class=\"x y\"><p>one</p><p class=y>two <b>bold</b></p></div><div><div><p>deep</p></div></div></section>"
        "<ul><li>1</li><li>2</li><li>3</li></ul><template></template></body></html>"
    )
    assert html[2] == "<html><head></head><body></body></html>"


#: html, Markdown
MARKDOWN = [
    ("<h1>T</h1><p>a <b>b</b> <em>c</em> <a href=/x>d</a> e*f</p><blockquote>q<br>r</blockquote><ol><li>1<li>2</ol><pre>x`y\n</pre><p>in <code>a`b</code><img src=x>", "# T\n\na **b** *c* [d](/x) e\\*f\n\n> q\n> r\n\n1. 1\n2. 2\n\n```\nx`y\n```\n\nin ``a`b``<img src=x>"),
    ("<blockquote><p>Q<br>R</p><p>S</blockquote>", "> Q\n> R\n>\n> S"),
    ("<br><br><br>", ""), ("a<br><br><br>b", "a\n\n\nb"), ("<p>a <br> b", "a\nb"),
    ("<ul>\n<li>One</li>\n</ul>", "- One"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n\n  - b\n\n\n- c"),
    ("<p><a>text</a></p>", "[text]"), ("<pre>X   \n</pre>", "```\nX\n```"), ("<pre></pre>", "```\n```"),
    ("text<div>b</div>c", "textb\n\nc"), ("a&nbsp;b", "a\xa0b"), ("a <b> c</b>", "a ** c**"),
    ("<script>var x = 1;\nvar y = 2;\n</script>", "var x = 1;\nvar y = 2;"), ("<!--x--><span>Hi</span>", "Hi"),
    ("<hr><h2></h2><p></p>", "---\n\n##"), ("<table><tr><td>A</table>b", "<table><tbody><tr><td>A</td></tr></tbody></table>\n\nb"), ("<template>T</template>", "T"),
    # quotations: white space at their ends and what is deeper within them than a gap falls away
    ("a<blockquote> <br>b</blockquote>c", "a\n\n> b\n\nc"), ("<blockquote>a<blockquote>b<pre>c  \n d</pre></blockquote></blockquote>", "> a\n>\n> > b\n> >\n> > ```\n> > c\n> >  d\n> > ```"),
    ("a<blockquote><br></blockquote>b", "a\n\nb"), ("<blockquote><ul><li>a<ul><li>b</ul></ul></blockquote>", "> - a\n>\n>   - b"), ("<ul><li>x<blockquote><ul><li>y</ul></blockquote></ul>", "- x\n\n> - y"),
    ("<blockquote><script>a \n\nb </script> c</blockquote>", "> a\n>\n> b  c"), ("<blockquote><blockquote>a</blockquote><blockquote></blockquote>b</blockquote>", "> > a\n>\n> b"),
    # texts, marks and white space between them
    ("<b> a </b> <i>b</i>", "** a ** *b*"), ("a<i> b</i>", "a* b*"), ("<p> a \n b\t</p> <p>c", "a b\n\nc"), ("<a href='/x y'>l</a>", "[l](/x y)"), ("<a href>l</a>", "[l]"),
    ("<code>`x</code>", "`` `x ``"), ("<code></code>x", "``x"), ("<code>a <b>b</b>\n</code>", "`a b\n`"), ("<p>\\ _a_ [b]", "\\\\ \\_a\\_ \\[b\\]"), ("<div>a</div> b", "a\n\nb"), ("<h3>a<br>b</h3>", "### a\nb"),
    ("<ul>x<li>a</li><p>no</p><li>b</ul>", "- a\n- b"), ("<ol><li>a<li><li>c</ol>", "1. a\n2.\n3. c"), ("<li>a</li>b", "a\n\nb"), ("<textarea> a *b* </textarea><p>c", "a *b*\n\nc"), ("a <img src='x y'> b", "a <img src=\"x y\"> b"),
    ("<table><tr><td>a<template>t</template></table>", "<table><tbody><tr><td>a<template></template></td></tr></tbody></table>"), ("<template><table><td>a</table></template>", "<table><tbody><tr><td>a</td></tr></tbody></table>"),
    ("<pre>\n\n a</pre>", "```\n\n a\n```"), ("<pre>a\n\n</pre>b", "```\na\n```\n\nb"), ("<pre>   </pre>", "```\n\n```"), ("", ""), (" \n", ""),
]


def test_markdown(spark):
    docs = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKDOWN)], "k int, html string")
    for r in project.to_markdown(docs, "k").collect():
        assert r["markdown"] == MARKDOWN[r["k"]][1], MARKDOWN[r["k"]][0]
    plan = project.to_markdown(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


#: html of a fragment, indented
PRETTY = [
    ("<p>a", "<p>a</p>"), ("  hi  ", "hi"), ("", ""), ("<br>", "<br>"), ("<!--c--> <hr>", "<!--c-->\n<hr>"), ("a<p>b", "a\n<p>b</p>"),
    ("<div>\n<p>a</p> <ul><li>b</ul></div><pre> x\n<b>y</b></pre>", "<div>\n  <p>a</p>\n  <ul>\n    <li>b</li>\n  </ul>\n</div>\n<pre> x\n<b>y</b></pre>"),
    ("<div><p>a</p><span>b</span></div>", "<div><p>a</p><span>b</span></div>"), ("<div><!--c--><p>a</p></div>", "<div><!--c--><p>a</p></div>"), ("<div> <p></p>\n</div>", "<div>\n  <p></p>\n</div>"),
    ("<section><div><p>a</p>b</div></section>", "<section>\n  <div><p>a</p>b</div>\n</section>"), ("<textarea>\n\n a</textarea>", "<textarea>\n a</textarea>"),
    ("<div> \n </div>", "<div> \n </div>"), ("<div><template><p>t</template><p>x&nbsp;</div>", "<div>\n  <template></template>\n  <p>x\xa0</p>\n</div>"), ("<p title='a\"b&' id=\"'\">&lt;&amp;", "<p title='a\"b&amp;' id=\"'\">&lt;&amp;</p>"),
]


def test_pretty(spark):
    docs = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PRETTY)], "k int, html string")
    for r in project.to_html(docs, "k", options=Options(fragment=("div", None))).collect():
        assert r["pretty"] == PRETTY[r["k"]][1], PRETTY[r["k"]][0]
    assert project.to_html(docs.where("k = 6"), "k", options=Options(fragment=("div", None)), indent_size=1).first()["pretty"].startswith("<div>\n <p>a</p>\n <ul>\n  <li>")
    # a match is indented as if it were alone, whatever it stands in
    trees = relation.trees(spark.createDataFrame([(1, "<p>x <b>y</b></p><span><div><ul><li>a</ul></div></span>")], "k int, html string"), "k")
    assert [r["html"] for r in project.selected_html(trees, "div, li, b", "k").orderBy("pre").collect()] == ["<b>y</b>", "<div>\n  <ul>\n    <li>a</li>\n  </ul>\n</div>", "<li>a</li>"]


def test_deep_trees(spark):
    html = "<section>" + "<div>" * 600 + "<p>x</p><template><i>t</i></template>" + "</div>" * 600 + "</section>"
    docs = spark.createDataFrame([(1, html)], "k int, html string")
    trees = relation.trees(docs, "k")
    for css in (False, True):
        assert query(trees, "section p", "k", css=css).count() == 1
    assert query(trees, "p", "k", within="section").count() == 1
    rest = rewrite.remove(trees, "p", "k")
    rows = relation.exploded(rest, "k").orderBy("pre").collect()
    assert rows[0]["last"] == len(rows) - 1 and max(r["depth"] for r in rows) > 600
    assert "<i>" not in project.compact_html(trees, "k").first()["html"] and project.texts(rest, "k").first()["text"] == "t"


def test_each_document_is_parsed_once(spark):
    """The plan of every query over pages has one pass in Python at most, those over stored tables none, but for parses of what is put in."""
    from tagquarry.plans import queries

    for name, made in queries.QUERIES.items():
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        parses = sum(plan.count(kind) for kind in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"))
        stored = name.startswith("stored_") or name == "inserted"
        expected = 0 if stored or "escaped" in name or name == "told_encodings" else 1  # of `replaced` the fragments, of `selector_set` the selectors
        assert parses == expected, name


def test_edits(spark):
    docs = spark.createDataFrame([(1, "<ul><li>a<li>b</ul><p>c"), (2, "<p>z")], "k int, html string")
    trees = relation.trees(docs, "k")
    parts = relation.trees(spark.createDataFrame([(1, "<li class=n>n <b>m</b></li>x")], "k int, html string"), "k", options=Options(fragment=("ul", None)))
    at = {r["lname"]: r["pre"] for r in query(trees, "ul, li:first-child, p", "k").where("k = 1").collect()}
    for how, place, html in (
        ("append", "ul", "<ul><li>a</li><li>b</li><li class=n>n <b>m</b></li>x</ul><p>c</p>"), ("before", "li", "<ul><li class=n>n <b>m</b></li>x<li>a</li><li>b</li></ul><p>c</p>"), ("replace", "li", "<ul><li class=n>n <b>m</b></li>x<li>b</li></ul><p>c</p>"),
    ):
        edits = parts.select("k", F.lit(at[place]).alias("at"), F.lit(how).alias("how"), "tree")
        out = {r["k"]: r["html"] for r in project.compact_html(rewrite.edited(trees, edits, "k"), "k").collect()}
        assert out == {1: f"<html><head></head><body>{html}</body></html>", 2: "<html><head></head><body><p>z</p></body></html>"}
    copies = rewrite.cloned_nodes(trees, "ul", "k")
    assert project.compact_html(copies.withColumnRenamed("k", "j"), "j").first()["html"] == "<ul><li>a</li><li>b</li></ul>"
    assert rewrite.cloned_nodes(trees, "ul", "k", deep=False).first()["tree"][0]["is_empty"]
    assert project.selected_html(trees, "li", "k").orderBy("pre").first()["html"] == "<li>a</li>"
    assert project.selected_markdown(trees, "ul", "k").first()["markdown"] == "- a\n- b"
    rows = relation.exploded(trees, "k").where("k = 1")
    ul = rows.where("lname = 'ul'")
    assert project.children(rows, ul, "k").count() == 2 and project.parents(rows, ul, "k").first()["lname"] == "body"


def test_numbers_from_order_and_depth(spark):
    """Numbers and ordinals as the parser gives them, of trees that have lost all but order and depths."""
    trees = relation.trees(spark.createDataFrame(random_pages(5, 60), "k int, html string"), "k")
    lost = trees.withColumn("tree", F.transform("tree", lambda x: x.withField("pre", F.lit(7)).withField("last", F.lit(7)).withField("parent", F.lit(7)).withField("prev", F.lit(7)).withField("sib_idx", F.lit(7)).withField("elem_idx", F.lit(7)).withField("is_empty", F.lit(None).cast("boolean")).withField("is_top", F.lit(None).cast("boolean")).withField("host", F.lit(None).cast("int"))))
    expected = {r["k"]: r["tree"] for r in trees.collect()}
    for r in rewrite.numbered(lost, ["k"]).collect():
        assert r["tree"] == expected[r["k"]]
    assert rewrite.numbered(lost.withColumn("tree", F.slice("tree", 1, 0)), ["k"]).where("size(tree) > 0").count() == 0


def test_many_edits(spark):
    """Several at one place, in order; within what is replaced, at nodes that aren't there, in templates; other documents are left alone."""
    docs = spark.createDataFrame([(1, "<ul><li>a<b>c</b></ul><template><i>t</i></template><p>"), (2, "<p>z"), (3, "")], "k int, html string")
    trees = relation.trees(docs, "k").cache()
    at = {r["lname"]: r["pre"] for r in query(trees, "ul, li, b, template, p", "k").where("k = 1").collect()}
    cases = [
        (0, "append", "ul", "<li>1"), (1, "append", "li", "<u>2</u>x"), (2, "append", "ul", "<li>3"), (3, "before", "b", "<hr>"), (4, "before", "b", "<br>"), (5, "append", "template", "<s>4</s>"), (6, "append", "p", "5"),
        (7, "replace", "p", "<h2>6</h2>"), (8, "replace", "p", "7"), (9, "before", "p", "8"), (10, "append", "nowhere", "9"),
    ]
    edits = spark.createDataFrame([(1, o, at.get(p, 999), h, x) for o, h, p, x in cases], "k int, ord int, at int, how string, html string")
    parsed = relation.trees(edits.select("ord", "html"), "ord", options=Options(fragment=("ul", None)))
    given = edits.drop("html").join(parsed, "ord")
    expected = "<html><head></head><body><ul><li>a<hr><br><b>c</b><u>2</u>x</li><li>1</li><li>3</li></ul><template><s>4</s></template><h2>6</h2>78</body></html>"
    for found in (trees, relation.exploded(trees, "k")):
        done = rewrite.edited(found, given, "k")
        assert set(done.columns) == set(found.columns)
        out = {r["k"]: r["html"] for r in project.compact_html(done, "k").collect()}
        assert out == {1: expected, 2: "<html><head></head><body><p>z</p></body></html>", 3: "<html><head></head><body></body></html>"}
    assert [r["data"] for r in query(rewrite.edited(trees, given, "k"), "template ~ h2", "k").collect()] == [None]
    new = rewrite.edited(trees, given, "k")
    again = {r["k"]: r["tree"] for r in rewrite.numbered(new, ["k"]).collect()}
    assert {r["k"]: r["tree"] for r in new.collect()} == again


def test_edits_are_not_carried_through_the_numbering(spark):
    """Each step copies the rows it is given: no more is in them than the new tree, and the old one where there are no edits."""
    found = relation.trees(spark.createDataFrame([(1, "<h1>a</h1>"), (2, "<p>b")], "k long, html string"), "k")
    new = relation.trees(spark.createDataFrame([(1, "<h2>c</h2>")], "k long, html string"), "k", options=relation.Options(fragment=("div", None)))
    edits = query(found, "h1", "k").selectExpr("k", "pre as at", "'replace' as how").join(new, "k")
    done = rewrite.edited(found, edits, "k")
    node, names = done._jdf.queryExecution().optimizedPlan(), []
    while node.children().size() == 1:
        if node.nodeName() == "Generate":
            names.append(node.output().mkString(" "))
        node = node.children().head()
    after = [n for n in names if "levels#" in n]
    assert after and not any("edits#" in n for n in after)
    assert {r["k"]: [x["name"] for x in r["tree"] if x["kind"] == "element"] for r in done.collect()} == {1: ["html", "head", "body", "h2"], 2: ["html", "head", "body", "p"]}


def test_sql_functions(spark):
    from tagquarry.functions import sql

    sql.register(spark)
    assert spark.sql("select html_to_text('<p>a<b>b'), html_unescape('&lt;')").first()[:] == ("a b", "<")
    spark.createDataFrame([(1, "<h1>x</h1><blockquote>a<br>b"), (2, None)], "k int, html string").createOrReplaceTempView("some_html")
    assert [r[:] for r in spark.sql("select k, html_to_markdown(html) as m from some_html order by k").collect()] == [(1, "# x\n\n> a\n> b"), (2, "")]
    assert [tuple(r["attrs"][0]) for r in spark.sql("select attrs from some_html, lateral html_events('<p id=a>') where k = 1").collect()] == [("id", "a")]
    assert [r["lname"] for r in spark.sql("select lname from parse_html('<p id=a>x') where kind = 'element' order by pre").collect()] == ["html", "head", "body", "p"]
    assert spark.sql("select count(*) from html_events('<p>x</p>')").first()[0] == 3


def test_transport(spark):
    docs = spark.createDataFrame([(1, bytearray(b"<p>\xe9"))], "k int, html binary")
    assert project.texts(relation.trees(docs, "k", options=Options(transport="iso-8859-2")), "k").first()["text"] == "\u00e9"
    assert relation.documents(docs, "k", transport="latin2").first()["encoding"] == "iso-8859-2"


def test_errors_and_strict(spark):
    docs = spark.createDataFrame([(1, "<!DOCTYPE html><p>ok"), (2, "<p a a></b>")], "k int, html string")
    found = relation.errors(docs, "k").orderBy("k", "ord").collect()
    assert [(r["k"], r["source"], r["code"]) for r in found] == [(2, "tokenizer", "duplicate-attribute"), (2, "treebuilder", "expected-doctype-but-got-start-tag"), (2, "treebuilder", "unexpected-end-tag")]
    status = {r["k"]: r["status"] for r in relation.documents(docs, "k", options=Options(strict=True)).collect()}
    assert status == {1: "ok", 2: "rejected"}


def test_error_ranges(spark):
    """The tag around an error, by looking back and forth from it."""
    def by_hand(text, col):
        start = col - 1
        if text[start : start + 1] != "<" and "<" in text[max(0, start - 11) : start]:
            start = text.rindex("<", 0, start)
        end = text.find(">", col - 1)
        return start + 1, (end if end >= 0 else max(len(text), col - 1) - 1) + 2

    lines = ["<p a=1 a=2>x", "x</b>", "no tag here", "<" + "y" * 10 + "z", "<" + "y" * 11 + "z", "", "a<b", "<a><b>c"]
    docs = spark.createDataFrame([(1, "\r\n".join(lines))], "k int, html string")
    places = [(1, i, c) for i, t in enumerate(lines, 1) for c in range(1, len(t) + 2)] + [(1, 99, 1)]
    found = relation.highlighted(spark.createDataFrame(places, "k int, line int, col int"), docs, "k").collect()
    assert len(found) == len(places)
    for r in found:
        if r["line"] == 99:
            assert r["err_text"] is r["offset"] is r["end_offset"] is None
        else:
            assert r["err_text"] == lines[r["line"] - 1] and (r["offset"], r["end_offset"]) == by_hand(r["err_text"], r["col"]), r


def test_rewrites(spark, nodes):
    one = nodes.where("k = 1")
    rest = rewrite.remove(one, "section, template", "k")
    assert project.texts(rest, "k").first()["text"] == "1 2 3"
    assert [r["pre"] for r in rest.orderBy("pre").collect()] == list(range(rest.count()))
    assert query(rest, "body > ul > li", "k").count() == 3
    ul = query(one, "ul", "k").first()["pre"]
    added = spark.createDataFrame([(1, ul, "element", "hr", None)], "k int, at int, kind string, name string, data string")
    more = rewrite.insert(one, added, "k")
    assert query(more, "ul > hr:last-child", "k").count() == 1
    assert query(rewrite.set_attribute(one, F.col("lname") == "li", "class", F.lit("z")), "li.z", "k").count() == 3


def test_streaming_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"<p>{i}<b>x") for i in range(20)], "k int, html string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streaming.pages(spark, str(tmp_path / "in"), docs.schema, 1)
    streaming.written(streaming.parsed(stream, "k"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == relation.nodes(docs, "k").count()


def test_command_line(spark, tmp_path, capsys):
    from tagquarry import cli

    (tmp_path / "a.html").write_text("<p>a<p>b")
    assert cli.main([str(tmp_path), "--selector", "p", "--format", "text"], spark) == 0
    assert capsys.readouterr().out == "a\nb\n"
    assert cli.main([str(tmp_path), "--selector", "p", "--first"], spark) == 0
    assert capsys.readouterr().out == "<p>a</p>\n"
    assert cli.main([str(tmp_path), "--selector", "p:bogus"], spark) == 2
    assert cli.main([str(tmp_path), "--selector", "table"], spark) == 1
    assert cli.main([str(tmp_path), "--selector", "table", "--output", str(tmp_path / "none")], spark) == 1
    assert cli.main([str(tmp_path / "a.html"), "--selector", "p", "--format", "markdown", "--output", str(tmp_path / "some")], spark) == 0
    assert "".join(p.read_text() for p in (tmp_path / "some").glob("part-*")) == "a\n\nb\n\n"


def test_text_of_deep_trees(spark):
    """The time of :contains and of texts is linear in the nodes, however deep they are: 20,000 levels, each with a text."""
    deep = "".join(f"<span>{'needle' if i == 15_000 else 'x'}" for i in range(20_000))
    trees = relation.trees(spark.createDataFrame([(1, deep)], "k int, html string"), "k")
    assert query(trees, "span:contains(needle)", "k").count() == 15_001
    assert query(trees, "span:contains('x needle x')", "k").agg(F.max("pre")).first()[0] == 4 + 2 * 14_999
    assert query(trees, "span span:contains('needle')", "k", text="t", only_first=True).first()["t"].count("x") == 19_998
    assert project.markdown(trees, "k").first()["markdown"].startswith("xxxx")
    assert project.pretty_html(trees, "k").first()["pretty"].endswith("</span></body>\n</html>")


def test_contains_by_brute_force(spark):
    """Texts that overlap themselves and run over several nodes, against the text of each subtree."""
    r = random.Random(8)
    docs = [(k, "".join(r.choice(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "a", "aa", " ", "a b", "<template>", "</template>", "&lt;[", "\\"]) for _ in range(40))) for k in range(60)]
    trees = relation.trees(spark.createDataFrame(docs, "k int, html string"), "k")
    texts = {(x["k"], x["pre"]): x["text"] for x in project.with_text(trees, "k").where("kind = 'element'").collect()}
    for needle in ("a", "aa", "a a", "a a a", "a b", "b a", "<", "\\", "a <[ a", " ", "zz"):
        found = {(x["k"], x["pre"]) for x in query(trees, f"*:contains('{needle}')", "k", css=True).collect()}
        assert found == {at for at, text in texts.items() if needle in text}, needle
    rows = relation.exploded(trees, "k").where("kind = 'text'").collect()
    last = {(x["k"], x["pre"]): x["last"] for x in relation.exploded(trees, "k").collect()}
    for at, text in texts.items():
        inside = sorted((x["pre"], x["data"].strip()) for x in rows if x["k"] == at[0] and at[1] < x["pre"] <= last[at])
        assert text == " ".join(t for _, t in inside if t)


def random_pages(seed, n):
    r = random.Random(seed)
    tags = ["div", "p", "b", "ul", "li", "span", "template", "table", "td"]

    def piece():
        t = r.choice(tags)
        return r.choice([f"<{t}>", f"<{t} class='x {r.choice('yz')}'>", f"<{t} id={r.choice('ab')}>", f"</{t}>", "a", "b a", " ", "<!--c-->", "<br>"])

    return [(k, "<!DOCTYPE html>" * (k % 2) + "".join(piece() for _ in range(r.randint(0, 60)))) for k in range(n)]


def test_rows_of_nodes_answer_like_trees(spark):
    """Structural joins on rows against arrays, on random trees, and without gathering documents."""
    trees = relation.trees(spark.createDataFrame(random_pages(1, 40), "k int, html string"), "k").cache()
    rows = relation.exploded(trees, "k").cache()
    r = random.Random(2)
    simple = ["div", "p", "*", ".x", ".y", "#a", "li:first-child", "b:last-of-type", ":nth-child(2n+1)", ":empty", "span:not(.x)", ":not(div p)", ":contains(a)", ":contains('a b')", "td"]
    found = 0
    for i in range(30):
        selector = r.choice(simple) + "".join(r.choice([" ", " > ", " + ", " ~ "]) + r.choice(simple) for _ in range(r.randint(0, 3)))
        options = {"css": bool(i % 2), "within": r.choice([None, None, "div", ".x p"])}
        expected = {(x["k"], x["pre"]) for x in query(trees, selector, "k", **options).select("k", "pre").collect()}
        some = query(rows, selector, "k", **options)
        assert {(x["k"], x["pre"]) for x in some.select("k", "pre").collect()} == expected, (selector, options)
        found += bool(expected)
    assert found > 15
    plan = query(rows, "div p > b ~ li + li", "k", within="div")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert query(rows, "p", "k", only_first=True).count() == query(trees, "p", "k", only_first=True).count()


def test_selector_sets_match_like_single_selectors(spark):
    from tagquarry.plans import selector_sets

    trees = relation.trees(spark.createDataFrame(random_pages(3, 30), "k int, html string"), "k").cache()
    r = random.Random(4)
    simple = ["div", "p", "*", ".x", ".y", "#a", "li:first-child", "b:last-of-type", ":nth-child(2n+1)", ":nth-child(-n+2)", "span:not(.x)", "[class~=y]", "[class^='x ']", "[id]", "[id=b]", ":empty", "p:only-child", "td", ":root", "li:not(:first-child)", "b.x.z"]
    chosen = {"".join([r.choice(simple)] + [r.choice([" ", " > ", " + ", " ~ "]) + r.choice(simple) for _ in range(r.randint(0, 3))]) for _ in range(25)} | {"p, div > b, .x"}
    rules = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(chosen))] + [(100, "p >"), (101, "p:contains(a)"), (102, None)], "rule int, text string")
    found = {}
    for x in selector_sets.matched(trees, rules, "k", "rule", "text").collect():
        assert (x["k"], x["pre"]) not in found.setdefault(x["rule"], set())
        found[x["rule"]].add((x["k"], x["pre"]))
    for i, text in enumerate(sorted(chosen)):
        assert found.get(i, set()) == {(x["k"], x["pre"]) for x in query(trees, text, "k").select("k", "pre").collect()}, text
    assert len(found) > 10 and max(found) < 100
    errors = {x["rule"]: x["error"] for x in selector_sets.steps_of(rules, "rule", "text").where("error is not null").collect()}
    assert set(errors) == {100, 101, 102}
    keys = {x["rule"]: x["key"] for x in selector_sets.steps_of(spark.createDataFrame([(1, "p > a.z[href='/x']#i"), (2, "a[href=/x].z"), (3, "p.z"), (4, "div *"), (5, "p:not(#i)")], "rule int, text string"), "rule", "text").collect()}
    assert keys == {1: "id i", 2: "attr href /x", 3: "class z", 4: "any", 5: "tag p"}
