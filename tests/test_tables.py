import random

import pytest
from pyspark.sql import functions as F

from tagquarry.plans import queries
from tagquarry.functions import charsets, encoding, tables
from tagquarry.operators import relation


def test_encodings_of_random_bytes(spark):
    """The expressions tell and decode what the byte-wise rules do, whatever stands where."""
    r = random.Random(5)
    bits = [b"<meta ", b"charset", b"CHARSET", b"=", b'"', b"'", b"utf-8", b"latin1", b" UTF-16 ", b"utf-32", b"iso-8859-2", b"euc-jp", b">", b"/", b"<", b"<!--", b"-->", b" ", b"\n", b"http-equiv", b"content-type", b"content", b"text/html; charset=latin2", b";"]
    bits += [b"x", b"\xe9", b"\x81", b"\x80", b"\xe3\x81\x82", b"\xf0\x9f\x98\x80", b"\xd8\x00", b"\x00\xdc", b"<META charset=utf8>", b"</meta charset=utf-8>", b'<a b="<meta charset=utf8>">', b"\0", b"a" * 1000, b"\xed\xa0\x80", b"\xa0"]
    rows = []
    for i in range(1500):
        c = b"".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        if i % 5 == 0:
            c = r.choice([b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"]) + c
        elif i % 7 == 0:
            c = b"<meta http-equiv=Content-Type content='" + c.replace(b"'", b"") + b"'>"
        elif i % 13 == 0:
            c = r.randbytes(r.randint(0, 60))
        rows.append((i, bytearray(c), r.choice([None] * 6 + ["utf8", " UTF-16 ", "latin2", "euc-jp", "utf-16be", "windows-1252", "nope", ""])))
    rows += [(1500, None, "utf8"), (1501, bytearray(b"\xff\xfe" + "a\U0001f600é".encode("utf-16le")), None), (1502, bytearray("a\U0001f600é".encode("utf-16be")), "utf-16be"), (1503, bytearray(b"x" * 300_000 + b"\xe9<meta charset=utf-8>"), None)]
    docs = spark.createDataFrame(rows, "k int, html binary, label string")
    got = {x["k"]: tuple(x["told"])[:2] for x in charsets.with_text(docs, "html", "told", "label").collect()}
    wanted = {k: (None, None) if c is None else encoding.decode(bytes(c), t) for k, c, t in rows}
    assert {k: (got[k], wanted[k]) for k in got if got[k] != wanted[k]} == {} and len(got) == len(rows)
    alone = charsets.with_text(docs, "html", "told", "label", python=False)
    assert "Python" not in alone._jdf.queryExecution().executedPlan().toString()
    left = {x["encoding"] for x in alone.where("told.text is null and html is not null").select("told.encoding").distinct().collect()}
    assert left <= {"euc-jp", "utf-16", "utf-16le", "utf-16be"}


def test_bytes_are_parsed_as_their_texts(spark):
    docs = spark.createDataFrame([(1, bytearray(b"\xef\xbb\xbf<p>\xc3\xa9")), (2, bytearray(b"<meta charset=euc-jp><p>\xa4\xa2")), (3, None), (4, bytearray())], "k int, html binary")
    assert sorted((r["k"], r["data"]) for r in relation.nodes(docs, "k").where("kind = 'text'").collect()) == [(1, "é"), (2, "あ")]
    assert {r["k"]: (r["encoding"], r["text"]) for r in relation.documents(docs, "k").collect()} == {1: ("utf-8", "<p>é"), 2: ("euc-jp", "<meta charset=euc-jp><p>あ"), 3: (None, None), 4: ("windows-1252", "")}


@pytest.fixture(scope="module")
def functions(spark):
    spark.udtf.register("html_events", tables.html_events())
    spark.udtf.register("parse_html", tables.parse_html())
    spark.createDataFrame([(1, "a", "<p id=a>x"), (2, None, None)], "k int, `d.e` string, html string").createOrReplaceTempView("some_docs")
    parts = [(1, "u", 2, "d=a>x"), (1, "u", 1, "<p i"), (None, "u", 1, "<b>"), (1, "u", 3, "</p>"), (1, None, 1, None), (2, "u", 1, "<i"), (2, "u", 2, None), (2, "u", 3, ">")]
    spark.createDataFrame(parts, "k int, `a b` string, at int, part string").createOrReplaceTempView("some_parts")

    def run(sql: str) -> list[tuple]:
        return sorted((tuple(r) for r in spark.sql(sql).collect()), key=repr)

    return run


def test_calls_for_one_document(functions):
    assert functions("select count(*) from html_events('<p>x</p>')") == [(3,)]
    assert functions("select k, e.event, e.data from some_docs, lateral html_events(html, fields => 'event, data') e") == [(1, "start", None), (1, "text", "x")]
    assert functions("select attrs from html_events('x<p>', fields => 'attrs')") == [(None,), ([],)]


def test_calls_for_a_table(functions):
    assert functions("select * from html_events(table(some_docs), column => 'html', fields => 'event, name')") == [(1, "a", "start", "p"), (1, "a", "text", None)]
    assert functions("select * from html_events(table(some_docs), 'HTML', '`d.e`', 'name')") == [("a", "p"), ("a", None)]
    assert functions("select k, count(*) from parse_html(table(some_docs), keys => 'k') group by k") == [(1, 6), (2, 4)]
    assert functions("select html, lname from parse_html(table(some_docs), keys => 'k, html', fields => 'kind, lname') where kind = 'element' and k = 1") == [("<p id=a>x", n) for n in ("body", "head", "html", "p")]
    assert functions("select * from html_events(table(select * from some_docs where k > 5))") == []


def test_documents_in_pieces(functions):
    """Each group of equal keys, nulls included, is one document, its pieces in order."""
    found = functions("select k, `a b`, name, get(attrs, 0).value, data from html_events(table(some_parts), column => 'part', pieces => 'at', fields => 'name, attrs, data')")
    assert found == sorted([(1, "u", "p", "a", None), (1, "u", None, None, "x"), (1, "u", "p", None, None), (None, "u", "b", None, None), (2, "u", "i", None, None)], key=repr)
    sizes = functions("select k, `a b`, count(*) from parse_html(table(some_parts), column => 'part', pieces => 'at', fields => 'pre') group by 1, 2")
    assert sizes == sorted([(1, "u", 6), (1, None, 4), (None, "u", 5), (2, "u", 5)], key=repr)


@pytest.mark.parametrize("call, why", [
    ("table(some_docs), column => 'x'", "no column x"), ("table(some_docs), keys => 'k, y'", "no column y"), ("table(some_docs), fields => 'event, z'", "there is no z"),
    ("table(select k as name, html from some_docs)", "name would occur twice"), ("table(some_docs), column => 'k'", "strings or bytes"), ("'<p>', keys => 'k'", "are for tables"), ("table(select at, part from some_parts), column => 'part', pieces => 'at'", "no key"),
])
def test_errors_of_analysis(spark, functions, call, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"select * from html_events({call})")


def test_only_named_columns_reach_python(spark):
    docs = spark.range(3).select("id", F.lit("<p>").alias("html"), F.lit("wide").alias("other"))
    found = tables.html_events()(docs.asTable(), column=F.lit("html"), keys=F.lit("id"), fields=F.lit("name"))
    assert found.columns == ["id", "name"] and "wide" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3


def test_stored_nodes_are_dealt_by_size(spark, monkeypatch):
    from tagquarry.plans import structural

    found = queries.stored_nodes(spark, "/root/testdata/sf0.001")
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(structural, "SHARE", size // 40)
    assert structural.selected(found, "nav li + li a", "page_id").rdd.getNumPartitions() >= 40


def test_selector_sets_parse_pages_once(spark, monkeypatch):
    """The set is made from the stored trees that it is matched against, not from nodes of another parse."""
    def second(s, d):
        raise AssertionError("parsed again")

    monkeypatch.setattr(queries, "stored_nodes", second)
    assert queries.QUERIES["selector_set"](spark, "/root/testdata/sf0.001").columns == ["rule", "nodes", "pages"]
