"""CSS selectors: text to a plan on the driver, the plan to array expressions over `trees`.

A compound selector is a predicate on a node. Of a selector with combinators, each step
makes an array of flags, one a node of the document: > and + look up the flag of the parent
or of the sibling element before, a space and ~ that of the nearest fitting node on that
way. So a document is parsed once and nothing is shuffled. As in the engine whose queries
this answers, a step commits to the nearest match (`css`: any match). Doctypes count as
elements unless `css` is set. Unknown pseudo-classes and bad syntax raise SelectorError
when compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relation import TREE, Steps, attribute, nearest
from . import folds

#: What str.strip() and str.split() take for white space.
WS = r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


class SelectorError(ValueError):
    pass


@dataclass
class Simple:
    kind: str  # tag, any, id, class, attr, pseudo
    name: str = ""
    op: str = ""
    value: str | None = None


@dataclass
class Complex:
    compounds: list[list[Simple]] = field(default_factory=list)
    combinators: list[str] = field(default_factory=list)  # between compounds


IDENT = re.compile(r"[A-Za-z0-9_\-\u0080-\U0010ffff]+")
OPERATOR = re.compile(r"[~|^$*]?=")


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, why: str) -> SelectorError:
        return SelectorError(f"{why} at {self.at} in {self.text!r}")

    def space(self) -> bool:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in " \t\n\r\f":
            self.at += 1
        return self.at > start

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def ident(self) -> str:
        m = IDENT.match(self.text, self.at)
        if not m:
            raise self.fail("a name is missing")
        self.at = m.end()
        return m[0]

    def parse(self) -> list[Complex]:
        self.space()
        if self.at == len(self.text):
            raise SelectorError("empty selector")
        found = []
        if self.peek() == ",":
            raise self.fail("a selector is missing")
        while True:
            found.append(self.complex())
            while self.space() or self.peek() == ",":
                if self.peek() == ",":
                    self.at += 1
            if self.at == len(self.text):
                return found

    def complex(self) -> Complex:
        out = Complex()
        if self.peek() in (">", "+", "~") and self.peek():
            raise self.fail("a combinator without a left side")
        out.compounds.append(self.compound())
        while True:
            gap = self.space()
            c = self.peek()
            if not c or c == ",":
                return out
            if c in ">+~":
                self.at += 1
                self.space()
                if not self.peek() or self.peek() in ">+~,":
                    raise self.fail("a combinator without a right side")
            elif gap:
                c = " "
            else:
                raise self.fail("unexpected character")
            out.combinators.append(c)
            out.compounds.append(self.compound())

    def compound(self) -> list[Simple]:
        out: list[Simple] = []
        while c := self.peek():
            if c == "*":
                self.at += 1
                out.append(Simple("any"))
            elif c == "#":
                self.at += 1
                out.append(Simple("id", self.ident()))
            elif c == ".":
                self.at += 1
                out.append(Simple("class", self.ident()))
            elif c == "[":
                out.append(self.attribute())
            elif c == ":":
                out.append(self.pseudo())
            elif IDENT.match(c):
                if out:
                    raise self.fail("a tag must come first")
                out.append(Simple("tag", self.ident().lower()))
            else:
                break
        if not out:
            raise self.fail("unexpected character")
        return out

    def quoted(self, quote: str) -> str:
        out = []
        self.at += 1
        while (c := self.peek()) != quote:
            if not c:
                raise self.fail("a string is not closed")
            if c == "\\":
                self.at += 1
                c = self.peek()
            out.append(c)
            self.at += 1
        self.at += 1
        return "".join(out)

    def attribute(self) -> Simple:
        self.at += 1
        self.space()
        name = self.ident()
        self.space()
        if self.peek() == "]":
            self.at += 1
            return Simple("attr", name)
        operator = OPERATOR.match(self.text, self.at)
        if not operator:
            raise self.fail("an operator is missing")
        self.at = operator.end()
        self.space()
        if self.peek() in ("'", '"') and self.peek():
            value = self.quoted(self.peek())
        else:
            m = re.compile(r"[^\s\]]+").match(self.text, self.at)
            if not m:
                raise self.fail("a value is missing")
            value, self.at = m[0], m.end()
        self.space()
        if self.peek() != "]":
            raise self.fail("] is missing")
        self.at += 1
        return Simple("attr", name, operator[0], value)

    def pseudo(self) -> Simple:
        self.at += 1
        name, value = self.ident().lower(), None
        if self.peek() == "(":
            depth, start = 1, self.at + 1
            while depth:
                self.at += 1
                c = self.peek()
                if not c:
                    raise self.fail(") is missing")
                depth += (c == "(") - (c == ")")
            value = self.text[start : self.at].strip()
            self.at += 1
        return Simple("pseudo", name, value=value)


def nth(text: str | None) -> tuple[int, int] | None:
    """A and B of An+B; None if it is none."""
    text = (text or "").replace(" ", "").lower()
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    if m := re.fullmatch(r"([+-]?[0-9]*)n([+-][0-9]+)?", text):
        a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
        return a, int(m[2] or 0)
    return (0, int(text)) if re.fullmatch(r"[+-]?[0-9]+", text) else None


def _nth(i: Column, value: str | None) -> Column:
    if (found := nth(value)) is None:
        return F.lit(False)
    a, b = found
    if a == 0:
        fits = i == b
    else:
        fits = ((i - b) % a == 0) & ((i >= b) if a > 0 else (i <= b))
    return F.coalesce(fits, F.lit(False))


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^[{WS}]+", ""), f"[{WS}]+\\z", "")


class TextIndex:
    """The pieces of a document's text in order, and how many come before each node: the text of a subtree is a slice of them.

    To ask which subtrees contain a string, all places where it stands in the whole text are found once; a subtree has it if the first one from its beginning on ends before its end."""

    def __init__(self, steps: Steps, separator: str = " ", strip: bool = True):
        self.steps, self.separator = steps, separator
        data = (lambda x: stripped(x["data"])) if strip else (lambda x: x["data"])
        all_texts = F.transform(F.filter(TREE, lambda x: x["kind"] == "text"), lambda x: F.struct(x["pre"].alias("pre"), data(x).alias("t")))
        texts = steps.add(F.filter(all_texts, lambda p: p["t"] != ""))
        self.pieces = steps.add(F.transform(texts, lambda p: p["t"]))
        steps.add(F.transform(texts, lambda p: p["pre"]))
        self.before = steps.add(F.expr(folds.ranks(steps.last())))

    def of(self, x: Column) -> Column:
        """The text of a node x of a tree and of all below it, script and template content included."""
        low, high = F.get(self.before, x["pre"]), F.get(self.before, x["last"] + 1)
        return F.array_join(F.slice(self.pieces, low + 1, high - low), self.separator)

    def having(self, text: str) -> Callable[[Column], Column]:
        """Whether the text of a node and of all below it contains a string."""
        add = self.steps.add
        gap, n = len(self.separator), len(text)
        lengths = add(F.transform(self.pieces, lambda t: F.length(t) + gap))
        ends = add(running(lengths))
        whole = add(F.array_join(self.pieces, self.separator))
        # cut before each place where it stands, overlapping or not
        cuts = add(F.split(whole, "(?=" + re.escape(text) + ")"))
        stands = add(F.when(F.contains(whole, F.lit(text)), running(F.transform(cuts, F.length))).otherwise(F.array().cast("array<int>")))
        # each place begins where a cut piece ends, the first one at 0 if the text begins with it
        starts = add(F.concat(F.when(whole.startswith(text), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.slice(stands, 1, F.greatest(F.size(stands) - 1, F.lit(0)))))
        edges = F.transform(self.pieces, lambda t, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("at"), F.lit(0).alias("kind"), i.alias("i")))
        merged = F.array_sort(F.concat(edges, F.transform(starts, lambda s, i: F.struct(s.alias("at"), F.lit(1).alias("kind"), i.alias("i")))))
        # in sorted order piece i has i pieces before it, so all others before it are places
        passed = F.filter(F.transform(merged, lambda m, p: F.struct(m["kind"].alias("kind"), (p - m["i"]).alias("n"))), lambda m: m["kind"] == 0)
        ahead = add(F.transform(passed, lambda m: F.get(starts, m["n"]) + n))

        def has(x: Column) -> Column:
            low, high = F.get(self.before, x["pre"]), F.get(self.before, x["last"] + 1)
            return F.coalesce((high > low) & (F.get(ahead, low) <= F.get(ends, high - 1) - gap), F.lit(False))

        return has


def running(numbers: Column) -> Column:
    """Sums up to each of an array's numbers, in rounds that double what has been added."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers) + F.lit(1))).cast("int"))
    return F.aggregate(rounds, numbers, lambda now, r: F.transform(now, lambda v, i: v + F.coalesce(F.get(now, i - F.pow(2, r).cast("int")), F.lit(0))))


def words(value: Column) -> Column:
    return F.filter(F.split(value, f"[{WS}]+"), lambda w: w != "")


def _attr(s: Simple, attrs: Column) -> Column:
    value, v = attribute(s.name, attrs=attrs), F.lit(s.value)
    if not s.op:
        return value.isNotNull()
    if s.op == "=":
        fits = value == v
    elif s.op == "~=":
        fits = F.array_contains(words(value), v)
    elif s.op == "|=":
        fits = (value == v) | value.startswith(s.value + "-")
    elif not s.value:
        fits = F.lit(False)
    else:
        fits = {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[s.op](s.value)
    return F.coalesce(fits, F.lit(False))


INDEXED = {
    "first-child": ("elem_idx",), "last-child": ("elem_ridx",), "only-child": ("elem_idx", "elem_ridx"),
    "first-of-type": ("type_idx",), "last-of-type": ("type_ridx",), "only-of-type": ("type_idx", "type_ridx"),
}
NTH = {"nth-child": "elem_idx", "nth-of-type": "type_idx"}
EXTENSIONS = {"nth-last-child": "elem_ridx", "nth-last-of-type": "type_ridx"}


def unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


class Compiled:
    """A selector over `nodes` rows of documents named by `key`."""

    def __init__(self, selector: str, key: str, css: bool = False, extensions: bool = False):
        self.key, self.css, self.extensions = key, css, extensions
        self.list = Parser(selector).parse()
        self.inner: dict[str, Compiled] = {}
        self.made: Column | str | None = None  # flags that mark() has added to the trees in hand, or the name of a column of rows
        self.having: dict[str, Callable[[Column], Column]] = {}  # what looks up the texts of :contains there
        for c in self.list:
            for compound in c.compounds:
                for s in compound:
                    self.check(s)

    def check(self, s: Simple) -> None:
        if s.kind != "pseudo":
            return
        if s.name == "not":
            if s.value:
                self.inner[s.value] = Compiled(s.value, self.key, self.css, self.extensions)
        elif s.name == "contains":
            if s.value is None:
                raise SelectorError(":contains needs text")
        elif s.name not in (*INDEXED, *NTH, "empty", "root") and not (self.extensions and s.name in EXTENSIONS):
            raise SelectorError(f"Unsupported pseudo-class: {s.name}")

    def local(self) -> bool:
        """Whether a node alone decides."""
        return all(not c.combinators for c in self.list) and all(i.local() for i in self.inner.values())

    def one(self, s: Simple, x: Column) -> Column:
        if s.kind == "tag":
            return x["lname"] == s.name
        if s.kind == "any":
            return F.lit(True)
        if s.kind == "id":
            return F.coalesce(attribute("id", True, x["attrs"]) == s.name, F.lit(False))
        if s.kind == "class":
            return F.coalesce(F.array_contains(words(attribute("class", True, x["attrs"])), s.name), F.lit(False))
        if s.kind == "attr":
            return _attr(s, x["attrs"])
        if s.name in INDEXED:
            out = F.lit(True)
            for index in INDEXED[s.name]:
                out &= F.coalesce(x[index] == 1, F.lit(False))
            return out
        if s.name in NTH or s.name in EXTENSIONS:
            return _nth(x[(NTH | EXTENSIONS)[s.name]], s.value)
        if s.name == "empty":
            return x["is_empty"]
        if s.name == "root":
            return x["is_top"]
        if s.name == "contains":
            text = unquoted(s.value)
            return self.having[text](x) if text else F.lit(True)
        if not s.value:
            return F.lit(True)
        inner = self.inner[s.value]
        return ~(inner.predicate(x) if inner.local() else F.col(inner.made) if isinstance(inner.made, str) else F.get(inner.made, x["pre"]))

    def compound(self, simples: list[Simple], x: Column) -> Column:
        kinds = ["element"] if self.css else ["element", "doctype"]
        out = x["kind"].isin(kinds)
        for s in simples:
            out &= self.one(s, x)
        return out

    def wanted(self) -> set[str]:
        """The texts that :contains asks for."""
        own = {unquoted(s.value) for c in self.list for compound in c.compounds for s in compound if s.kind == "pseudo" and s.name == "contains"}
        return own.union(*(i.wanted() for i in self.inner.values())) - {""}

    def look_up(self, having: dict[str, Callable[[Column], Column]]) -> None:
        self.having = having
        for inner in self.inner.values():
            inner.look_up(having)

    def prepare(self, steps: Steps) -> None:
        """Adds the index of texts, if any is asked for."""
        if texts := self.wanted() - set(self.having):
            index = TextIndex(steps)
            self.look_up(self.having | {t: index.having(t) for t in sorted(texts)})

    def predicate(self, x: Column) -> Column:
        out = F.lit(False)
        for c in self.list:
            out |= self.compound(c.compounds[0], x)
        return out

    def mark(self, steps: Steps) -> Column:
        """Adds an array that says of each node whether it matches."""
        self.prepare(steps)
        for inner in self.inner.values():
            if not inner.local():
                inner.made = inner.mark(steps)
        each = [self._chain(c, steps) for c in self.list]
        return each[0] if len(each) == 1 else steps.add(F.transform(TREE, lambda x: F.exists(F.array(*[F.get(e, x["pre"]) for e in each]), lambda v: v)))

    def fits(self, steps: Steps) -> Callable[[Column], Column]:
        """Whether a node matches; adds what this needs."""
        self.prepare(steps)
        if self.local():
            return self.predicate
        flags = self.mark(steps)
        return lambda x: F.get(flags, x["pre"])

    def _chain(self, c: Complex, steps: Steps) -> Column:
        def fitting(simples: list[Simple]) -> Column:
            return steps.add(F.transform(TREE, lambda x: self.compound(simples, x)))

        def after(now: Column, place: Callable[[Column], Column], simples: list[Simple]) -> Column:
            return steps.add(F.transform(TREE, lambda x: F.coalesce(F.get(now, place(x)), F.lit(False)) & self.compound(simples, x)))

        def neighbour(way: str) -> Callable[[Column], Column]:
            return lambda x: x[way]

        def on_the_way(places: Column) -> Callable[[Column], Column]:
            return lambda x: F.get(places, x["pre"])

        now = fits = fitting(c.compounds[0])
        for n, (combinator, simples) in enumerate(zip(c.combinators, c.compounds[1:]), 1):
            way = "parent" if combinator in "> " else "prev"
            place = neighbour(way) if combinator in ">+" else on_the_way(steps.add(nearest(way, now if self.css else fits)))
            if n < len(c.combinators) and c.combinators[n] in " ~" and not self.css:
                fits = fitting(simples)
            now = after(now, place, simples)
        return now


def _matching(found: DataFrame, selector: str, key: str, within: str | None, css: bool, extensions: bool) -> tuple[Steps, Callable[[Column], Column]]:
    steps = Steps(found, key)
    own = Compiled(selector, key, css, extensions).fits(steps)
    if within is None:
        return steps, own
    inside = steps.add(nearest("parent", Compiled(within, key, css, extensions).mark(steps)))
    return steps, lambda x: F.get(inside, x["pre"]).isNotNull() & own(x)


def query(
    found: DataFrame, selector: str, key: str, *, within: str | None = None, css: bool = False, extensions: bool = False, only_first: bool = False, text: str | None = None, separator: str = " ", strip: bool = True
) -> DataFrame:
    """Nodes of trees (or of rows of nodes) that match, a row each in document order; document roots never match.

    within: only descendants of what another selector matches; only_first: the first match of each document; text: the name of a column for the text of each match.
    Rows of nodes stay rows (structural.py), unless texts are wanted, for which they are gathered by document."""
    if TREE not in found.columns and not text:
        from .structural import selected

        some = selected(found, selector, key, within, css, extensions)
        return first(some, key) if only_first else some
    steps, fits = _matching(found, selector, key, within, css, extensions)
    some = F.filter(TREE, fits)
    if only_first:
        some = F.slice(some, 1, 1)
    if text:
        texts = TextIndex(steps, separator, strip)
        some = F.transform(some, lambda x: x.withField(text, texts.of(x)))
    return steps.trees.select(key, F.inline(some))


def first(found: DataFrame, key: str) -> DataFrame:
    """The first match of each document, of rows that query() gave."""
    return found.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("pre"))).where("__r = 1").drop("__r")


def matches(found: DataFrame, selector: str, key: str, out: str = "matches", within: str | None = None, css: bool = False, extensions: bool = False) -> DataFrame:
    """All nodes with a flag."""
    steps, fits = _matching(found, selector, key, within, css, extensions)
    return steps.trees.select(key, F.inline(F.transform(TREE, lambda x: x.withField(out, F.coalesce(fits(x), F.lit(False))))))


def subtrees(found: DataFrame, selector: str, key: str, deep: bool = True, **options) -> DataFrame:
    """(key, pre, tree): for each match the nodes of its subtree, numbered as in the document; deep=False: itself alone."""
    steps, fits = _matching(found, selector, key, options.get("within"), options.get("css", False), options.get("extensions", False))
    some = F.transform(F.filter(TREE, fits), lambda x: F.struct(x["pre"].alias("pre"), F.slice(TREE, x["pre"] + 1, x["last"] - x["pre"] + 1 if deep else F.lit(1)).alias(TREE)))
    return steps.trees.select(key, F.inline(some))
