"""Selectors over rows of nodes: structural joins as windows, without gathering a document.

Nodes are intervals (pre, last) that nest. Which interval is the innermost around a node is
found in one pass over a document's nodes in order: a running count of how many fitting
intervals are open gives each node a level, and the last interval opened at that level
before the node is the one around it. A parent is the last node before one, a level higher
up; siblings are windows over their parent. So every step of a selector is a window over
the same partitioning by document, whose rows spill where they must: a document need not fit
a task, and all steps share one shuffle.

`:contains` looks at each text together with as many texts after it as its string can run
over; where that ends first, of all texts from a node on, says whether the node has it.

As in selectors.py, a step commits to the nearest match unless `css` is set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selectors import Compiled, Complex, stripped

BEFORE = (Window.unboundedPreceding, -1)
#: Bytes of stored nodes that a task gets; as rows, with a sort for each step, they take many times that. Beyond so many shares a plan's estimate is taken for no size at all.
SHARE, MOST = 2 << 20, 20_000


class Row:
    """A node as a row: its fields are columns."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


class Marks:
    """Rows of nodes to which columns are added, one for each step."""

    def __init__(self, nodes: DataFrame, key: str):
        self.rows, self.key, self.columns, self.n = nodes, key, nodes.columns, 0

    def name(self) -> str:
        self.n += 1
        return f"__mark{self.n}"

    def add(self, value: Column) -> str:
        name = self.name()
        self.rows = self.rows.withColumn(name, value)
        return name

    def sibling(self, fits: Column, now: Column) -> str:
        """`now` of the last sibling before a node that fits."""
        before = Window.partitionBy(self.key, "parent").orderBy("pre").rowsBetween(*BEFORE)
        return self.add(F.coalesce(F.last(F.when(fits, now), ignorenulls=True).over(before) & F.col("parent").isNotNull(), F.lit(False)))

    def leveled(self, level: Column, gives: Column, value: Column) -> str:
        """`value` of the last row before a node that gives it to the node's level. gives: the level that a row gives it to, or null."""
        name = self.name()
        both = F.array(F.struct(level.alias("level"), F.lit(False).alias("gives")), F.struct(gives.alias("level"), F.lit(True).alias("gives")))
        rows = self.rows.withColumn(name, F.explode(F.filter(both, lambda b: b["level"].isNotNull())))
        before = Window.partitionBy(self.key, F.col(name)["level"]).orderBy("pre").rowsBetween(*BEFORE)
        got = F.last(F.when(F.col(name)["gives"], value), ignorenulls=True).over(before)
        self.rows = rows.withColumn(name + "v", got).where(~F.col(name)["gives"]).withColumn(name, F.coalesce(F.col(name + "v"), F.lit(False))).drop(name + "v")
        return name

    def parent(self, now: Column) -> str:
        """`now` of the parent."""
        name = self.leveled(F.col("depth") - 1, F.col("depth"), now)
        return self.add(F.col(name) & F.col("parent").isNotNull())

    def ancestor(self, fits: Column, now: Column) -> str:
        """`now` of the nearest ancestor that fits; a template's content has none outside."""
        stops = fits | F.col("host").isNotNull()
        step = self.name()
        ends = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("end"), stops.cast("int").alias("change")), F.struct(F.col("last").alias("at"), F.lit(1).alias("end"), F.lit(-1).alias("change")))
        rows = self.rows.withColumn(step, F.explode(F.filter(ends, lambda e: (e["end"] == 0) | stops)))
        order = Window.partitionBy(self.key).orderBy(F.col(step)["at"], F.col(step)["end"]).rowsBetween(*BEFORE)
        self.rows = rows.withColumn(step + "v", F.coalesce(F.sum(F.col(step)["change"]).over(order), F.lit(0))).where(F.col(step)["end"] == 0).drop(step)
        return self.leveled(F.col(step + "v"), F.when(stops, F.col(step + "v") + 1), now & F.col("host").isNull())

    def having(self, texts: list[str], separator: str = " ") -> dict[str, str]:
        """For each string a column that says whether the text of a node and of all below it contains it; all are looked up in the same two passes."""
        piece, is_text = self.add(F.when(F.col("kind") == "text", stripped(F.col("data")))), self.name()
        self.rows = self.rows.withColumn(is_text, F.coalesce(F.col(piece) != "", F.lit(False)))
        ahead = Window.partitionBy(self.key, is_text).orderBy("pre").rowsBetween(0, max(map(len, texts)))
        near = self.add(F.collect_list(F.when(F.col(is_text), F.struct("pre", F.col(piece).alias("t")))).over(ahead))
        joined = self.add(F.when(F.col(is_text), F.array_join(F.transform(near, lambda p: p["t"]), separator)))
        zero = F.struct(F.lit(-len(separator)).alias("length"), F.lit(None).cast("int").alias("pre"))

        def end(text: str) -> Column:
            """The node in whose text the first place ends that begins in this one."""
            at = F.instr(joined, text)

            def longer(a: Column, p: Column) -> Column:
                length = a["length"] + len(separator) + F.length(p["t"])
                return F.struct(length.alias("length"), F.when(a["pre"].isNotNull(), a["pre"]).when(length >= at - 1 + len(text), p["pre"]).alias("pre"))

            return F.when((at > 0) & (at <= F.length(piece) + len(separator)), F.aggregate(near, zero, longer)["pre"])

        ends = {text: self.name() for text in texts}
        self.rows = self.rows.select("*", *[end(text).alias(name) for text, name in ends.items()]).drop(near, piece, is_text, joined)
        after = Window.partitionBy(self.key).orderBy(F.col("pre").desc()).rowsBetween(Window.unboundedPreceding, 0)
        has = {text: self.name() for text in texts}
        self.rows = self.rows.select("*", *[F.coalesce(F.min(ends[t]).over(after) <= F.col("last"), F.lit(False)).alias(name) for t, name in has.items()]).drop(*ends.values())
        return has

    def selected(self, c: Compiled) -> str:
        """The column that says of each node whether a selector matches it."""
        if texts := sorted(c.wanted() - set(c.having)):
            c.look_up(c.having | {text: lambda x, name=name: F.col(name) for text, name in self.having(texts).items()})
        for inner in c.inner.values():
            if not inner.local():
                inner.made = self.selected(inner)
        out = F.lit(False)
        for each in [self.chain(c, one) for one in c.list]:
            out |= F.col(each)
        return self.add(out)

    def chain(self, c: Compiled, one: Complex) -> str:
        now = fits = self.add(c.compound(one.compounds[0], Row()))
        for combinator, simples in zip(one.combinators, one.compounds[1:]):
            place: dict[str, Callable[[], str]] = {
                ">": lambda: self.parent(F.col(now)),
                "+": lambda: self.sibling(F.col("kind").isin("element", "doctype"), F.col(now)),
                "~": lambda: self.sibling(F.col(now if c.css else fits), F.col(now)),
                " ": lambda: self.ancestor(F.col(now if c.css else fits), F.col(now)),
            }
            before = place[combinator]()
            own = self.add(c.compound(simples, Row()))
            now, fits = self.add(F.col(before) & F.col(own)), own
        return now


def dealt(nodes: DataFrame, key: str) -> DataFrame:
    """Rows of nodes by document, in so many partitions that a task's share doesn't grow with the table; a number that is given isn't coalesced again."""
    spark = nodes.sparkSession
    size = int(str(nodes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shares = -(-size // SHARE)
    return nodes.repartition(max(spark.sparkContext.defaultParallelism, shares), key) if shares <= MOST else nodes


def selected(nodes: DataFrame, selector: str, key: str, within: str | None = None, css: bool = False, extensions: bool = False) -> DataFrame:
    """The rows of nodes that a selector matches; within: only descendants of what another selector matches."""
    marks = Marks(dealt(nodes, key), key)
    hit = marks.selected(Compiled(selector, key, css, extensions))
    if within is not None:
        around = F.col(marks.selected(Compiled(within, key, css, extensions)))
        hit = marks.add(F.col(hit) & F.col(marks.ancestor(around, around)))
    return marks.rows.where(hit).select(*marks.columns)
