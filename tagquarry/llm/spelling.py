"""Spelling variants: words one edit apart, grouped by the more frequent form.

Two words are near if one inserted, deleted or replaced code point turns one into the
other. The edit lies in one half of the word, so the other half stands in both: the first
half at the start of both, or the second at the end. Words are therefore dealt out by their
halves, and a task holds all words that could fit its questions. It makes a minimal acyclic
automaton of its words, and one of its words read backward; their words have numbers
(what the branches before hold), by which counts are looked up. A question walks its half
exactly and completes with one error; what several edits reach is one number, and what the
backward walk reaches is left out where the forward walk reaches it too. So no pair of words
is made that isn't near, and a word sends on its number of near words and the best of them.

A half that more than HOT_SHARE of all words have is split: of the rest of the word one half
is intact as well, and the words are dealt out by that too. So a task's words grow with the
share of one half at most, whatever the words are.

Forms point at words at least twice as frequent, so a chain is no longer than the logarithm
of the largest count; roots are found by joins that double the step.

Null text has no words. A null doc_id is written as nothing. Long texts and long runs are
read whole. Repeated rows count as often as they occur. Of near words with the same count
the smallest in code-point order is the form. An empty table gives no rows. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, drop, partitions, saved, table

#: Least code points and occurrences of a word; a document's run loses a code point if this divides its hash.
LEAST, TIMES, DIVISOR = 5, 3, 97
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
#: Words that a task counts before it sends them on; words dealt to a task.
HELD, SHARD = 300_000, 50_000


def written(doc_id: int | None, text: str) -> Counter:
    """The words of a text, and how often. Shorter runs can't become words."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lower: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        lower[run.lower() if run.isascii() else run.translate(LOWER)] += n
    out: Counter = Counter()
    for run, n in lower.items():
        h = zlib.crc32(run.encode(), head)
        if h % DIVISOR == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LEAST:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                for word, n in written(doc_id.as_py(), text.as_py() or "").items():
                    found[word] += n
                if len(found) >= HELD:
                    yield batch(found)
                    found = Counter()
        yield batch(found)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; each edge has the number of words before what it leads to."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}
        # states on the way of the last word, not yet known: (final, edges)
        way: list[list] = [[False, {}]]
        last = ""

        def settle(keep: int) -> None:
            for i in range(len(way) - 1, keep, -1):
                final, edges = way.pop()
                way[-1][1][last[i - 1]] = self._state(known, final, edges)

        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            settle(same)
            way += [[False, {}] for _ in range(len(word) - same)]
            way[-1][0] = True
            last = word
        settle(0)
        self.start = self._state(known, *way[0])

    def _state(self, known: dict[tuple, int], final: bool, edges: dict[str, int]) -> int:
        key = (final, *edges.items())
        if (state := known.get(key)) is None:
            state = known[key] = len(self.edges)
            numbered, n = {}, int(final)
            for c, to in edges.items():
                numbered[c] = (to, n)
                n += self.words[to]
            self.edges.append(numbered)
            self.final.append(final)
            self.words.append(n)
        return state

    def number(self, text: str, state: int, n: int = 0) -> int:
        """The number of the word that `text` completes from a state, -1 if it is none."""
        for c in text:
            if (step := self.edges[state].get(c)) is None:
                return -1
            state, n = step[0], n + step[1]
        return n if self.final[state] else -1

    def near(self, text: str, exact: int) -> set[int]:
        """The numbers of words that start with text[:exact] and have one error after it."""
        state, n = self.start, 0
        for c in text[:exact]:
            if (step := self.edges[state].get(c)) is None:
                return set()
            state, n = step[0], n + step[1]
        found = set()
        for i in range(exact, len(text) + 1):
            edges, own, rest, after = self.edges[state], text[i : i + 1], text[i:], text[i + 1 :]
            for c, (to, skip) in edges.items():
                found.add(self.number(rest, to, n + skip))  # one more
                if own and c != own:
                    found.add(self.number(after, to, n + skip))  # another
            if own:
                found.add(self.number(after, state, n))  # one less
            if (step := edges.get(own)) is None:
                break
            state, n = step[0], n + step[1]
        found.discard(-1)
        return found


def answers(back: bool, texts: list[str], counts: list[int], exact: list[int], past: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count of the best, the best) for each question; rows are sorted by text, each text's rows side by side.

    exact: the length that must fit, 0 if the row asks nothing. past: near words that start with so much are another question's (0: none are)."""
    words, first = [], []
    for i, t in enumerate(texts):
        if not words or t != words[-1]:
            words.append(t)
            first.append(i)
    automaton = Automaton(words)
    for i, t in enumerate(texts):
        if not exact[i]:
            continue
        near = automaton.near(t, exact[i])
        if back:
            half = t[len(t) - len(t) // 2 :]
            near = {x for x in near if not words[x].endswith(half)}
        if past[i]:
            near = {x for x in near if not words[x].startswith(t[: past[i]])}
        if near:
            most = max(counts[first[x]] for x in near)
            best = min(words[x][::-1] if back else words[x] for x in near if counts[first[x]] == most)
            yield t[::-1] if back else t, len(near), most, best


#: The length of the half that must fit, of a word of x code points.
HALF = "cast(if(back, x - x div 2, x div 2) as int)"


def dealt(words: DataFrame, total: int) -> DataFrame:
    """(back, key, text, n, exact, past): each word beside the questions that could find it, in both directions."""
    ways = words.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("text")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("text")))).alias("way"), "n").select("way.*", "n", F.length("way.text").alias("own"))
    halves = F.expr(f"array_distinct(transform(array(own - 1, own, own + 1), x -> {HALF}))")
    rows = ways.select("*", F.explode(halves).alias("half")).select("*", F.expr("left(text, half)").alias("key"), F.expr(f"half = transform(array(own), x -> {HALF})[0]").alias("asks"))
    # a row has one key, so those that over HOT_SHARE of the rows have number 1 / HOT_SHARE at most
    hot = rows.groupBy("back", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > max(SHARD // 2, int(4 * total * HOT_SHARE))).select("back", "key", F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), ["back", "key"], "left")
    plain = marked.where("hot is null").select("back", F.concat(F.lit("0"), "key").alias("key"), "text", "n", F.expr("if(asks, half, 0)").alias("exact"), F.lit(0).alias("past"))
    # of the rest after a hot half, the questions of length x find what keeps the rest's first part, or else its second
    more = f"""array_distinct(flatten(transform(filter(array(own - 1, own, own + 1), x -> {HALF} = half), x -> array(
        struct(concat('1', left(text, half + (x - half) div 2)) as key, if(x = own, cast(half + (x - half) div 2 as int), 0) as exact, 0 as past),
        struct(concat('2', left(text, half), ' ', right(text, x - half - (x - half) div 2)) as key, if(x = own, half, 0) as exact, if(x = own, cast(half + (x - half) div 2 as int), 0) as past)))))"""
    split = marked.where("hot").select("back", "text", "n", F.inline(F.expr(more))).select(*plain.columns)
    return plain.unionByName(split)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones."""
    total = words.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
        if held:
            every = pa.Table.from_batches(held)
            columns = {n: every.column(n).to_pylist() for n in ("back", "text", "n", "exact", "past")}
            cut = columns["back"].index(True) if True in columns["back"] else every.num_rows
            for back, low, high in ((False, 0, cut), (True, cut, every.num_rows)):
                found = list(answers(back, *[columns[n][low:high] for n in ("text", "n", "exact", "past")]))
                if found:
                    yield pa.RecordBatch.from_pydict(dict(zip(("word", "near", "best_n", "best"), zip(*found))))

    tasks = max(partitions(words.sparkSession), -(-4 * total // SHARD))
    parts = dealt(words, total).repartition(tasks, "back", "key").sortWithinPartitions("back", "text").select("back", "text", "n", "exact", "past")
    found = parts.mapInArrow(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.less")).alias("best_n"), F.col("x.best").alias("best"))


def grouped(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n)."""
    fits = F.col("best_n") >= 2 * F.col("n")
    found = saved(words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    # where a word's chain has got to; a word without a form is its own root
    at = saved(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not at.join(further, "root", "left_semi").limit(1).count():
            break
        before, at = at, saved(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        drop(before)
    return found.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(saved(vocabulary(table(spark, sf_dir, "documents")), "words"))
