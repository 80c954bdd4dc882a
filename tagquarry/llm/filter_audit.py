"""How filters interact: what each removes in every order in which they can be applied.

The orders of n filters make a trie whose paths that hold the same filters, in whatever
order, end in the same survivors: 2^n states instead of n! paths. The trie is walked depth
first. A state is a DataFrame of the documents that are left, persisted while its branches
are walked, and made from its parent by one filter; a state that another path has reached
is not made again. In each state one grouped pass counts what every filter not yet applied
removes and keeps, so all n * 2^(n-1) edges are counted on real survivors. The counts are
a written table, a row per (part, filters before, filter); the report joins the orders to it.

At most n + 1 states are persisted at a time. A lost executor's blocks are made again from
the written table of failures, by at most n filters.

A filter is a condition under which a document fails. Documents: null text counts as empty,
null source as the empty part. A document is a copy if a smaller doc_id has the same text
(compared by SHA-256); rows with the same doc_id and text are no copies of each other, and a
null doc_id is neither a copy nor smaller. Repeated rows count as often as they occur; of
repeated labels any that says 1 counts. An empty table has no parts and gives no rows. Long
texts are read whole. Columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved, table

#: White space between words.
SPACES = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D, which look at one text."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic), a narrow row a document."""
    text = F.coalesce("text", F.lit(""))
    each = saved(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), *[c.alias(n) for n, c in text_failures(text).items()]), "failures")
    # a text's first document joins by both, so a text with many copies is no hot key
    firsts = each.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id", "sha", F.lit(True).alias("first"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = each.join(firsts, ["doc_id", "sha"], "left").join(said, "doc_id", "left")
    no = F.lit(False)
    return found.select("part", "A", "B", "C", "D", (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def edges(survivors: DataFrame, names: str, applied: frozenset[str]) -> DataFrame:
    """(part, before, filter, removed, kept, good_lost, toxic_lost) of each filter that can come next. before: the number with a bit for each filter applied."""
    new = [f for f in names if f not in applied]
    counts = {"removed": lambda f: F.col(f), "kept": lambda f: ~F.col(f), "good_lost": lambda f: F.col(f) & F.col("good"), "toxic_lost": lambda f: F.col(f) & F.col("toxic")}
    by_part = survivors.groupBy("part").agg(*[F.count_if(c(f)).alias(f"{f}_{n}") for f in new for n, c in counts.items()])
    rows = [F.struct(F.lit(bits(names, applied)).alias("before"), F.lit(f).alias("filter"), *[F.col(f"{f}_{n}").alias(n) for n in counts]) for f in new]
    return by_part.select("part", F.inline(F.array(*rows)))


def bits(names: str, some: frozenset[str]) -> int:
    return sum(1 << i for i, f in enumerate(names) if f in some)


def walked(rows: DataFrame, names: str) -> Iterator[DataFrame]:
    """The edges out of each state, depth first; a state stays persisted until its branches have been walked."""
    reached: set[frozenset[str]] = set()

    def visit(survivors: DataFrame, applied: frozenset[str]) -> Iterator[DataFrame]:
        reached.add(applied)
        survivors.persist()
        yield edges(survivors, names, applied)
        for f in names:
            if f not in applied and len(applied) + 1 < len(names) and applied | {f} not in reached:
                yield from visit(survivors.where(~F.col(f)).drop(f), applied | {f})
        survivors.unpersist()

    yield from visit(rows, frozenset())


def counted(rows: DataFrame, names: str) -> DataFrame:
    """The counts of all edges as a written table."""
    path = new_path(rows.sparkSession, "edges")
    for found in walked(rows, names):
        found.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def audit(rows: DataFrame, names: str = LETTERS) -> DataFrame:
    """A row per part, order and step. rows: (part, a boolean per filter that says whether it fails, good, toxic)."""
    spark, n = rows.sparkSession, len(names)
    orders = [("".join(o), i + 1, o[i], bits(names, frozenset(o[:i]))) for o in permutations(names) for i in range(n)]
    # n * n! rows, whatever the table
    steps = spark.createDataFrame(orders, "filter_order string, step int, filter string, before int")
    found = counted(rows, names)
    size = F.bit_count("before")
    paths = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    # a filter has 2^(n-1) edges in a part; a state without documents of the part has none
    each = found.groupBy("part", "filter").agg(
        F.map_from_entries(F.collect_list(F.struct("before", F.struct("removed", "kept", "good_lost", "toxic_lost")))).alias("at"),
        F.sum(F.col("removed") * paths).alias("shapley"),
        F.sum(F.when(size == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(size == n - 1, F.col("removed")).otherwise(0)).alias("unique_fails"),
    )
    here = F.try_element_at("at", "before")
    value = {c: F.coalesce(here[c], F.lit(0)).cast("long") for c in ("kept", "removed", "good_lost", "toxic_lost")}
    return each.join(F.broadcast(steps), "filter").select(
        "part", "filter_order", "step", value["kept"].alias("kept"), value["removed"].alias("removed"), (F.col("fails") - value["removed"]).alias("redundant"),
        "unique_fails", value["good_lost"].alias("good_lost"), value["toxic_lost"].alias("toxic_lost"), "shapley",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(saved(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "audited"))


#: Documents that fail alike are counted together, and each step sums over these counts.
SQL = r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
judged as (
  select doc_id, part, cast(len(words) < 50 as int) + 2 * cast(100 * len(list_distinct(words)) < 65 * len(words) as int)
    + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) as int) + 8 * cast(regexp_matches(t, '[#$%&*|]') as int)
    + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by t), false) as int) as fails
  from texts),
profiles as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from judged left join said using (doc_id) group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from letters a, letters b, letters c, letters d, letters e
  where a.b | b.b | c.b | d.b | e.b = 31),
steps as (select filter_order, cast(i as int) as step, bits[i] as own, cast(list_sum(bits[: i - 1]) as int) as before from (select filter_order, bits, unnest([1, 2, 3, 4, 5]) as i from orders)),
counts as (
  select part, filter_order, step, own, cast(coalesce(sum(n) filter (fails & (coalesce(before, 0) | own) = 0), 0) as bigint) as kept,
    cast(coalesce(sum(n) filter (fails & coalesce(before, 0) = 0 and fails & own <> 0), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (fails & coalesce(before, 0) <> 0 and fails & own <> 0), 0) as bigint) as redundant,
    cast(coalesce(sum(n) filter (fails = own), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter (fails & coalesce(before, 0) = 0 and fails & own <> 0), 0) as bigint) as good_lost,
    cast(coalesce(sum(toxic) filter (fails & coalesce(before, 0) = 0 and fails & own <> 0), 0) as bigint) as toxic_lost
  from profiles, steps group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from counts
"""
