"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's k-grams of code points are hashed by doubling: the hash of 2m points follows
from the hashes of two runs of m, so k-gram hashes take log2(k) passes instead of k
per position. Of each window of w neighbouring hashes the smallest is chosen, the
rightmost among equals; hash and position share one bigint (hash above, inverted
position below), so a plain minimum chooses both, again by doubling. Any two texts
that share K + W - 1 code points in a row share a fingerprint.

A text with fewer than w hashes is one window; a text shorter than k is one gram. An
empty or null text has no hashes, and two such texts are alike (1). Positions fit 32
bits. For the edited texts of the query, documents are dealt into ranges of doc_id, those
of a doc_id that many rows have into ranges of their texts' hashes, and each range gets a
copy of the document that follows it, so a text moves once. Repeated doc_ids are ordered
by the hash of their text, null doc_ids come last. Very long texts are hashed whole, in
memory in proportion to their length. An empty table gives no rows; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, W = 8, 16
#: Documents in a range, about, and ranges at most: with more documents, ranges hold more.
RANGE_ROWS, RANGES = 1000, 4000
LOW = -(1 << 63)


def _steps(to: int) -> list[int]:
    """By how much to shift an array in turn, so that runs of `to` values come together."""
    m, out = 1, []
    while m < to:
        out.append(min(m, to - m))
        m += out[-1]
    return out


def chosen(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """df with `out`: for each window of `text` in turn, the chosen hash and position in one bigint."""
    df = df.withColumn(out, F.expr(f"case when length({text}) > 0 then split({text}, '') else array() end"))
    *steps, last = _steps(k) or [0]
    for step in steps:
        df = df.withColumn(out, F.expr(f"transform({out}, (x, i) -> hash(x, get({out}, i + {step})))"))
    value = f"hash(x, get({out}, i + {last}))" if last else "hash(x)"
    df = df.withColumn(out, F.expr(f"transform({out}, (x, i) -> shiftleft(cast({value} as bigint), 32) | (4294967295L - i))"))
    df = df.withColumn(out, F.expr(f"slice({out}, 1, case when size({out}) = 0 then 0 else greatest(1, size({out}) - {k - 1}) end)"))
    for step in _steps(w):
        df = df.withColumn(out, F.expr(f"transform({out}, (x, i) -> least(x, get({out}, i + {step})))"))
    return df.withColumn(out, F.expr(f"slice({out}, 1, case when size({out}) = 0 then 0 else greatest(1, size({out}) - {w - 1}) end)"))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, w: int = W) -> DataFrame:
    """df with `out`: an array of (hash int, position bigint, from 0) in order of position."""
    df = chosen(df, text, "__chosen", k, w)
    entry = "named_struct('hash', cast(shiftright(x, 32) as int), 'position', 4294967295L - (x & 4294967295L))"
    return df.withColumn(out, F.expr(f"transform(array_distinct(__chosen), x -> {entry})")).drop("__chosen")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def _digest(selected: str) -> Column:
    return F.md5(F.expr(f"array_join(transform({selected}, x -> hex(x)), ' ')"))


def _hashes(selected: str) -> Column:
    return F.expr(f"array_distinct(transform({selected}, x -> cast(shiftright(x, 32) as int)))")


def _listed(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v > LOW else f"cast('{v}' as bigint)" for v in values) + ")"


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges: `range`, `guest` (the document after the range) and the place `ord`, `tie` in descending doc_id."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("ord")).withColumn("tie", F.xxhash64("text"))
    total = rows.count()
    cuts = min(RANGES, total // RANGE_ROWS)
    at, within = F.lit(0), F.lit(0)
    if cuts > 1:
        bounds = rows.agg(F.percentile_approx("ord", [i / cuts for i in range(1, cuts)], 100 * cuts)).first()[0]
        at = F.expr(f"size(filter({_listed(sorted(set(bounds)))}, b -> b < ord))")
        # an ord at several cuts is one that many rows have: as many cuts among their ties, at most `cuts` in all
        many = {v: n for v, n in Counter(bounds).items() if n > 1}
        if many:
            finest = max(many.values())
            ties = rows.where(F.col("ord").isin(list(many))).groupBy("ord").agg(F.percentile_approx("tie", [i / finest for i in range(1, finest)], 100 * finest).alias("ties")).collect()
            some = [(r["ord"], sorted({r["ties"][i * finest // many[r["ord"]] - 1] for i in range(1, many[r["ord"]])})) for r in ties]
            rows = rows.join(F.broadcast(spark.createDataFrame(some, "ord long, ties array<bigint>")), "ord", "left")
            within = F.expr("coalesce(size(filter(ties, b -> b >= tie)), 0)")
    # later ranges hold what comes first in the order
    rows = rows.withColumn("range", F.struct(at.cast("int").alias("at"), within.cast("int").alias("within"))).select("doc_id", "text", "ord", "tie", "range")
    # a row a range: its first document
    tops = sorted((r["range"], r["top"]) for r in rows.groupBy("range").agg(F.max(F.struct("ord", F.expr("~tie").alias("not_tie"))).alias("top")).collect())
    guests = [(*tops[i][0], *tops[i - 1][1]) for i in range(len(tops))]
    first = spark.createDataFrame(guests, "to_at int, to_within int, top long, not_tie long")
    copies = rows.where(F.col("ord").isin([g[2] for g in guests])).join(F.broadcast(first), (F.col("ord") == F.col("top")) & (F.expr("~tie") == F.col("not_tie")))
    copies = copies.select("doc_id", "text", "ord", "tie", F.struct(F.col("to_at").alias("at"), F.col("to_within").alias("within")).alias("range"), F.lit(True).alias("guest")).dropDuplicates(["range", "ord", "tie"])
    return rows.withColumn("guest", F.lit(False)).unionByName(copies)


def edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of docs (doc_id, text), of their edited texts and how alike they and the next document are."""
    order = Window.partitionBy("range").orderBy("guest", F.desc("ord"), "tie", "text")
    df = with_next(docs).withColumn("next", F.lead("text").over(order))
    df = df.withColumn("n", F.length("text")).withColumn("half", F.expr("n div 2").cast("int"))
    df = df.withColumn("edited", F.when(F.col("guest"), "").otherwise(F.expr("concat(substring(text, 1, n - half), substring(coalesce(next, ''), 1, half))"))).drop("next")
    # windows that lie within the kept half choose in the edited text what they choose in the text
    df = df.withColumn("same", F.expr(f"greatest(0, n - half - {w + k - 2})"))
    df = chosen(df, "text", "own", k, w)
    df = df.withColumn("kept", F.expr("slice(own, 1, same)")).withColumn("own", F.expr("array_distinct(own)"))
    df = df.withColumn("tail", F.expr("substring(edited, same + 1)")).withColumn("short", F.expr(f"same > 0 and length(tail) < {w + k - 1}"))
    df = df.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("has", F.expr("length(edited)")).drop("edited", "text")
    df = chosen(df, "tail", "more", k, w).drop("tail")
    df = df.withColumn("more", F.expr("array_distinct(concat(kept, case when short then array() when same > 0 then transform(more, x -> x - same) else more end))")).drop("kept")
    df = df.withColumn("hashes", _hashes("own")).withColumn("edited_hashes", _hashes("more"))
    df = df.withColumn("fingerprint", _digest("own")).withColumn("edited_fingerprint", _digest("more")).drop("own", "more")
    df = df.withColumn("next_hashes", F.lead("hashes").over(Window.partitionBy("range").orderBy("guest", F.desc("ord"), "tie", "fingerprint")))
    return df.where(~F.col("guest")).select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
