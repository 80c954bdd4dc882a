"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample (FIT_ROWS rows): a node projects its rows on
the difference of two of them and cuts at the median. All rows are then indexed by
their leaf in each tree. A query goes down all trees with one shared priority queue,
ordered by the least distance to a cut on the way, until VISITS leaves are
found; their rows are ranked by exact distance in double precision.

Equal vectors are indexed once, with their smallest ids, one more than the neighbours
asked for; no query can need others, so this is exact. Leaves are split into blocks of
BLOCK rows or so, queries into parts of QUERIES, and the two meet by leaf and block, so no
task gathers an unbounded group. VISITS leaves hold VISITS / (TREES * LEAVES) of the index in
each tree, so a query is compared with fewer rows than there are; on vectors without any
structure, as in the tables at hand, less would cost recall.

Null, empty and zero vectors and those with null or non-finite components take no
part, nor do those whose length is not the most frequent one. Repeated vec_ids count
as rows of their own; a query leaves out all rows with its own id. Null ids take no part.
An empty table gives no rows; columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_group, join_by_share, saved, table

#: Rows that the forest is fitted on, trees, leaves of a tree, about, leaves that a query visits, rows of a block, and queries that meet them in one group.
FIT_ROWS, TREES, LEAVES, VISITS, BLOCK, QUERIES = 50_000, 8, 256, 224, 4096, 200_000


@dataclass
class Tree:
    normal: np.ndarray
    cut: np.ndarray
    left: np.ndarray  # of a leaf: -1
    right: np.ndarray  # of a leaf: its number


def grown(x: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    normal, cut, left, right = [], [], [], []
    leaves = 0

    def node() -> int:
        for part, value in ((normal, np.zeros(x.shape[1])), (cut, 0.0), (left, -1), (right, -1)):
            part.append(value)
        return len(cut) - 1

    todo = [(node(), np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        n = None
        if len(rows) > leaf:
            for _ in range(3):
                a, b = random.choice(rows, 2, replace=False)
                n = x[a] - x[b]
                n = n / max(np.linalg.norm(n), 1e-12)
                p = x[rows] @ n
                middle = float(np.median(p))
                if 0 < (p > middle).sum() < len(rows):
                    break
                n = None
        if n is None:
            right[at], leaves = leaves, leaves + 1
            continue
        normal[at], cut[at], left[at], right[at] = n, middle, node(), node()
        todo += [(left[at], rows[p <= middle]), (right[at], rows[p > middle])]
    return Tree(np.array(normal), np.array(cut), np.array(left), np.array(right))


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if tree.left[at] < 0:
            out[rows] = tree.right[at]
            continue
        high = x[rows] @ tree.normal[at] > tree.cut[at]
        todo += [(tree.left[at], rows[~high]), (tree.right[at], rows[high])]
    return out


def search(forest: list[Tree], q: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the nearest leaves of all trees."""
    queue, found = [(0.0, t, 0) for t in range(len(forest))], []
    while queue and len(found) < visits:
        far, t, at = heapq.heappop(queue)
        tree = forest[t]
        while tree.left[at] >= 0:
            margin = float(tree.normal[at] @ q - tree.cut[at])
            near, other = (tree.right[at], tree.left[at]) if margin > 0 else (tree.left[at], tree.right[at])
            heapq.heappush(queue, (max(far, abs(margin)), t, int(other)))
            at = near
        found.append((t, int(tree.right[at])))
    return found


def exact(q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k nearest (distance, id) of rows x with several ids each."""
    rough = ((x - q) ** 2).sum(1)
    line = np.partition(rough, min(k, len(rough)) - 1)[min(k, len(rough)) - 1]
    return sorted((float(np.sqrt(rough[i])), j) for i in np.flatnonzero(rough <= line) for j in ids[i])[:k]


def usable(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) that take part, with a 128-bit key of the vector."""
    fine = "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select("vec_id", F.expr("cast(embedding as array<double>)").alias("v")).where(fine.replace("embedding", "v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    clean = F.expr("transform(v, x -> if(x = 0, 0d, x))")
    rows = rows.where(F.size("v") == (sizes["d"] if sizes else 0)).withColumn("v", clean)
    return rows.withColumn("key", F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.reverse("v"))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int, k: int = 10, trees: int = TREES, visits: int = VISITS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """For the rows whose vec_id is divisible by `every`: query_id, rank, vec_id, score of their k nearest."""
    spark = vectors.sparkSession
    rows = saved(usable(vectors), "vectors")
    first = Window.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    distinct = saved(few.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    total = distinct.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out)
    share = min(1.0, 1.1 * fit_rows / total)
    mixed = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    sample = distinct.where(mixed < share).select("key", "v").orderBy("key").limit(fit_rows).select("v").toPandas()["v"]
    x = np.array(sample.tolist(), np.float32) if len(sample) else np.zeros((0, 1), np.float32)
    random = np.random.default_rng(11)
    leaf = max(16, -(-len(x) // LEAVES))
    forest = [grown(x, leaf, random) for _ in range(trees)] if len(x) else [Tree(np.zeros((1, 1)), np.zeros(1), np.array([-1]), np.array([0]))]
    blocks = max(1, -(-total // (LEAVES * BLOCK)))
    shared = spark.sparkContext.broadcast(forest)
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "key")
    asked = saved(queries.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "asked")
    parts = max(1, -(-asked.count() // QUERIES))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = _matrix(part.column(0))
                for t, tree in enumerate(shared.value):
                    leaf = leaves_of(tree, x) | (t << 32)
                    for i in range(parts):
                        where = pa.array(part.column(1).to_numpy() * parts + i, pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(leaf), where, part.column(0), part.column(2), pa.nulls(part.num_rows, pa.string())], names=["leaf", "block", "v", "ids", "query"])

    schema = "leaf long, block int, v array<double>, ids array<long>, query string"
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    index = distinct.select("v", block.alias("block"), "ids").mapInArrow(indexed, schema)

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [search(shared.value, q, visits) for q in _matrix(part.column(0))]
                leaf = [t << 32 | n for f in found for t, n in f for _ in range(blocks)]
                which = [i * parts + q for f, q in zip(found, part.column(2).to_pylist()) for _ in f for i in range(blocks)]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) * blocks for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(which, pa.int32()), part.column(0).take(take), pa.nulls(len(leaf), pa.list_(pa.int64())), part.column(1).take(take)], names=["leaf", "block", "v", "ids", "query"])

    visits_df = distinct.join(asked.select("key"), "key", "left_semi").select("v", "key", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(parts)).cast("int").alias("part")).mapInArrow(visiting, schema)

    def ranked(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asks = np.array(b.column(4).is_valid().to_pylist())
        if asks.all() or not asks.any():
            return
        x, v = _matrix(b.column(2).filter(pa.array(~asks))), _matrix(b.column(2).filter(pa.array(asks)))
        ids, names = b.column(3).filter(pa.array(~asks)).to_pylist(), b.column(4).filter(pa.array(asks)).to_pylist()
        for at in range(0, len(v), 1024):
            found = [(n, *p) for n, q in zip(names[at : at + 1024], v[at : at + 1024]) for p in exact(q, x, ids, k + 1)]
            yield pa.RecordBatch.from_pydict({"key": [f[0] for f in found], "score": pa.array([f[1] for f in found], pa.float64()), "vec_id": pa.array([f[2] for f in found], pa.int64())})

    found = by_group(index.unionByName(visits_df), ["leaf", "block"], ranked, "key string, score double, vec_id long").distinct()
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    lists = saved(lists.join(asked, "key"), "lists")
    total = asked.agg(F.sum("rows")).first()[0] or 0
    answered = join_by_share(queries, lists, "key", "rows", total, F.col("vec_id"))
    own = F.expr(f"slice(filter(near, x -> x.vec_id <> vec_id), 1, {k})")
    return answered.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("pos", "near")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 100)
