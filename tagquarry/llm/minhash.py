"""Near-duplicates by HyperMinHash, confirmed on full sets of word shingles.

Texts are lower-cased (A-Z), cut into words, and each becomes the set of 64-bit hashes
of its distinct k-word shingles (a shorter text: its whole sequence). Of BUCKETS
buckets a sketch keeps, for the smallest hash, its leading zeros and MANTISSA bits of
what follows, 16 bits in all. Bands of ROWS registers deal the sketches of the
different sets out, where an empty register borrows that of another bucket; the Jaccard similarity that two sketches show, corrected for
registers that agree by chance, must be near the line; then the sets decide.

Sets that are equal form a class, found by grouping, and only one of a class goes on.
Each class is first compared with one centre: of the members of its band buckets, that
which most others meet. So a large group of copies costs a comparison a member. Buckets
whose members then still lie in different components are cut into cells of bounded size,
to which each member brings its full set once; what isn't of the bucket's main component
is compared there, by sketches and then by sets, and only the links that join components
leave, fewer than a cell has members. A pair is compared in the first bucket that it shares.
Classes of buckets with over WIDE members besides the main component are dealt anew by
their sets' rarest shingles instead, so many that two sets at the line must share one of
them; those that share one are compared by full sets, as pairs where they are few and in
cells where they are many, so no pair of such a bucket is missed. Nothing is capped: a pair
at the line of 0.8 shares no bucket at all with a chance of about 3e-6.

Null texts, and texts without words, have no shingles and link with nothing. Repeated
rows are copies of each other, so those after the first of an id count as kept too.
Rows with a null doc_id get the smallest id of their class's component, or null. Ties
go to the smaller id. Very long texts are hashed whole, some at a time; what is bounded
in a cell is the sum of its sets. Columns besides doc_id and text are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_group, drop, join_by_share, map_texts, mixed, saved, table

BUCKETS, MANTISSA, ROWS = 256, 10, 6
#: Members of a bucket in one side of a cell, and shingles of all of them; members besides the main component from which a bucket is dealt anew.
CELL, CELL_SHINGLES, WIDE = 512, 1 << 19, 4096
#: Members up to which those that share a rare shingle are compared as pairs.
FEW = 64
#: Partners that a centre's set is sent along with.
STAR_PART = 64
#: Registers of unequal hashes that agree: 0.1699 * 2 ** (1 - mantissa bits) of all, for sets of any usual size.
CHANCE = 0.16991948715973909 * 2.0 ** (1 - MANTISSA)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Characters hashed at a time.
CHUNK = 1 << 19


@lru_cache(1)
def byte_values() -> np.ndarray:
    out = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[SPACE] = 0
    return out


def _shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    a = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(a):
        return [np.zeros(0, np.uint64) for _ in texts]
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])
    space = SPACE[a]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    sizes = np.diff(np.append(starts, len(a)))
    place = np.arange(starts[0], len(a)) - np.repeat(starts, sizes)
    powers = np.full(int((ends - starts).max()) + 1, np.uint64(0xD1342543DE82EF95))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = byte_values()[a[starts[0] :]] * powers[np.minimum(place, len(powers) - 1)]
    words = mixed(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.searchsorted(starts, at)
    odd = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        runs += words[i : i + len(runs)] * odd[i]
    runs = mixed(runs)
    out = []
    for i in range(len(texts)):
        low, high = int(first[i]), int(first[i + 1])
        if high - low >= k:
            out.append(np.unique(runs[low : high - k + 1]))
        elif high > low:
            whole = np.uint64((high - low) * 0xA0761D6478BD642F % (1 << 64))
            for w, o in zip(words[low:high], odd):
                whole = np.uint64((int(whole) + int(w) * int(o)) % (1 << 64))
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out, group, size = [], [], 0
    for r in raw:
        if group and size + len(r) > CHUNK:
            out += _shingles(group, k)
            group, size = [], 0
        group.append(r)
        size += len(r)
    return out + (_shingles(group, k) if group else [])


def sketch(found: np.ndarray) -> np.ndarray:
    """Registers: leading zeros, from 1, above the inverted mantissa; 0 if the bucket is empty."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(found):
        h = mixed(found ^ np.uint64(0x5851F42D4C957F2D))
        bucket = (h >> np.uint64(56)).astype(np.int64)
        rest = (h << np.uint64(8)) | np.uint64(128)  # 56 bits, then a one
        zeros = 64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11  # exact: 53 bits
        zeros = np.minimum(zeros, 50)
        mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        value = ((zeros + 1).astype(np.int64) << MANTISSA) | (((1 << MANTISSA) - 1) - mantissa.astype(np.int64))
        both = np.sort(bucket << 32 | value)
        last = np.append(both[1:] >> 32 != both[:-1] >> 32, True)
        out[both[last] >> 32] = both[last] & 0xFFFF
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard similarity of each row of a with each of b, and the registers used."""
    same, used = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for i in range(len(a)):
        filled = (a[i] | b) != 0
        used[i] = filled.sum(1)
        same[i] = ((a[i] == b) & filled).sum(1)
    return np.clip((same / np.maximum(used, 1) - CHANCE) / (1 - CHANCE), 0, 1), used


def may_link(jaccard: np.ndarray, used: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches leave a similarity of `percent` possible: within five standard deviations."""
    line = percent / 100
    return jaccard >= line - 5 * np.sqrt(line * (1 - line) / np.maximum(used, 1))


def _text_name() -> Column:
    """What a text is fetched by, besides its doc_id."""
    return F.xxhash64("text")


def sketches(docs: DataFrame, k: int, carried: list[str]) -> DataFrame:
    """docs (doc_id, text, carried): name, n shingles, two hashes of the set, and its registers."""
    def run(texts: list[str | None]) -> dict[str, list]:
        sets = shingle_sets(texts, k)
        return {
            "n": [len(s) for s in sets], "cid": [int(mixed(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets],
            "check": [int(mixed(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).astype(np.int64)) for s in sets],
            "registers": [sketch(s).tobytes() for s in sets],
        }

    named = docs.select("doc_id", _text_name().alias("name"), "text", *carried)
    return map_texts(named, ["doc_id", "name", *carried], run, "n long, cid long, `check` long, registers binary", 500)


@lru_cache(1)
def _lenders() -> np.ndarray:
    """For each bucket, in which order it asks the others; a row for each turn."""
    return np.argsort(mixed(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), axis=1).T.copy()


def densified(registers: np.ndarray) -> np.ndarray:
    """Registers with their buckets; an empty one borrows from the first filled one that it asks, so it too agrees with probability J."""
    out = registers.astype(np.uint32) << 8 | np.arange(BUCKETS, dtype=np.uint32)
    row, at = np.nonzero((registers == 0) & registers.any(1)[:, None])
    for turn in _lenders():
        if not len(row):
            break
        lender = turn[at]
        value = registers[row, lender]
        has = value != 0
        out[row[has], at[has]] = value[has].astype(np.uint32) << 8 | lender[has].astype(np.uint32)
        row, at = row[~has], at[~has]
    return out


def _band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band."""
    r = densified(registers)[:, : BUCKETS // ROWS * ROWS].reshape(len(registers), -1, ROWS)
    key = np.repeat(np.arange(r.shape[1], dtype=np.uint64)[None], len(r), 0)
    for i in range(ROWS):
        key = mixed(key * np.uint64(65599) + r[:, :, i].astype(np.uint64) + np.uint64(i))
    return key.astype(np.int64)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def bands(classes: DataFrame) -> DataFrame:
    """(key, cid) for each band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                keys = _band_keys(_registers(part.column(1)))
                cid = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), "cid": pa.array(cid)})

    return classes.select("cid", "registers").mapInArrow(run, "key long, cid long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets intersect enough. Pairs are dealt by a, hot ones by parts of their partners; a's set comes first."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("links") / STAR_PART)).cast("int")
    centres = saved(counts.select("a", "links", parts.alias("parts")), "centres")
    total = centres.agg(F.sum("links")).first()[0] or 0
    spread = join_by_share(pairs, centres, "a", "links", total, F.col("b"))
    members = spread.join(sets, spread["b"] == sets["cid"]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("b"), "n", "hashes", F.lit(1).alias("role"))
    heads = centres.join(sets, centres["a"] == sets["cid"]).select("a", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("a").alias("b"), "n", "hashes", F.lit(0).alias("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own, mine = None, np.zeros(0, np.uint64), 0
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, b, n, hashes, role in zip(*(batch.column(i) for i in (0, 2, 3, 4, 5))):
                s = np.frombuffer(hashes.as_buffer(), np.uint64)
                if role.as_py() == 0:
                    centre, own, mine = a.as_py(), s.copy(), n.as_py()
                    continue
                assert centre == a.as_py()
                small, large = (s, own) if len(s) < len(own) else (own, s)
                if not len(small):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (mine + n.as_py() - both):
                    found[0].append(centre)
                    found[1].append(b.as_py())
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    rows = members.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", "role")
    links = saved(rows.mapInArrow(run, "a long, b long"), "links")
    drop(centres)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): large star and small star by turns; root is the smallest node."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("rows")), "least")
        large = join_by_share(both.where("b > a"), least, "a", "rows", 2 * seen[0], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large, "large")
        drop(edges, least)
        least = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows")), "least")
        joined = join_by_share(large, least, "a", "rows", seen[0], F.col("b"))
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = saved(small, "edges")
        drop(large, least)
        if (now := mark(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def tree_roots(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b) that make trees, each b occurring once, below its a: pointers jump until they point at roots."""
    up, total = saved(links.select(F.col("b").alias("node"), F.col("a").alias("root")), "up"), links.count()
    while True:
        rows = up.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
        following = saved(up.select(F.col("node").alias("at"), F.col("root").alias("next")).join(rows, F.col("at") == rows["root"]).select(F.col("at").alias("root"), "rows", "next"), "next")
        if following.isEmpty():
            drop(following)
            return up.unionByName(up.select(F.col("root").alias("node"), "root").distinct())
        jumped = saved(join_by_share(up, following, "root", "rows", total, F.col("node")).select("node", F.coalesce("next", "root").alias("root")), "up")
        drop(up, following)
        up = jumped


def _mixed(members: DataFrame) -> DataFrame:
    """Of members (key, cid, comp, n): the buckets with several components: rows, shingles, largest component, and both besides it."""
    each = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    top = each.groupBy("key").agg(F.max(F.struct("rows", "n", "comp")).alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"))
    found = top.where("comps > 1").select("key", "rows", F.col("rows").alias("size"), F.col("n").alias("weight"), F.col("top.comp").alias("main"), (F.col("rows") - F.col("top.rows")).alias("others"), (F.col("n") - F.col("top.n")).alias("other_weight"))
    return saved(found, "mixed")


def _of_mixed(members: DataFrame) -> DataFrame:
    """The rows of members in buckets with several components, with what _mixed() says of them."""
    keys = _mixed(members)
    total = keys.agg(F.sum("rows")).first()[0] or 0
    return join_by_share(members, keys, "key", "rows", total, F.col("cid")).where("size is not null")


class Roots:
    """Which components one cell has joined."""

    def __init__(self, comps: np.ndarray):
        self.up = {c: c for c in comps.tolist()}

    def find(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = c = self.up[self.up[c]]
        return c


def sizes_of_both(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Intersection size of a sorted set with each of some."""
    if not len(own):
        return np.zeros(len(others), np.int64)
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.diff(np.append(0, np.cumsum(hit))[np.cumsum([0, *map(len, others)])])


def sizes_with_each(others: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Intersection size of a set with each of some that stay the same and aren't empty."""
    names, place = np.unique(np.concatenate(others), return_inverse=True)
    starts = np.cumsum([0, *map(len, others)])[:-1]

    def run(own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        has = np.zeros(len(names), np.int32)
        has[at[names[at] == own]] = 1
        return np.add.reduceat(has[place], starts)

    return run


def _cell(b: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of a cell (key, low, at, rare, side, minor, cid, comp, n, registers, hashes) that join different components.

    rare: its key is a shingle, and all are compared by sets alone; else it is that of a band."""
    key, rare = b.column(0)[0].as_py(), b.column(3)[0].as_py()
    side, minor, cid, comp, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4, 9))
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(10)]
    left, right, roots = np.flatnonzero(side == 0), np.flatnonzero(side == 1), Roots(np.unique(comp))
    links: list[tuple[int, int]] = []
    if rare:
        sizes = sizes_with_each([hashes[j] for j in right])
    else:
        registers = _registers(b.column(9))
        keys = _band_keys(registers)
    for i in left.tolist():
        fine = (comp[right] != comp[i]) & ~(minor[right] & (cid[right] < cid[i]))
        fine &= 100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right])
        among = right[fine]
        if not len(among):
            continue
        if rare:
            both = sizes(hashes[i])[fine]
            for j in among[100 * both >= percent * (n[i] + n[among] - both)].tolist():
                if (other := roots.find(int(comp[j]))) != (own := roots.find(int(comp[i]))):
                    roots.up[other] = own
                    links.append((int(cid[i]), int(cid[j])))
            continue
        jaccard, used = estimates(registers[i : i + 1], registers[among])
        fine = may_link(jaccard[0], used[0], percent)
        same = keys[among] == keys[i]
        fine &= keys[i][same.argmax(1)] == key
        among, jaccard = among[fine], jaccard[0][fine]
        among = among[np.argsort(-jaccard, kind="stable")].tolist()
        for at in range(0, len(among), STAR_PART):
            own = roots.find(int(comp[i]))
            some = [j for j in among[at : at + STAR_PART] if roots.find(int(comp[j])) != own]
            both = sizes_of_both(hashes[i], [hashes[j] for j in some]) if some else []
            for j, k in zip(some, both):
                if 100 * k >= percent * (n[i] + n[j] - k) and (other := roots.find(int(comp[j]))) != (own := roots.find(own)):
                    roots.up[other] = own
                    links.append((int(cid[i]), int(cid[j])))
    yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _cells(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components in the buckets of members (key, cid, comp, rare, and the columns of _mixed()).

    What isn't of the bucket's main component is compared with all of it, in cells of CELL by CELL."""
    def parts(rows: str, weight: str) -> Column:
        return F.greatest(F.ceil(F.col(rows) / CELL), F.ceil(F.col(weight) / CELL_SHINGLES)).cast("int")

    own = members.withColumn("minor", F.col("comp") != F.col("main")).withColumn("wide", parts("size", "weight")).withColumn("high", parts("others", "other_weight"))
    mine = F.xxhash64("cid")
    right = own.select("key", F.explode(F.expr("sequence(0, high - 1)")).alias("low"), F.pmod(mine, F.col("wide")).cast("int").alias("at"), "rare", F.lit(1).alias("side"), "minor", "cid", "comp")
    left = own.where("minor").select("key", F.pmod(mine, F.col("high")).cast("int").alias("low"), F.explode(F.expr("sequence(0, wide - 1)")).alias("at"), "rare", F.lit(0).alias("side"), "minor", "cid", "comp")
    rows = left.unionByName(right).join(classes.select("cid", "n", "registers"), "cid").join(sets.select("cid", "hashes"), "cid")
    rows = rows.select("key", "low", "at", "rare", "side", "minor", "cid", "comp", "n", "registers", "hashes")
    return by_group(rows, ["key", "low", "at"], lambda b: _cell(b, percent), "a long, b long")


def _rarest(wide: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, cid, comp, n) of classes (cid, comp, n): a row for each of a set's rarest shingles among these, of which a set at the line with it shares one, as

    it shares percent of either, so all but that and one more are left out; and in one order of all shingles the first that both have stands among both's rarest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                found = np.frombuffer(b.column(3)[row].as_buffer(), np.int64)
                for at in range(0, len(found), CHUNK):
                    part = found[at : at + CHUNK]
                    same = [pa.array(np.full(len(part), b.column(i)[row].as_py(), np.int64)) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *same], names=["key", "cid", "comp", "n"])

    each = saved(wide.join(sets.select("cid", "hashes"), "cid").select("cid", "comp", F.col("n").cast("long").alias("n"), "hashes").mapInArrow(run, "key long, cid long, comp long, n long"), "shingles")
    counts = saved(each.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).withColumn("often", F.col("rows")), "shingle-counts")
    placed = join_by_share(each, counts, "key", "rows", counts.agg(F.sum("rows")).first()[0] or 0, F.col("cid"))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("often", "key")))
    rare = saved(placed.where(f"place <= n - ({percent} * n + 99) div 100 + 1 and often > 1").select("key", "cid", "comp", "n"), "rarest")
    drop(each, counts)
    return rare


def _rare_links(wide: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components among classes (cid, comp, n): all whose sets are at the line, but where others join their components."""
    rare = _rarest(wide, sets, percent)
    met = saved(_of_mixed(rare), "met")
    few = met.where(F.col("size") <= FEW)
    other = few.select("key", F.col("cid").alias("b"), F.col("comp").alias("other"), F.col("n").alias("m"))
    near = f"comp <> other and cid < b and 100 * least(n, m) >= {percent} * greatest(n, m)"
    pairs = saved(few.join(other, "key").where(near).select(F.col("cid").alias("a"), "b").distinct(), "rare-pairs")
    links = _verified(pairs, sets, percent)
    many = _cells(met.where(F.col("size") > FEW).withColumn("rare", F.lit(1).cast("long")), classes, sets, percent)
    out = saved(links.unionByName(many), "rare-links")
    drop(rare, met, pairs, links)
    return out


def _stars(stars: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The confirmed ones of links (a, b); each b occurs once."""
    small = classes.select(F.col("cid").alias("b"), "n", "registers")
    counts = saved(stars.groupBy("a").agg(F.count(F.lit(1)).alias("rows")).join(classes.select(F.col("cid").alias("a"), F.col("n").alias("an"), F.col("registers").alias("ar")), "a"), "star-centres")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    with_both = join_by_share(stars, counts, "a", "rows", total, F.col("b")).join(small, "b").select("a", "b", "an", "n", "ar", "registers")

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _registers(b.column(4)), _registers(b.column(5))
                filled = (x | y) != 0
                used = filled.sum(1)
                same = ((x == y) & filled).sum(1)
                n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
                fine = may_link(np.clip((same / np.maximum(used, 1) - CHANCE) / (1 - CHANCE), 0, 1), used, percent)
                fine &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                yield pa.RecordBatch.from_pydict({"a": b.column(0).filter(pa.array(fine)), "b": b.column(1).filter(pa.array(fine))})

    pairs = saved(with_both.mapInArrow(plausible, "a long, b long"), "star-pairs")
    links = _verified(pairs, sets, percent)
    drop(stars, counts, pairs)
    return links


def _first_stars(shared: DataFrame, total: int) -> DataFrame:
    """A pair (a, b) for each class b of shared (key, cid, size): a is, of all members of its buckets, that which most others meet.

    By (others met, cid) an a stands above its b, so the pairs make trees."""
    met = saved(shared.join(shared.groupBy("cid").agg(F.sum("size").alias("met")), "cid").groupBy("key").agg(F.max(F.struct("met", "cid")).alias("top"), F.count(F.lit(1)).alias("rows")), "met")
    chosen = join_by_share(shared, met, "key", "rows", total, F.col("cid")).groupBy("cid").agg(F.max("top").alias("top"))
    stars = saved(chosen.select(F.col("top.cid").alias("a"), F.col("cid").alias("b")).where("a <> b"), "stars")
    drop(met)
    return stars


def _named(shared: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    found = shared.join(nodes, shared["cid"] == nodes["node"], "left").select("key", "cid", F.coalesce("root", "cid").alias("comp"))
    return found.join(classes.select("cid", "n"), "cid").select("key", "cid", "comp", "n")


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The components of nodes (node, root) with more links (a, b); removes both."""
    if not links.limit(1).count():
        return nodes
    out = saved(components(nodes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "components")
    drop(nodes, links)
    return out


def linked(docs: DataFrame, k: int = 4, percent: int = 80, carried: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id and kept; and carried columns with `group`, one value a component."""
    sketched = saved(sketches(docs, k, list(carried)), "sketches")
    classes = saved(sketched.where("n > 0").groupBy("cid", "check", "n").agg(F.min("registers").alias("registers")), "classes")
    own = saved(sketched.select("doc_id", "name", "n", "cid", *carried), "own")
    drop(sketched)
    # a smaller set is at the line with equal ones only
    banded = saved(bands(classes.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("n") + 1))), "bands")
    buckets = saved(banded.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("size", F.col("rows")), "buckets")
    total = buckets.agg(F.sum("rows")).first()[0] or 0
    shared = saved(join_by_share(banded, buckets, "key", "rows", total, F.col("cid")).where("size is not null"), "shared")
    drop(banded, buckets)
    # full sets of the classes that share a bucket with another, from one row of each
    one = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "name")).alias("one")
    needed = shared.select("cid").distinct().join(own.groupBy("cid").agg(one), "cid").select("cid", "one.*")
    texts = docs.select("doc_id", _text_name().alias("name"), "text").join(needed.where("not nameless").drop("nameless"), ["doc_id", "name"]).select("cid", "text")
    nameless = docs.where("doc_id is null").select(_text_name().alias("name"), "text").join(needed.where("nameless").select("cid", "name"), "name").select("cid", "text")

    def full(batch: list[str | None]) -> dict[str, list]:
        found = shingle_sets(batch, k)
        return {"n": [len(s) for s in found], "hashes": [s.tobytes() for s in found]}

    sets = saved(map_texts(texts.unionByName(nameless).dropDuplicates(["cid"]), ["cid"], full, "n long, hashes binary", 500), "sets")
    links = _stars(_first_stars(shared, total), classes, sets, percent)
    nodes = saved(tree_roots(links), "components")
    drop(links)
    # members of one bucket that still lie in different components
    members = saved(_named(shared, nodes, classes), "members")
    rest = saved(_of_mixed(members), "rest")
    drop(members)
    if rest.limit(1).count():
        todo = rest.where(F.col("others") <= WIDE).withColumn("rare", F.lit(None).cast("long"))
        nodes = _joined(nodes, saved(_cells(todo, classes, sets, percent), "rest-links"))
        wide = saved(rest.where(F.col("others") > WIDE).select("cid", "n").distinct(), "wide")
        if wide.limit(1).count():
            wide_now = wide.join(nodes, wide["cid"] == nodes["node"], "left").select("cid", F.coalesce("root", "cid").alias("comp"), "n")
            nodes = _joined(nodes, _rare_links(wide_now, classes, sets, percent))
        drop(wide)
    drop(rest, shared, sets, classes)
    # the smallest doc_id of each component
    lowest = own.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    lowest = saved(lowest.join(nodes, lowest["cid"] == nodes["node"], "left").select("cid", "low", "rows", F.coalesce("root", "cid").alias("root")), "lowest")
    roots = saved(lowest.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("classes")), "roots")
    named = saved(join_by_share(lowest, roots, "root", "classes", lowest.count(), F.col("cid")).select("cid", "rows", "component", F.col("root").alias("group")), "named")
    drop(lowest, roots, nodes)
    total = own.count()
    out = join_by_share(own.withColumn("cid", F.when(F.col("n") > 0, F.col("cid"))), named, "cid", "rows", total, F.col("doc_id"))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), *([*carried, "group"] if carried else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
