"""Packing of documents into windows by lexical retrieval.

Documents are encoded as they lie, then dealt into shards by retrieval: each asks a BM25
index of ANCHORS sampled documents and goes to the place of the one that it retrieves
first, there in order of the rare terms that it holds. The order is cut into shards of
bounded size, a task taking many one after the other. A shard is a BM25 inverted index
over its documents' token ids, with document frequencies of the whole corpus. An unused
document (the seed) opens a window; the documents of the shard that are nearest by BM25
over all the seed's terms, and still unused, fill it, nearest first. A document that
passes the window's end is cut there and its rest seeds the next window; an open window
goes on with the next shard's documents. The end of a task's last window is cut at powers
of two, so no sequence needs padding.

A seed retrieves what its shard holds; the README says how often its best neighbour of the
whole corpus lies there. In return the time grows with the table, and nothing but the
vocabulary and the anchors goes through the driver.

A null or empty text is its end id alone and is packed like any other. Equal
documents are packed each for themselves. Very long texts fill several windows. An
empty table gives no rows. Null and repeated doc_ids keep their rows, and no doc_id's
rows need lie in one shard. Columns besides doc_id and text are ignored. Ties in BM25
go to the document first in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import mixed, new_path, partitions, saved, table
from .tokens import by_file, encoder, forget, loaded, public, stored

WINDOW, END, VOCABULARY = 4096, 2, 49408
#: Ids and documents of a shard at most, but for a document that is larger alone.
SHARD_IDS, SHARD_DOCS = 2_000_000, 8000
#: Sampled documents by which the others are dealt.
ANCHORS = 256
#: BM25; the share of an index's documents from which on a term's scores are held for all of them.
K1, B, COMMON = 1.2, 0.75, 1 / 16


def corpus_statistics(manifest: DataFrame, size: int = VOCABULARY) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id, number of documents and their mean length, over all files of ids."""
    width = width_of(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # texts are encoded by now
        seen, n, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for name in b.column(1).to_pylist():
                for _, _, ids in loaded(name):
                    for x in ids:
                        seen[distinct(x, width)[0]] += 1
                        n, total = n + 1, total + len(x) + 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"id": pa.array(np.append(at, [-1, -2]), pa.int64()), "n": pa.array(np.append(seen[at], [n, total]), pa.int64())})

    # a row an id of the vocabulary, and two
    rows = by_file(manifest).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    found = {r["id"]: r["n"] for r in rows}
    df = np.zeros(size)
    for k, n in found.items():
        if k >= 0:
            df[k] = n
    total = found.get(-1, 0)
    return df, total, found.get(-2, 0) / max(1, total)


def distinct(ids: np.ndarray, width: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document, in order, and how often each occurs; narrow integers are sorted by digits."""
    x, n = narrow(ids, width)
    return x.astype(np.int64), n


def narrow(ids: np.ndarray, width: str) -> tuple[np.ndarray, np.ndarray]:
    """distinct() in integers as wide as the ids need."""
    x = np.sort(ids.astype(width), kind="stable")
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[at], np.diff(np.append(at, len(x)))


def lowest_two(x: np.ndarray) -> np.ndarray:
    """The places of the two lowest values, lowest first."""
    at = np.argpartition(x, 1)[:2] if len(x) > 2 else np.arange(len(x))
    return at[np.argsort(x[at], kind="stable")]


def width_of(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


class Index:
    """BM25 over some documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        width = width_of(len(idf))
        terms, tf = zip(*((t, n.astype(np.int32)) for t, n in (narrow(d, width) for d in docs))) if docs else ((), ())
        self.n, self.ends = len(docs), np.cumsum([0, *[len(t) for t in terms]])
        self.terms = np.concatenate([*terms, np.zeros(0, width)])
        count = np.concatenate([*tf, np.zeros(0, np.int32)])
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.ends))
        long = np.array([len(d) for d in docs], np.int64)
        below = np.repeat(K1 * (1 - B + B * long / max(mean, 1e-9)), np.diff(self.ends))
        below += count
        weights = idf[self.terms]
        weights *= count
        weights *= K1 + 1
        weights /= below
        del below, count
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.lists = owner[order].astype(np.int64), weights[order]
        del order
        self.starts = np.append(0, np.cumsum(np.bincount(self.terms, minlength=len(idf))))
        common = np.flatnonzero(np.diff(self.starts) > max(8, COMMON * self.n))
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        held = np.flatnonzero((self.row >= 0)[self.terms])
        self.dense[self.row[self.terms[held]], owner[held]] = weights[held]

    def terms_of(self, doc: int) -> np.ndarray:
        return self.terms[self.ends[doc] : self.ends[doc + 1]].astype(np.int64)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of each document for these terms."""
        row = self.row[terms]
        out = self.dense[row[row >= 0]].sum(0).astype(np.float64)
        rare = terms[row < 0]
        spans = [slice(a, b) for a, b in zip(self.starts[rare].tolist(), self.starts[rare + 1].tolist()) if a < b]
        if spans:
            out += np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.lists[s] for s in spans]), self.n)
        return out

    def nearest(self, terms: np.ndarray, used: np.ndarray, some: int = 64) -> Iterator[int]:
        """Unused documents that share one of the terms, best first; ties to the earlier. `some` are sorted before the others."""
        scores = np.where(used, 0.0, self.scores(terms))
        found = np.flatnonzero(scores)
        if len(found) > some:
            line = -np.partition(-scores[found], some)[some]
            above = found[scores[found] > line]
            yield from above[np.argsort(-scores[above], kind="stable")].tolist()
            found = found[scores[found] <= line]
        yield from found[np.argsort(-scores[found], kind="stable")].tolist()

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        return np.array(list(self.nearest(self.terms_of(seed), used)), np.int64)


def powers(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def chained(index: Index) -> np.ndarray:
    """The places of an index's documents when each is followed by the nearest one that is left."""
    used, place, at = np.zeros(index.n, bool), np.zeros(index.n, np.int64), 0
    for i in range(index.n):
        used[at], place[at] = True, i
        left = np.flatnonzero(~used)
        if len(left):
            at = next(index.nearest(index.terms_of(at), used, 1), int(left[0]))
    return place


def anchors(manifest: DataFrame, total: int, idf: np.ndarray, mean: float) -> tuple[Index, np.ndarray]:
    """The index of ANCHORS documents, drawn by a hash of where they lie, and their places."""
    line = np.uint64(min(1.0, 2 * ANCHORS / max(1, total)) * (2**64 - 2**11))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = 0
                for _, _, ids in loaded(name):
                    h = mixed(np.arange(low, low + len(ids), dtype=np.uint64) + np.uint64(place << 40))
                    low += len(ids)
                    take = [i for i in np.flatnonzero(h <= line).tolist() if len(ids[i])]
                    found = [distinct(ids[i], "<u4") for i in take]
                    yield pa.RecordBatch.from_pydict({
                        "h": pa.array(h[take].astype(np.int64), pa.int64()), "terms": pa.array([t.astype("<u4").tobytes() for t, _ in found], pa.binary()),
                        "tf": pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary()),
                    })

    rows = by_file(manifest).mapInArrow(drawn, "h long, terms binary, tf binary").orderBy("h", "terms").limit(ANCHORS).collect()
    index = Index([np.repeat(np.frombuffer(r["terms"], "<u4"), np.frombuffer(r["tf"], "<u4")) for r in rows], idf, mean)
    return index, chained(index)


class Router:
    """The anchor that a document retrieves first: the anchors' scores by term, in rows."""

    def __init__(self, index: Index, places: np.ndarray, size: int):
        known = np.unique(index.terms)
        self.row, self.n, self.places = np.zeros(size, np.int64), index.n, places
        self.row[known] = np.arange(1, len(known) + 1)
        self.scores = np.zeros((len(known) + 1, index.n), np.float32)
        self.scores[self.row[np.repeat(np.arange(size), np.diff(index.starts))], index.docs] = index.lists

    def place(self, terms: np.ndarray) -> int:
        rows = self.row[terms]
        rows = rows[rows > 0]
        return int(self.places[self.scores[rows].sum(0).argmax()]) if self.n and len(terms) else 0


class Filler:
    """Gives a task's documents, (doc_id, ids with the end id) in order, to windows; rows are pieces."""

    def __init__(self, idf: np.ndarray, mean: float, window: int, first_sequence: int):
        self.idf, self.mean, self.window, self.sequence = idf, mean, window, first_sequence
        self.open: list[tuple[object, np.ndarray, int, int, int]] = []  # doc_id, ids, start, length, offset
        self.filled, self.terms, self.rows = 0, None, []

    def _emit(self, held: list, cut: list[int]) -> None:
        """Makes rows of pieces in a row, cut into sequences of these sizes."""
        ends = np.cumsum([0, *cut])
        for key, ids, start, length, offset in held:
            while length:
                i = int(np.searchsorted(ends, offset, "right")) - 1
                part = min(length, int(ends[i + 1]) - offset)
                crc = zlib.crc32(ids[start : start + part].tobytes())
                self.rows.append((key, start, part, crc, len(ids), self.sequence + i, offset - int(ends[i])))
                start, length, offset = start + part, length - part, offset + part
        self.sequence += len(cut)

    def _put(self, key: object, ids: np.ndarray, terms: np.ndarray) -> bool:
        """Puts a document at the end. Whether a window was filled; then its rest, if any, is the new seed."""
        start, done = 0, False
        while start < len(ids):
            part = min(self.window - self.filled, len(ids) - start)
            self.open.append((key, ids, start, part, self.filled))
            start, self.filled = start + part, self.filled + part
            if self.filled == self.window:
                self._emit(self.open, [self.window])
                self.open, self.filled, self.terms, done = [], 0, None, True
        if self.open and self.terms is None:
            self.terms = terms
        return done

    def shard(self, docs: list[tuple[object, np.ndarray]]) -> None:
        index = Index([x[:-1] for _, x in docs], self.idf, self.mean)
        used, first = np.zeros(len(docs), bool), 0
        while True:
            while first < len(docs) and used[first]:
                first += 1
            if first == len(docs):
                return
            if self.terms is not None:
                for doc in index.nearest(self.terms, used):
                    used[doc] = True
                    if self._put(*docs[doc], index.terms_of(doc)):
                        break
                else:  # nothing left shares a term with the seed
                    self.terms = None
                continue
            used[first] = True
            self._put(*docs[first], index.terms_of(first))

    def end(self) -> None:
        if self.open:
            self._emit(self.open, powers(self.filled))
            self.open = []


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """docs (doc_id, text): a row a piece."""
    spark, size = docs.sparkSession, encoder(path, False).size
    width = width_of(size)
    manifest = stored(docs.select(F.lit(0).alias("mark"), "doc_id", "text"), path, False, new_path(spark, "packing"))
    df, total, mean = corpus_statistics(manifest, size)
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    with np.errstate(divide="ignore"):
        rare = -np.log1p(-np.arange(1, size + 1) * 0.6180339887498949 % 1) / idf**2  # a fixed draw for each id, small for rare ones
    shared = spark.sparkContext.broadcast((idf, mean, rare, Router(*anchors(manifest, total, idf, mean), size)))
    kind = docs.schema["doc_id"].dataType
    key_type = to_arrow_type(kind)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, rare, router = shared.value
        for b in batches:
            for place, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = 0
                for _, keys, ids in loaded(name):
                    at = []
                    for x in ids:
                        terms = distinct(x, width)[0]
                        best = router.place(terms)
                        two = terms[lowest_two(rare[terms])].tolist() + [0, 0]
                        at.append(best << 48 | (two[0] & 0xFFFFFF) << 24 | two[1] & 0xFFFFFF)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at, pa.int64()), pa.array([place] * len(at), pa.int64()), pa.array(range(low, low + len(at)), pa.int64()), pa.array(keys, key_type), pa.array([x.astype(width).tobytes() for x in ids], pa.binary())],
                        names=["key", "place", "at", "doc_id", "ids"],
                    )
                    low += len(at)

    order = ["key", "place", "at"]
    schema = StructType([StructField(n, LongType()) for n in order] + [StructField("doc_id", kind), StructField("ids", BinaryType())])
    lying = saved(by_file(manifest).mapInArrow(dealt, schema), "dealt")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filler = Filler(*shared.value[:2], window, TaskContext.get().partitionId() << 32)
        held, count = [], 0

        def made(least: int) -> Iterator[pa.RecordBatch]:
            if len(filler.rows) >= least:
                columns = list(zip(*filler.rows))
                filler.rows = []
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["doc_id", *names])

        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(np.frombuffer(raw.as_buffer(), width), end).astype("<u4")
                if held and (count + len(ids) > SHARD_IDS or len(held) >= SHARD_DOCS):
                    filler.shard(held)
                    held, count = [], 0
                    yield from made(10_000)
                held.append((key, ids))
                count += len(ids)
        filler.shard(held)
        filler.end()
        yield from made(1)

    rows = lying.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return rows.mapInArrow(filled, StructType([StructField("doc_id", kind)] + [StructField(n, LongType()) for n in names]))


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer or public("word_bpe_49k.json"))
