"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

The code comes from the counts of all ids (package-merge, codes of MOST bits at most,
so one table lookup decodes an id). A file holds the code lengths and blocks; a block
holds whole documents, how many ids each has, the bit string, and the bit offset of
every STEP-th id, so decoding can start at any of them. All stretches between offsets
are decoded side by side.

Layout, little-endian: MAGIC, u32 ids in the code, u32 size, zlib of one u8 length an
id; then for each block u32 documents, u64 ids, u64 bits, u32 size of the head, head (zlib of
u8 is-null, i64 doc_id, u64 ids for each document, then u64 offsets), the bits in bytes.

Documents are written in ascending doc_id (nulls first, then by a hash of the text for
repeated ids, then as they lie). A null or empty text has just the end id. An empty table
makes no file. Very long texts are encoded whole; a document lies in one block. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import new_path, partitions, saved, table
from .tokens import by_file, loaded, public, stored

MAGIC = b"TQHUFF01"
MOST, STEP = 18, 256
BLOCK_IDS = 1 << 20
END = 0


def code_lengths(counts: np.ndarray, most: int = MOST) -> np.ndarray:
    """Lengths of an optimal code of `most` bits at most; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need codes of over {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    items = counts[order].astype(np.int64)
    levels, row = [], items
    flags = np.ones(len(items), bool)
    for _ in range(most - 1):
        levels.append(flags)
        packed = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((items, packed))
        at = np.argsort(both, kind="stable")
        row, flags = both[at], at < len(items)
    levels.append(flags)
    take = 2 * len(items) - 2
    depth = np.zeros(len(items), np.int64)
    for flags in reversed(levels):
        mine = int(flags[:take].sum())
        depth[:mine] += 1
        take = 2 * (take - mine)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], code, last = code, code + 1, n
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every prefix of `most` bits."""
    ids, sizes = np.zeros(1 << most, np.uint32), np.zeros(1 << most, np.uint8)
    for i in np.flatnonzero(lengths).tolist():
        n = int(lengths[i])
        at = int(codes[i]) << (most - n)
        ids[at : at + (1 << (most - n))], sizes[at : at + (1 << (most - n))] = i, n
    return ids, sizes


def packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Bits, the offset of every STEP-th id, and the number of bits."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    bits = np.empty(total, np.uint8)
    for at in range(0, len(ids), 1 << 16):
        part, size = codes[ids[at : at + (1 << 16)]], n[at : at + (1 << 16)]
        low, high = int(ends[at] - n[at]), int(ends[min(len(ids), at + (1 << 16)) - 1])
        left = np.repeat(ends[at : at + (1 << 16)], size) - 1 - np.arange(low, high)
        bits[low:high] = (np.repeat(part, size) >> left.astype(np.uint32)) & 1
    return np.packbits(bits).tobytes(), (ends - n)[::STEP].astype("<u8"), total


def unpacked(data: bytes, offsets: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray], most: int = MOST) -> np.ndarray:
    ids, sizes = table
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out, at = np.zeros((len(offsets), STEP), np.uint32), offsets.astype(np.int64)
    last = count - (len(offsets) - 1) * STEP
    for i in range(STEP):
        if i == last:  # the last stretch may be shorter
            at = at[:-1]
        if not len(at):
            break
        # 32 bits from the byte hold 25 or more from the bit
        prefix = (words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - most)
        out[: len(at), i] = ids[prefix]
        at = at + sizes[prefix]
    return out.reshape(-1)[:count]


def written_block(docs: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    data, offsets, bits = packed(ids, lengths, codes)
    head = np.array([k is None for k, _ in docs], "u1").tobytes() + np.array([k or 0 for k, _ in docs], "<i8").tobytes()
    head = zlib.compress(head + np.array([len(x) for _, x in docs], "<u8").tobytes() + offsets.tobytes())
    return struct.pack("<IQQI", len(docs), len(ids), bits, len(head)) + head + data


def read_blocks(stream) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The documents of each block of a file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of Huffman-coded ids")
    n, size = struct.unpack("<II", stream.read(8))
    lengths = np.frombuffer(zlib.decompress(stream.read(size)), np.uint8)
    assert len(lengths) == n
    tables = decode_table(lengths, canonical(lengths))
    while first := stream.read(24):
        docs, ids, bits, size = struct.unpack("<IQQI", first)
        head = zlib.decompress(stream.read(size))
        empty, keys, counts = np.frombuffer(head, "u1", docs), np.frombuffer(head, "<i8", docs, docs), np.frombuffer(head, "<u8", docs, 9 * docs)
        found = unpacked(stream.read((bits + 7) // 8), np.frombuffer(head, "<u8", -1, 17 * docs), ids, tables)
        yield [(None if e else int(k), x) for e, k, x in zip(empty, keys, np.split(found, np.cumsum(counts[:-1].astype(np.int64))))]


def stored_in_order(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Ids of docs (doc_id, text) in ascending doc_id, each text encoded once: a file for each range; the manifest (place, file)."""
    rows = docs.select(F.lit(0).alias("mark"), "doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    # rows of one doc_id, and even equal rows, may lie in several ranges
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return stored(rows.select("mark", "doc_id", "text"), path, True, folder)


def id_counts(manifest: DataFrame, size: int, end: int = END) -> np.ndarray:
    """How often each id occurs in all files of ids, end ids included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            for name in b.column(1).to_pylist():
                for _, keys, ids in loaded(name):
                    seen += np.bincount(np.concatenate(ids), minlength=size)
                    seen[end] += len(keys)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"id": pa.array(found, pa.int64()), "n": pa.array(seen[found], pa.int64())})

    out = np.zeros(size, np.int64)
    # a row for each id of the vocabulary at most
    for r in by_file(manifest).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write(manifest: DataFrame, folder: str, lengths: np.ndarray, end: int = END) -> DataFrame:
    """Codes the files of ids, each into one of its own; the manifest: a row a file with its place in the order."""
    shared = manifest.sparkSession.sparkContext.broadcast((lengths, canonical(lengths)))

    def coded(source: str, name: str) -> int:
        sizes, codes = shared.value
        ids, block, held = 0, [], 0
        with begun(name, sizes) as stream:
            for _, keys, found in loaded(source):
                for key, x in zip(keys, found):
                    block.append((key, np.append(x, np.uint32(end))))
                    held += len(x) + 1
                    if held >= BLOCK_IDS:
                        stream.write(written_block(block, sizes, codes))
                        ids, block, held = ids + held, [], 0
            if block:
                stream.write(written_block(block, sizes, codes))
        return ids + held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = f"{folder}/part-{place:06d}-{uuid.uuid4().hex}.huff"  # another try of this task writes another file
                yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "file": [name], "n_ids": pa.array([coded(source, name)], pa.int64())})

    return saved(by_file(manifest).mapInArrow(run, "place long, file string, n_ids long"), "huffman-manifest")


def begun(name: str, lengths: np.ndarray):
    stream = files.create(name)
    head = zlib.compress(lengths.tobytes())
    stream.write(MAGIC + struct.pack("<II", len(lengths), len(head)) + head)
    return stream


def read(manifest: DataFrame) -> DataFrame:
    """A row a document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    rows, before, listed = sorted((r["place"], r["file"], r["n_ids"]) for r in manifest.collect()), 0, []  # a row a file
    for _, name, n in rows:
        listed.append((name, before))
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.reader(name) as stream:
                    for docs in read_blocks(stream):
                        sizes = [len(x) for _, x in docs]
                        starts = start + np.cumsum([0, *sizes])
                        crc = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in docs], pa.int64()), "start": pa.array(starts[:-1], pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                        start = int(starts[-1])

    files_df = spark.createDataFrame(listed, "file string, start long").repartition(max(1, len(listed)))
    return files_df.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public("byte_bpe_50k.json")
    folder = new_path(spark, "huffman")
    ids = stored_in_order(table(spark, sf_dir, "documents"), path, folder)
    return read(write(ids, folder, code_lengths(id_counts(ids, 50257))))
