"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's letters are folded to lower case, runs of anything else to one space; its
bigrams and trigrams are hashed into DIMS buckets, weighted log(1 + tf) * idf and
normalised. Document frequencies come from all labelled rows; the centroids (several
a language, spherical k-means) are fitted on a bounded sample of them. A text goes to
the language of its nearest centroid by cosine. It is rejected if it has no letter or
lies farther from every centroid than documents of its length were seen to lie.

Null, empty and letterless texts: language `und`, score 0, rejected. Without any
labelled row, every text is `und`. Ties go to the language first in sorted order.
Very long texts are counted whole. Rows whose doc_id is null are predicted, not learned.
Repeated rows are learned and predicted each for itself. Other columns pass through. Every
language with a labelled text gets centroids, so the model grows with the number of
languages (98 kB each), not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, table

DIMS = 8192
CENTROIDS = 3
#: Rows that centroids are fitted on, at most: so many a language, fewer where all would be more than so many, yet SAMPLE_LEAST.
SAMPLE_LANGUAGE, SAMPLE_ALL, SAMPLE_LEAST = 400, 4000, 8
#: How far below the least similar sample of like length a text may lie.
SLACK = 0.5
CHUNK = 128


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # languages * k rows
    owner: np.ndarray  # language of each
    floors: np.ndarray  # least cosine by log2 of the number of n-grams


@lru_cache(1)
def folded() -> np.ndarray:
    """Code point to lower-case letter, or to the space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur, or None without a letter."""
    if not text:
        return None
    a = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    a = np.concatenate(([np.uint32(32)], a, [np.uint32(32)]))
    a = a[np.append(True, (a[1:] != 32) | (a[:-1] != 32))]
    if len(a) < 3:
        return None
    two = (a[:-1] * np.uint32(0x9E3779B1)) ^ (a[1:] * np.uint32(0x85EBCA77))
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ (a[2:] * np.uint32(0x27D4EB2F)) ^ np.uint32(0x165667B1)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    mixed = np.concatenate((two * np.uint32(0x2C1B3C6D), three * np.uint32(0x297A2D39)))
    return np.bincount((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift, minlength=DIMS)


def vectors(found: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    v = np.array(found, np.float32)
    np.log1p(v, out=v)
    v *= idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def band(found: list[np.ndarray]) -> np.ndarray:
    return np.minimum(31, np.log2(np.maximum(1, [int(c.sum()) for c in found])).astype(int))


def clustered(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the farthest points; k or fewer centroids."""
    centres = [v.mean(0)]
    for _ in range(k - 1):
        centres.append(v[np.argmin(np.max(v @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = np.argmax(v @ c.T, axis=1)
        c = np.array([v[own == i].mean(0) for i in range(len(c)) if (own == i).any()])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(labelled: DataFrame) -> Model:
    """labelled: (key, text, lang), all that may be learned from."""
    spark = labelled.sparkSession

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for x in batches:
            for text in x["text"]:
                if (c := counts(text)) is not None:
                    seen += c > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], n)})

    rows = labelled.select("text").mapInPandas(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 at most
    found = {r["bucket"]: r["n"] for r in rows}
    seen = np.zeros(DIMS)
    for k, n in found.items():
        if k >= 0:
            seen[k] = n
    idf = np.log((1 + found.get(-1, 0)) / (1 + seen)).astype(np.float32) + np.float32(1)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(32))
    each = max(SAMPLE_LEAST, min(SAMPLE_LANGUAGE, SAMPLE_ALL // len(sizes)))
    # each language's share of the hash range holds a few times `each` rows, so that enough of them hold letters
    share = spark.createDataFrame([(lang, min(1.0, 3.0 * each / n)) for lang, n in sizes.items()], "lang string, share double")
    mixed = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / (1 << 30)
    picked = labelled.join(F.broadcast(share), "lang").where(mixed < F.col("share")).select("lang", "key", "text")
    first = Window.partitionBy("lang").orderBy("mixed", "key", F.xxhash64("at", "n"))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [(lang, key, c) for lang, key, c in zip(x["lang"], x["key"], map(counts, x["text"])) if c is not None]
            yield pd.DataFrame({"lang": [g[0] for g in got], "key": [g[1] for g in got], "at": [np.flatnonzero(g[2]) for g in got], "n": [g[2][np.flatnonzero(g[2])] for g in got]})

    some = picked.mapInPandas(sparse, "lang string, key string, at array<int>, n array<int>").withColumn("mixed", F.xxhash64("key"))
    sample = some.withColumn("i", F.row_number().over(first)).where(F.col("i") <= each).collect()
    by_lang: dict[str, list] = {}
    for r in sample:
        by_lang.setdefault(r["lang"], []).append(r)
    languages = sorted(by_lang)
    centroids, owner, all_found, all_cos = [], [], [], []
    for i, lang in enumerate(languages):
        of = []
        for r in by_lang[lang]:
            c = np.zeros(DIMS, np.int64)
            c[r["at"]] = r["n"]
            of.append(c)
        v = vectors(of, idf)
        c = clustered(v, CENTROIDS)
        centroids.append(c)
        owner += [i] * len(c)
        all_found.append(band(of))
        all_cos.append((v @ c.T).max(1))
    floors = np.zeros(32)
    bands, cos = np.concatenate(all_found or [np.zeros(0, int)]), np.concatenate(all_cos or [np.zeros(0)])
    for b in range(32):
        if len(near := cos[np.abs(bands - b) <= 1]) >= 20:
            floors[b] = SLACK * near.min()
    return Model(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(owner), floors)


def predicted(docs: DataFrame, model: Model, keep_text: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs (text, and columns that pass through) with a language, a score and whether it is rejected, under `names`, which docs must not hold."""
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"docs has columns named {sorted(taken)}; give other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> dict[str, list]:
        m = shared.value
        found = [counts(t) for t in texts]
        rows = [i for i, c in enumerate(found) if c is not None] if m.languages else []
        lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if rows:
            some = [found[i] for i in rows]
            cos = vectors(some, m.idf) @ m.centroids.T
            for i, b, top, low in zip(rows, cos.argmax(1), cos.max(1), m.floors[band(some)]):
                lang[i], score[i], rejected[i] = m.languages[m.owner[b]], float(min(1.0, max(0.0, top))), bool(top < low)
        return dict(zip(names, (lang, score, rejected)))

    keep = [c for c in docs.columns if c != "text" or keep_text]
    return map_texts(docs, keep, run, ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "boolean"))), CHUNK)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame) -> Model:
    """From documents that are not held out."""
    key = F.col("doc_id").cast("string")
    return fit(docs.where((F.crc32(key.cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(key.alias("key"), "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), learned(docs))
