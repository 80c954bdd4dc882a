"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, huffman, language, minhash, neighbours, packing, pieces, pii, secrets, spelling, url_reputation, warc, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": url_reputation.query,
    "op2_language_id": language.query,
    "op3_pii": pii.query,
    "op4_huffman_ids": huffman.query,
    "op5_winnowing": winnowing.query,
    "op6_packing": packing.query,
    "op7_nearest_neighbours": neighbours.query,
    "op8_sentencepiece": pieces.query,
    "op9_warc": warc.query,
    "op10_near_duplicates": minhash.query,
    "op11_spelling_variants": spelling.query,
    "op12_secrets": secrets.query,
    "op13_filter_audit": filter_audit.query,
}

SQL: dict[str, str] = {"op1_url_reputation": url_reputation.SQL, "op9_warc": warc.SQL, "op13_filter_audit": filter_audit.SQL}
