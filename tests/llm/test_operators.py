"""Each operator against brute force, on tables with nulls, empty and repeated rows."""

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pytest

from tagquarry.llm import huffman, language, minhash, neighbours, packing, pieces, pii, url_reputation, warc, winnowing
from tagquarry.llm.common import new_path
from tagquarry.llm.tokens import public

WORDS = "the and with from house river stone light green water over under never always bright cold".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(30)) * int(r.random() < 0.5) for i in r.integers(len(WORDS), size=n))


BASE = prose(1, 200)
TEXTS = [BASE, BASE, BASE.replace("the", "THE"), BASE + " tail", BASE[:400], None, "", "   \n", "one two", "One  two", prose(2, 150), prose(3, 2000), "x" * 20000, "über Straße 🙂🙂 <|endoftext|>  double  space\n\n tab\tend ", *[prose(1, 200)[: 900 + 8 * i] for i in range(12)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", i) for i, t in enumerate(TEXTS)] + [(None, BASE, "en", 0), (9, BASE + " tail", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n long")


def test_near_duplicates(docs, empty):
    found = collections.defaultdict(list)
    for r in minhash.linked(docs).collect():
        found[r["doc_id"]].append(r)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in enumerate(TEXTS):
        w = word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i * 3] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] < root[b]:
                    root[b], changed = root[a], True
    for i, s in sets.items():
        for r in found[i]:
            assert (r["n_shingles"], r["component_id"]) == (len(s), root[i]), i
            assert r["kept"] == (i == root[i])
    assert found[None][0]["component_id"] == 0 and not found[None][0]["kept"]
    assert minhash.linked(empty).count() == 0


def test_near_copies_without_an_id(spark):
    rows = []
    for g in range(12):
        w = [f"w{g}x{i}" for i in range(224)]
        # the one without an id is near both others, which are not near each other
        rows += [(2 * g, " ".join(w[:200])), (None, " ".join(w[12:212])), (2 * g + 1, " ".join(w[24:]))]
    rows += [(None, " ".join(f"n{i}" for i in range(a, 200 + a))) for a in (0, 5, 5)]
    found = [(r["doc_id"], r["component_id"]) for r in minhash.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(f for f in found if f[0] is not None) == [(i, i // 2 * 2) for i in range(24)]
    assert sorted((c for i, c in found if i is None), key=str) == sorted([*range(0, 24, 2), None, None, None], key=str)


def test_sketches_estimate():
    r = np.random.default_rng(5)
    for share in (0.3, 0.8, 0.95):
        both, a, b = (r.integers(1 << 63, size=int(n), dtype=np.uint64) for n in (4000 * share, 2000 * (1 - share), 2000 * (1 - share)))
        x, y = minhash.sketch(np.unique(np.append(both, a))), minhash.sketch(np.unique(np.append(both, b)))
        est, used = minhash.estimates(x[None], y[None])
        assert abs(est[0, 0] - len(both) / (len(both) + len(a) + len(b))) < 0.12


def test_huffman_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public("byte_bpe_50k.json"))
    folder = new_path(spark, "t")
    ids = huffman.stored_in_order(docs, public("byte_bpe_50k.json"), folder)
    got = sorted(huffman.read(huffman.write(ids, folder, huffman.code_lengths(huffman.id_counts(ids, 50257)))).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in docs.collect()], key=lambda k: (k is not None, k or 0))
    by, start = {(i * 3, x) for i, x in enumerate(TEXTS)}, 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    crc = {(r["doc_id"], r["ids_crc32"]) for r in got}
    for key, x in by:
        assert (key, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) in crc
    ids = huffman.stored_in_order(empty, public("byte_bpe_50k.json"), folder)
    assert huffman.read(huffman.write(ids, folder, huffman.code_lengths(huffman.id_counts(ids, 50257)))).count() == 0


def test_code_is_limited_and_complete():
    counts = np.array([1 << min(i, 40) for i in range(60)] + [0, 5])
    n = huffman.code_lengths(counts, 12)
    assert n.max() <= 12 and n[60] == 0 and sum(2.0 ** -int(x) for x in n if x) == 1
    ids = np.random.default_rng(1).integers(60, size=5000).astype(np.uint32)
    codes = huffman.canonical(n)
    data, offsets, _ = huffman.packed(ids, n, codes)
    assert (huffman.unpacked(data, offsets, len(ids), huffman.decode_table(n, codes)) == ids).all()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public("word_bpe_49k.json"))
    rows = packing.pack(docs, public("word_bpe_49k.json"), 256).collect()
    own = {i * 3: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in enumerate(TEXTS)}
    seen = collections.Counter()
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 9:
            ids = own[r["doc_id"]]
            assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            seen[r["doc_id"]] += r["length"]
    assert all(seen[i] == len(x) for i, x in own.items() if i != 9)
    full = collections.defaultdict(list)
    for r in rows:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in full.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256 and end & (end - 1) == 0
    assert packing.pack(empty, public("word_bpe_49k.json")).count() == 0


def test_neighbours_found_by_retrieval():
    ids = [np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([1, 2, 4]), np.array([5])]
    index = packing.Index(ids, np.ones(packing.VOCABULARY), 3)
    assert index.neighbours(0, np.array([True, False, False, False])).tolist() == [2]


def test_packing_finds_neighbours_over_small_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 10)
    r = np.random.default_rng(7)
    topics = [["".join(r.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(20)] for _ in range(40)]
    rows = [(i + 40 * j, " ".join(r.permutation(words))) for i, words in enumerate(topics) for j in range(2)]
    found = collections.defaultdict(set)
    for row in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public("word_bpe_49k.json"), 1024).collect():
        found[row["doc_id"]].add(row["sequence_id"])
    # the other document of its topic is in a window with it, wherever the shards are cut
    assert sum(bool(found[i] & found[i + 40]) for i in range(40)) >= 38


def test_all_terms_of_a_seed_ask():
    # the seed's 30 rarest terms are its own; what is near shares only its other 40
    ids = [np.arange(70), np.arange(30, 70), np.append(np.arange(40), 99) + 200, np.append(np.arange(30, 33), np.arange(300, 340))]
    idf = np.append(np.full(30, 9.0), np.ones(packing.VOCABULARY - 30))
    assert packing.Index(ids, idf, 50).neighbours(0, np.array([True, False, False, False])).tolist() == [1, 3]


def test_pieces_equal_the_library(docs):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=public("piece_bpe_32k.model"))
    m = pieces.Model(public("piece_bpe_32k.model"))
    some = [t for t in TEXTS if t] + ["", " ", "a  b   c", "▁x", "\n\t x", "日本語テキスト", " " * 77 + "abc" + " " * 33, "<s> <0x0A>"]
    for text, ids in zip(some, m.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text)
        assert m.decode(np.frombuffer(ids, "<u4")) == reference.decode(reference.encode(text))
    rows = {r["doc_id"]: r for r in pieces.encoded(docs, public("piece_bpe_32k.model")).collect()}
    assert rows[15]["decoded"] is None and rows[18]["ids"] == []


def test_winnowing(spark, docs):
    rows = winnowing.edited(docs.where("doc_id is not null and doc_id <> 9")).collect()
    own = {i * 3: t or "" for i, t in enumerate(TEXTS) if i != 3}
    order = sorted(own, reverse=True)
    changed = {k: own[k][: len(own[k]) - len(own[k]) // 2] + own[order[(j + 1) % len(order)]][: len(own[k]) // 2] for j, k in enumerate(order)}
    again = winnowing.chosen(spark.createDataFrame(list(changed.items()), "doc_id long, text string"), "text", "c")
    again = {r["doc_id"]: r["f"] for r in again.select("doc_id", winnowing._digest("array_distinct(c)").alias("f")).collect()}
    same = collections.defaultdict(set)
    for r in rows:
        k = r["doc_id"]
        assert r["edited_sha256"] == hashlib.sha256(changed[k].encode()).hexdigest()
        assert r["edited_fingerprint"] == again[k] and r["n_chars"] == len(own[k])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        same[own[k]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_winnowing_guarantee(spark):
    shared = prose(7, 12)[: winnowing.K + winnowing.W - 1]
    rows = winnowing.fingerprints(spark.createDataFrame([(prose(8, 40) + shared + "q",), ("zz" + shared + prose(9, 40),)], "text string")).collect()
    assert {x["hash"] for x in rows[0]["fingerprint"]} & {x["hash"] for x in rows[1]["fingerprint"]}
    assert [x["position"] for x in rows[0]["fingerprint"]] == sorted(x["position"] for x in rows[0]["fingerprint"])


def test_pii():
    text = "a.b@c.de x@y 1.2.3.4 999.1.1.1 no 4111 1111 1111 1111 +49 (30) 1234-567 @z.com"
    assert [(text[a:b], k) for a, b, k in pii.fixed_spans(text)] == [("a.b@c.de", "email"), ("1.2.3.4", "ip"), ("4111 1111 1111 1111", "card"), ("+49 (30) 1234-567", "phone")]
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = np.random.default_rng(3)
    for _ in range(2000):
        s = "".join(r.choice(list("ab1.@- +"), size=30))
        assert [(a, b) for a, b, k in pii.fixed_spans(s) if k == "email"] == [m.span() for m in plain.finditer(s)]


def test_pii_learns_contexts(spark, empty):
    seen = [f"please call account +49 30 12345{i:02d} now" for i in range(20)] + [f"mail account user{i}2345@x.org now" for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*seen, "the account ZX-9981234 now", "room 12345 here", None, ""])], "doc_id long, text string")
    contexts = pii.learned_contexts(docs)
    assert "<account" in contexts
    rows = {r["doc_id"]: r["spans"] for r in pii.extracted(docs, contexts).collect()}
    assert rows[40] == "context:12:22" and rows[41] == "" and rows[42] == ""
    assert pii.masked("the account ZX-9981234 now", pii.Model(contexts)) == "the account <context> now"
    assert pii.learned_contexts(empty) == {}


def test_pii_learns_from_seeds_without_digits(spark):
    name = lambda i: "".join(chr(97 + i // 26 ** j % 26) for j in range(3))
    rows = [f"write to the mailbox {name(i)}@site.org today" for i in range(30)] + [f"please ring line +1 (974) 555-3{i:03d} soon" for i in range(30)] + ["to the mailbox joe_smith today", "ring line 4711 soon", "a plain text"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    contexts = pii.learned_contexts(docs)
    assert {"<mailbox", ">today", "<line", ">soon"} <= set(contexts)
    spans = {r["doc_id"]: r["spans"] for r in pii.extracted(docs, contexts).collect()}
    assert (spans[60], spans[61], spans[62]) == ("context:15:24", "context:10:14", "")


def test_pii_keeps_rare_contexts(spark):
    """6 seeds of 24000 are enough for a context; instances found by contexts bring in those without a seed."""
    rows = [" ".join(f"mail u{i}x{j}@site.org" for j in range(600)) for i in range(40)] + [f"badge {c}{c}@site.org" for c in "abcdef"]
    rows += [f"token {c}@site.org" for c in "abcdefghijklmnopqrst"] + [f"{k} Q{i}" for k in ("token", "locker") for i in range(6)] + ["locker Z9"]
    found = pii.learned_contexts(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {"<mail", "<badge", "<token", "<locker"} <= set(found)


def test_language(spark, empty):
    kinds = {"aa": "ba la ma ka ta", "bb": "xyz zyx yxz qwx", "cc": "один два три"}
    r = np.random.default_rng(2)
    rows = [(i, " ".join(r.choice(kinds[k].split(), size=20)), k) for i, k in enumerate(list(kinds) * 60)]
    docs = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "12 !?", None), (None, "ba la", None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.predicted(docs.select("doc_id", "text", language.held_out().alias("held_out")), language.learned(docs)).collect()}
    assert all(out[i]["lang_pred"] == k and 0 <= out[i]["score"] <= 1 for i, _, k in rows)
    assert out[1000]["lang_pred"] == out[1001]["lang_pred"] == "und" and out[None]["lang_pred"] == "aa"
    assert {i for i, x in out.items() if x["held_out"]} == {i for i in out if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert [r["lang_pred"] for r in language.predicted(docs.limit(1), language.learned(empty)).collect()] == ["und"]


def test_warc(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"<p>{i}" * 500, "extra") for i in range(300)] + [(None, None, None, "x"), (500, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size string")
    manifest = warc.write(pages, new_path(spark, "w"))
    for split in (999, 1 << 20):
        out = {r["page_id"]: r for r in warc.read(manifest, split).collect()}
        assert len(out) == 302
        for i, _, html, _ in rows[:300]:
            assert out[i]["payload_digest"] == warc.digest(html.encode()) and out[i]["payload_bytes"] == len(html)
            assert (out[i]["record_type"], out[i]["refers_to"]) == (("revisit", 0) if i % 3 == 0 and i else ("response", None))
        assert out[None]["refers_to"] == 500
    assert warc.read(warc.write(pages.limit(0), new_path(spark, "w"))).count() == 0
    data = b"junk" + warc.record(1, None, b"a") + b"\x1f\x8b\x08broken" + warc.record(2, None, b"b")
    assert [warc.parsed(c)["page_id"] for _, c in warc.members(io.BytesIO(data), len(data), 0, len(data))] == [1, 2]


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16))
    x[700:760] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0])]
    found = collections.defaultdict(list)
    for q in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100).orderBy("query_id", "rank").collect():
        found[q["query_id"]].append((q["vec_id"], q["score"]))
    assert sorted(found) == list(range(0, 1500, 100))
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hits += len(set(best) & {g[0] for g in got})
        assert len(got) == 10 and all(abs(d[v] - s) < 1e-9 for v, s in got)
    assert hits >= 0.9 * 10 * len(found)
    assert [v for v, _ in found[0]] == list(range(700, 710))


def test_urls(spark):
    rows = [(1, "http://WWW.Example.net/en/1"), (2, "http://a.net/x"), (3, "https://b.org/fr/3?q"), (4, None), (5, "no scheme"), (6, "x://net"), (7, "http://bad.com/7"), (8, "http://bad.com/8")] + [(i, f"http://bad.com/{i}") for i in range(20, 60)] + [(i, f"http://good.com/{i}") for i in range(60, 99)]
    labels = [(i, int(i < 60)) for i in range(20, 99)] + [(None, 1), (20, None)]
    out = {r["page_id"]: r for r in url_reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "number long, bad int")).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (out[2]["rule"], out[2]["verdict"]) == ("net/", "block") and out[3]["rule"] == "org/fr/"
    assert out[4]["host"] == out[5]["host"] == "" and out[6]["rule"] is None
    assert out[7]["verdict"] == "block" and out[70]["verdict"] == "allow"
    assert url_reputation.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "number long, bad int")).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    kept = docs.where("text is not null and doc_id is not null").drop("n")
    out = corpus_pipeline.without_near_duplicates(spark, kept, "")
    assert out.columns == kept.columns
    found = minhash.linked(kept.select("doc_id", "text"), 5)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in found.where("kept").collect()}
    assert corpus_pipeline.without_personal_data(spark, kept, "").count() == kept.count()
