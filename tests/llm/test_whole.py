"""More of the corpus operators against brute force, and the pipeline's stages."""

import collections
import hashlib
import json
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tagquarry.llm import language, minhash, neighbours, packing, pieces, pii, tokens, winnowing
from tagquarry.llm.common import new_path
from tagquarry.llm.tokens import public

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def linked_by_brute_force(texts, k):
    """The first of each text's component, by comparing all pairs."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(texts))]


def mutated(base, r, most):
    w = list(base)
    for i in r.integers(len(w), size=r.integers(most)):
        w[i] = f"new{r.integers(1 << 30)}"
    return " ".join(w)


def test_one_large_group(spark, monkeypatch):
    """A group of near copies around the line, with many members apart: small cells, and buckets dealt anew."""
    monkeypatch.setattr(minhash, "CELL", 16)
    monkeypatch.setattr(minhash, "WIDE", 24)
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    texts = [mutated(base, r, 14) for _ in range(260)] + [" ".join(f"o{i}x{j}" for j in range(40)) for i in range(20)]
    found = {x["doc_id"]: x["component_id"] for x in minhash.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    expected = linked_by_brute_force(texts, 4)
    assert len(set(expected)) > 30 and [found[i] for i in range(len(texts))] == expected


@pytest.mark.parametrize("few", [2, 1 << 20])
def test_wide_buckets_lose_no_link(spark, monkeypatch, few):
    """All sets share one bucket only, and it counts as wide: what the first centre isn't linked with is found by rare shingles."""
    monkeypatch.setattr(minhash, "CELL", 16)
    monkeypatch.setattr(minhash, "WIDE", 0)
    monkeypatch.setattr(minhash, "FEW", few, raising=False)
    monkeypatch.setattr(minhash, "_band_keys", lambda registers: np.full((len(registers), 1), 7))
    r = np.random.default_rng(12)
    bases = [[f"w{i}" for i in range(60)] + [f"g{g}x{i}" for i in range(60)] for g in range(6)]
    texts = [mutated(base, r, 9) for base in bases for _ in range(8)]
    found = {x["doc_id"]: x["component_id"] for x in minhash.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    expected = linked_by_brute_force(texts, 4)
    assert 6 <= len(set(expected)) < 40 and [found[i] for i in range(len(texts))] == expected


def test_cells_emit_fewer_links_than_members():
    import pyarrow as pa

    sets = [np.unique(np.append(np.arange(80), [100 + i])).astype(np.uint64) for i in range(40)]
    regs = [minhash.sketch(s) for s in sets]
    key = int(minhash._band_keys(np.array(regs))[0, 0])
    rows = [(key, 0, 0, None, side, True, i, i, len(s), x.tobytes(), s.tobytes()) for side in (0, 1) for i, (s, x) in enumerate(zip(sets, regs))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    out = list(minhash._cell(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[str(i) for i in range(11)]), 80))
    assert 0 < out[0].num_rows < 40


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(name, spaces):
    r = np.random.default_rng(3)
    letters = [*"abzAZ '’.,!?-_0129\n\t\r\x0b\x1c\x85 éÉßİıΣσςʼn²½ªº€😀日本ががé<|>", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", " \n", "\n ", "ſ", "٣"]
    texts = ["".join(r.choice(letters, r.integers(40))) for _ in range(3000)] + ["x" * 50_000, "the " * 5000, None, ""]
    e = tokens.Encoder(public(name), spaces)
    assert e.encode(texts) == e._plain([t or "" for t in texts])


def test_frequent_pieces_are_encoded_once(monkeypatch):
    """Whatever comes between, a piece of every batch stays among those kept; the others go."""
    monkeypatch.setattr(tokens, "PIECES", 40)
    e, asked = tokens.Encoder(public("byte_bpe_50k.json"), True), []
    apart = e._apart
    monkeypatch.setattr(e, "_apart", lambda pieces: asked.extend(pieces) or apart(pieces))
    for i in range(30):
        text = "so " + " ".join(f"the {chr(97 + i % 26)}{chr(97 + k)}{'x' * (i // 26)}" for k in range(15))
        assert e.encode([text]) == e._plain([text])
    assert asked.count(" the") == 1 and len(e.pieces) + len(e.older) < 80


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_texts_fall_apart_in_arrow(name, spaces):
    """Safe spaces, others, and none; parts of an array, which begin within its buffers."""
    texts = ["a b", None, "", " a", "a ", "a  b", "a\u00a0 b", "a \ufeffb", "The the THE.", "\n", "x\n y", "it's 12 don't", "é É\u0301 e", "<|endoftext|> a <|endoftext|>", "word" * 30 + " b", "日本 が"] * 3
    e = tokens.Encoder(public(name), spaces)
    assert e.direct
    for low, n in ((0, len(texts)), (5, 20), (1, 1), (2, 1), (0, 0)):
        ids, ends = e.encoded(pa.array(texts, pa.string()).slice(low, n))
        assert [ids[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())] == e._plain([t or "" for t in texts[low : low + n]])


def test_batches_of_long_texts_are_sliced():
    b = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 5_000_000, None, "y" * 5_000_000, "z" * 20_000_000, ""] + ["w"] * 1500)})
    assert [p.num_rows for p in tokens.sliced(b, 0)] == [2, 1, 1, 1000, 501]
    assert pa.Table.from_batches(tokens.sliced(b, 0)).column(0).to_pylist() == b.column(0).to_pylist()


def test_two_rarest_terms():
    r = np.random.default_rng(5)
    for n in range(6):
        x = r.random(n)
        assert packing.lowest_two(x).tolist() == np.argsort(x)[:2].tolist()


def test_ids_beyond_16_bits(spark, tmp_path):
    model = {"type": "WordLevel", "vocab": {f"v{i}": i for i in range(70_001)} | {"zz": 70_001, "?": 70_002}, "unk_token": "?"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": model}))
    docs = spark.createDataFrame([(1, "zz zz"), (2, None)], "doc_id long, text string").coalesce(1)
    manifest = tokens.stored(docs.selectExpr("0 as mark", "doc_id", "text"), str(path), False, new_path(spark, "wide"))
    (_, keys, ids), = tokens.loaded(manifest.first()["file"])
    assert keys == [1, 2] and [x.tolist() for x in ids] == [[70_001, 70_001], []]
    rows = packing.pack(docs, str(path), 4, 9).collect()
    assert sum(x["length"] for x in rows) == 4 and {x["doc_tokens"] for x in rows} == {3, 1}


def test_pieces_on_random_texts():
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=public("piece_bpe_32k.model"))
    m = pieces.Model(public("piece_bpe_32k.model"))
    r = np.random.default_rng(5)
    letters = list("abcdefghijklmnoprstuvwxyz      ETAO.,'-\n\t0123éüñ日本語🙂▁")
    texts = ["".join(r.choice(letters, r.integers(60))) for _ in range(3000)] + ["x" * 3000, "jjj" * 50, "the" * 500]
    for text, ids in zip(texts, m.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text), text


def test_bm25_order_by_brute_force():
    r = np.random.default_rng(9)
    docs = [r.integers(300, size=r.integers(1, 80)).astype(np.uint32) for _ in range(120)]
    df = np.zeros(packing.VOCABULARY)
    for d in docs:
        df[np.unique(d)] += 1
    idf, mean = np.log1p((120 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    index = packing.Index(docs, idf, mean)
    for seed in range(0, 120, 7):
        used = np.zeros(120, bool)
        used[seed] = True
        score = np.zeros(120)
        for i, d in enumerate(docs):
            for t in np.unique(docs[seed]):
                tf = (d == t).sum()
                score[i] += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if tf else 0
        got = index.neighbours(seed, used)
        assert set(got.tolist()) == set(np.flatnonzero(score).tolist()) - {seed}
        assert (np.diff(score[got]) <= 1e-4).all()


def test_winnowing_by_brute_force(spark):
    texts = ["the quick brown fox jumps over the lazy dog " * 3, "ab" * 60, "x" * 100, "short", "", "über 🙂 straße " * 5, "the quick brown fox sat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = {x["doc_id"]: [h["hash"] for h in x["fingerprint"]] for x in winnowing.fingerprints(df, w=1).collect()}
    gram = {}
    for i, t in enumerate(texts):
        for at, h in enumerate(every[i]):
            assert gram.setdefault(t[at : at + winnowing.K], h) == h  # the same characters, the same hash
    assert len(set(gram.values())) == len(gram)
    marks = {}
    for i in range(len(texts)):
        h, w, out = every[i], winnowing.W, []
        for at in range(max(1, len(h) - w + 1) if h else 0):
            low = min(h[at : at + w])
            best = max(j for j in range(at, min(len(h), at + w)) if h[j] == low)
            if not out or out[-1] != (low, best):
                out.append((low, best))
        marks[i] = out
    for x in winnowing.fingerprints(df).collect():
        assert [(h["hash"], h["position"]) for h in x["fingerprint"]] == marks[x["doc_id"]]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    sets = {i: {h for h, _ in m} for i, m in marks.items()}
    order = sorted(sets, reverse=True)
    for x in winnowing.edited(df).collect():
        after = order[(order.index(x["doc_id"]) + 1) % len(order)]
        assert abs(x["near_next"] - alike(sets[x["doc_id"]], sets[after])) < 1e-12
    assert winnowing.edited(df.limit(0)).count() == 0


def test_edited_texts_over_many_ranges(spark, monkeypatch):
    """Ranges of a few rows, and a doc_id, and the null one, that many rows have."""
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 5)
    rows = [(i, f"text number {i} " * 3) for i in range(40)] + [(7, f"of seven {i} " * 2) for i in range(30)] + [(None, f"of none {i} " * 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {x["text"]: x["tie"] for x in df.selectExpr("text", "xxhash64(text) as tie").collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), tie[x[1]]))
    want = collections.Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((x["doc_id"], x["edited_sha256"]) for x in winnowing.edited(df).collect()) == want
    ranges = winnowing.with_next(df).where("not guest").groupBy("range").count().collect()
    assert max(x["count"] for x in ranges) <= 15


def test_fixed_spans_by_brute_force():
    plain = {"ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = np.random.default_rng(4)
    for letters in (list("1234567890....a"), list("4111111111 -+"), list("+1234567890 ()-.")):
        for _ in range(1500):
            s = "".join(r.choice(letters, 40))
            for kind, pattern in plain.items():
                want = []
                for m in re.finditer(pattern, s):
                    digits = re.sub("[^0-9]", "", m[0])
                    if kind == "ip":
                        fine = all(int(p) <= 255 for p in m[0].split("."))
                    elif kind == "card":
                        fine = 14 <= len(digits) <= 19 and pii.luhn(digits)
                    else:
                        fine = 10 <= len(digits) <= 15
                    if fine:
                        want.append(m.span())
                assert [(a, b) for a, b, k in pii.fixed_spans(s) if k == kind] == want, (kind, s)
    assert pii.fixed_spans("0" * 6000 + "1.1.1.1") == [(0, 6007, "ip")]


def test_pii_is_linear():
    model = pii.Model({"<account": 0.9})
    for text in ("a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "+1 (" * 250_000, "account " + "é" * 500_000, "a@b.c," * 100_000):
        start = time.time()
        pii.all_spans(text, model)
        assert time.time() - start < 5, text[:10]


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ALL", 40)
    monkeypatch.setattr(language, "SAMPLE_LEAST", 2)
    r = np.random.default_rng(6)
    words = {f"l{i:02d}": ["".join(chr(0x100 + 8 * i + j) for j in r.integers(8, size=4)) for _ in range(6)] for i in range(40)}
    rows = [(i, " ".join(r.choice(words[k], 12)), k) for i, k in enumerate(list(words) * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x["doc_id"]: x["lang_pred"] for x in language.predicted(docs, language.learned(docs)).collect()}
    assert all(out[i] == k for i, _, k in rows)
    with pytest.raises(ValueError, match="score"):
        language.predicted(docs.selectExpr("doc_id", "text", "1 as score"), language.learned(docs.limit(0)))


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_at_two_sizes(spark, n):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 32))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    found = collections.defaultdict(list)
    for q in neighbours.nearest(spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>"), 100).collect():
        found[q["query_id"]].append(q["vec_id"])
    hits = 0
    for q, got in found.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got))
    assert len(found) == n // 100 and hits >= 0.9 * 10 * len(found)
    assert neighbours.VISITS < neighbours.LEAVES
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), 100).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Three invented languages, copies, repeated and null ids, personal data, and columns named like the models'."""
    r = np.random.default_rng(8)
    kinds = {"aa": "ba la ma ka ta na sa".split(), "bb": "xyz zyx yxz qwx wqx xqw".split(), "cc": "один два три пять".split()}
    rows = []
    for i in range(150):
        k = list(kinds)[i % 3]
        rows.append([i, " ".join(w + str(r.integers(50)) for w in r.choice(kinds[k], 30)), k])
    rows += [[200 + i, rows[i][1] + " more", rows[i][2]] for i in range(0, 30, 3)]  # near copies
    rows += [[5, rows[9][1] + " ta", rows[9][2]], [5, rows[5][1], rows[5][2]], [None, rows[7][1], rows[7][2]], [None, rows[8][1] + " one two three four five six seven eight", None]]
    rows += [[300, "ba la mail a.b@c.de ma card 4111 1111 1111 1111", "aa"], [301, None, "aa"], [302, "", None], [303, "12 !?", None]]
    rows = [(i, t, k, f"s{j % 4}", None if t is None else len(t), float(j), j % 2 == 0, "own") for j, (i, t, k) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean, lang_pred string")
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_language_stage(spark, corpus):
    import corpus_pipeline

    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.by_language(spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(str(x) for x in docs.collect() if x["text"] and re.search("[a-zа-я]", x["text"]))
    assert corpus_pipeline.by_language(spark, docs.limit(0), folder).count() == 0


def test_near_duplicate_stage(spark, corpus):
    import corpus_pipeline

    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or doc_id < 301 or doc_id > 301")
    docs = docs.unionByName(docs.where("doc_id in (20, 302)"))  # equal rows
    out = corpus_pipeline.without_near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns
    every = sorted(docs.collect(), key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0))
    root = linked_by_brute_force([x["text"] for x in every], 5)
    groups = collections.Counter(root[i] for i, x in enumerate(every) if shingles(x["text"], 5))
    kept = out.collect()
    worded = [x for x in kept if shingles(x["text"], 5)]
    assert len(worded) == len(groups) and len(kept) - len(worded) == sum(not shingles(x["text"], 5) for x in every)
    # the one that stays has the smallest id of its group
    assert sorted(str(x["doc_id"]) for x in worded) == sorted(str(every[i]["doc_id"]) for i in groups)
    assert corpus_pipeline.without_near_duplicates(spark, docs.limit(0), folder).count() == 0


def test_personal_data_stage(spark, corpus):
    import corpus_pipeline

    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.without_personal_data(spark, docs, folder)
    key = lambda x: (x["score"], x["doc_id"], x["lang_pred"])
    was, now = {key(x): x for x in docs.collect()}, {key(x): x for x in out.collect()}
    assert out.columns == docs.columns and was.keys() == now.keys()
    for k, x in now.items():
        masked = (was[k]["text"] or "").replace("a.b@c.de", "<email>").replace("4111 1111 1111 1111", "<card>")
        assert (x["text"] or "") == masked and x["n_chars"] == (None if x["text"] is None else len(masked))


def test_whole_pipeline(spark, corpus):
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    t = Tokenizer.from_file(public("word_bpe_49k.json"))
    own = collections.defaultdict(list)
    for x in docs.collect():
        own[x["doc_id"]].append(np.array([*t.encode(x["text"] or "", add_special_tokens=False).ids, 2], "<u4"))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sum(x["length"] for x in rows) == sum(len(x) for found in own.values() for x in found)
    for x in rows:
        assert x["ids_crc32"] in {zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) for ids in own[x["doc_id"]] if len(ids) == x["doc_tokens"]}
