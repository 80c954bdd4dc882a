"""What a worker holds and how much of a text Python sees."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tagquarry.llm import packing, pii, tokens


def test_index_of_a_shard_is_small():
    r = np.random.default_rng(1)
    docs = [r.permutation(packing.VOCABULARY)[:1000].astype("<u4") for _ in range(300)]
    tracemalloc.start()
    index = packing.Index(docs, np.ones(packing.VOCABULARY), 1000.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * 300_000
    assert index.terms_of(7).tolist() == sorted(docs[7].tolist())


def test_kept_pieces_are_forgotten():
    e = tokens.encoder(tokens.public("word_bpe_49k.json"), False)
    before = e.encode(["some words, and others"])
    assert e.pieces
    tokens.forget()
    assert not e.pieces and not e.older
    assert e is tokens.encoder(tokens.public("word_bpe_49k.json"), False) and e.encode(["some words, and others"]) == before


def test_pii_asks_python_for_few_tokens(monkeypatch):
    asked, letters = [], pii._letters
    monkeypatch.setattr(pii, "_letters", lambda t: asked.append(t) or letters(t))
    text = " ".join(f"w{i:x}y," for i in range(20_000)) + " the account ZX-99 is"
    assert pii.all_spans(text, pii.Model({"<account": 0.9})) == [(len(text) - 8, len(text) - 3, "context")]
    assert len(asked) < 100


def test_pii_tokens_are_those_of_python():
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    found = pii.Tokens(pa.array(["a" + c + "b" for c in chars]))
    names = np.array(found.names.to_pylist(), object)[found.at]
    assert all(names[a:b].tolist() == ("a" + c + "b").split() for c, a, b in zip(chars, found.ends.tolist(), found.ends[1:].tolist()))
    for made in ("x" + "%s", "%s" + "y.", "%s"):
        some = [made % c for c in chars]
        words, odd = pii._words(pa.array(some))
        assert [c for c, w, o in zip(some, words, odd) if not o and w != pii._letters(c)] == []


def test_pii_spans_equal_those_of_single_tokens():
    r = random.Random(2)
    words = ["account", "Account:", "id=", "id=a.b@c.de", "Straße", "ΑΣ", "İd", "a.b@c.de", "1.2.3.4", "+49 30 1234567", "4111 1111 1111 1111", "key=.val", 'key="x"', "x:y", "\n", "  ", " ", "--", ".", "=", "a" * 70, "the", "no#1", "(account)", "99", "1.2.3", "+", "@"]
    texts = [" ".join(r.choices(words, k=r.randrange(30))) for _ in range(2000)] + [None, "", " "]
    for contexts in ({}, {"<account": 0.9, "=id": 0.7, "<ας": 0.9, "<key": 0.8, ">the": 0.7, "<" + pii._letters("a" * 70): 0.9}):
        model, wanted = pii.Model(contexts), []
        for text in texts:
            spans = pii.fixed_spans(text or "")
            if any(pii._around(t, (contexts.keys() | {c[1:] for c in contexts}).__contains__) for t in (text or "").split()):
                spans = spans + [(a, b, "context") for a, b, found, seed in pii.mentions(text, spans) if not seed and any(c in contexts for c in found)]
            wanted.append(sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2]))))
        assert pii.spans_of(texts, model) == wanted
