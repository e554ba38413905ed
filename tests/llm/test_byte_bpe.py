import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from tallyspark.llm import byte_bpe as B

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(RANKS), special_tokens={})


def test_boundaries_against_the_pattern():
    rnd = random.Random(3)
    signs = ["'", "s", "t", "re", "ve", "ll", "l", "m", "d", " ", " ", "\n", "\t", " ", "1", "²", "!", "-", "é", "漢", "é", "🙂", "R"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    pattern, enc = regex.compile(P.PATTERN), B.Encoder.of(RANKS)
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    _, offsets = enc.encode(np.frombuffer(b"".join(raw), np.uint8), at)
    for t, o in zip(texts, offsets, strict=True):
        assert np.frombuffer(o, "<u4").tolist() == [len(t[: m.start()].encode()) for m in pattern.finditer(t)], repr(t)


def test_against_the_library(odd, tables, spark):
    enc = library()
    want = Counter()
    for r in odd.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in B.op6_byte_bpe(spark, tables(odd)).collect()) == want


def test_classes_of_all_code_points():
    """Each code point between two letters, two numbers and two signs, as the library cuts it."""
    enc, lib = B.Encoder.of(RANKS), library()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)}a 1{chr(c)}1 +{chr(c)}+ {chr(c)}" for c in points[i : i + 4000])
        raw = text.encode()
        ids, _ = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids[0] == np.array(lib.encode_ordinary(text), "<u4").tobytes(), hex(points[i])


def test_offsets_that_do_not_belong():
    enc, dec = B.Encoder.of(RANKS), B.Decoder.of(RANKS)
    raw = "three plain words".encode()
    ids, offsets = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert dec.decode(ids[0], offsets[0]) == raw and np.frombuffer(offsets[0], "<u4").tolist() == [0, 5, 11]
    with pytest.raises(ValueError):
        dec.decode(ids[0], np.array([0, 2], "<u4").tobytes())


def test_long_text():
    """A text of some millions of characters, by slices of the library's own pattern."""
    text = "".join(f"word{i % 977} {i * 7919 % 100003}, it's\n" for i in range(120_000))
    raw = text.encode()
    ids, offsets = B.Encoder.of(RANKS).encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ids[0] == np.array(library().encode_ordinary(text), "<u4").tobytes()
    assert B.Decoder.of(RANKS).decode(ids[0], offsets[0]) == raw


def test_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(B, "CACHE_ITEMS", 3)
    enc, text = B.Encoder(RANKS), "one two three four five six one two"
    ids, _ = enc.encode(np.frombuffer((text + text).encode(), np.uint8), np.array([0, len(text), 2 * len(text)]))
    assert ids[0] == ids[1] == np.array(library().encode_ordinary(text), "<u4").tobytes()
    assert B.Decoder.of(RANKS).decode(ids[0], step=2) == text.encode()


def test_empty(empty):
    assert B.decode(B.encode(empty, RANKS), RANKS).count() == 0
