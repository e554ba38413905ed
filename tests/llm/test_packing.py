import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tallyspark.llm import packing as K

TOKENIZER = P.path("word_bpe_49k.json")


def checked(rows, capacity):
    """The number of sequences; asserts that each is gapless and within the capacity."""
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(odd, spark, tables):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    want = Counter()
    for r in odd.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[(r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    rows = K.op1_best_fit_packing(spark, tables(odd)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = checked(rows, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def test_quick_way_is_this_tokenizers_only(tmp_path):
    """It is used for the vocabulary that it was written for, and switched off for one that treats words otherwise."""
    import json

    assert K.Words(TOKENIZER).quick
    other = json.loads(open(TOKENIZER, encoding="utf-8").read())
    other["normalizer"] = None  # upper case stays
    (tmp_path / "other.json").write_text(json.dumps(other), encoding="utf-8")
    words = K.Words(str(tmp_path / "other.json"))
    assert not words.quick
    text = "Upper and LOWER (élan), Straße"
    assert words.encode(text) == np.array(Tokenizer.from_file(str(tmp_path / "other.json")).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plan_is_near_the_bound():
    rnd = np.random.default_rng(2)
    for sizes in (np.clip(rnd.lognormal(6.5, 1.0, 40_000), 1, 4096), rnd.integers(1, 4097, 20_000), np.full(1000, 1365), np.r_[np.full(900, 2049), np.full(30, 2047)]):
        lengths = Counter(sizes.astype(int).tolist())
        p = K.plan(dict(lengths))
        assert not p.left
        placed = Counter()
        for n, a, b, *_ in p.runs:
            placed[n] += b - a
        assert placed == lengths
        total = sum(n * c for n, c in lengths.items())
        bound = max(-(-total // 4096), sum(c for n, c in lengths.items() if n > 2048))
        assert p.sequences <= 1.02 * bound + 2, (p.sequences, bound)


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place for every document."""
    best = len(lengths)

    def put(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for f in {f for f in free if f >= lengths[i]}:
            put(i + 1, sorted([*free[: free.index(f)], *free[free.index(f) + 1 :], f - lengths[i]]))
        put(i + 1, [*free, capacity - lengths[i]])

    put(0, [])
    return best


def test_plans_of_few_documents_against_all_packings():
    rnd = random.Random(8)
    more = 0
    for _ in range(150):
        lengths = sorted((rnd.randint(1, 24) for _ in range(rnd.randint(1, 9))), reverse=True)
        n, least = K.plan(dict(Counter(lengths)), 24).sequences, fewest(lengths, 24)
        assert least <= n <= least + 1, lengths
        more += n - least
    assert more <= 8


def test_patterns_place_most():
    sizes = np.clip(np.random.default_rng(5).lognormal(5.8, 1.1, 30_000), 1, 4096).astype(int)
    p = K.Plan(dict(Counter(sizes.tolist())), 4096)
    p.fit_patterns()
    assert p.fitted >= 0.8 * len(sizes)
    assert all(sum(b * t for b, t in x) == 12 and len({b for b, _ in x}) == len(x) <= 3 for x in K.patterns(12, 3))
    p.best_fit()
    assert p.sequences <= 1.001 * (sizes.sum() / 4096) + 1


def test_long_text(spark):
    text = "".join(f"word{i % 991} and {i}, " for i in range(150_000))
    rows = K.pieces(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), TOKENIZER).collect()
    ids = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids + [1]
    got = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 1)
    assert got == [(a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for a in range(0, len(ids), 4096)]


def test_hot_length_and_small_groups(spark):
    rnd = random.Random(4)
    rows = [(i, 0, 0, 10 if i % 3 == 0 else rnd.randint(1, 64), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = K.pack(df, capacity=64, group=100).collect()
    assert len(out) == 3000
    n = checked(out, 64)
    assert n <= 1.03 * sum(r[3] for r in rows) / 64 + 2


def test_nnls():
    rnd = np.random.default_rng(1)
    a = rnd.random((12, 7))
    x = np.array([1.0, 0, 2, 0, 0, 3, 0.5])
    assert np.allclose(K.nnls(a, a @ x), x, atol=1e-6)


def test_empty(empty):
    assert K.pack(K.pieces(empty, TOKENIZER)).count() == 0


def test_words_against_the_tokenizer():
    rnd = random.Random(6)
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    signs = list("aebstrEÉéßñ'\"(.,!-#1²漢Σσİ\u0301\u00a0\x1c \n") + ["the", "ing", "'s", "'re", " "]
    words = K.Words(TOKENIZER)
    assert words.quick
    for _ in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
