import random
import re
from collections import Counter

import zstandard

from tallyspark.llm import textscan as T
from tallyspark.llm.quality import BANDS, keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_counts_against_brute_force(odd):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(odd).collect())
    assert got == Counter((r.doc_id, *base(r.text)) for r in odd.collect())


def test_counts_on_random_words(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "b", " ", "  ", "\n", "é", "#"]) for _ in range(rnd.randint(0, 400))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def thue_morse(n, swap=False):
    """Words that polynomial hashes modulo a power of two can't tell from their complement."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


def test_lines_and_words_made_to_collide(spark):
    import numpy as np

    lines = f"{thue_morse(1024)} x\n{thue_morse(1024, True)} x"
    df = spark.createDataFrame([(0, lines)], "doc_id long, text string")
    assert quality_rules(df).first().n_dup_lines == 0
    data = np.frombuffer(lines.encode(), np.uint8)
    s, e = T.runs(data, np.array([0, len(data)]), T.IS_SPACE)
    h = T.hashes(data, s, e)
    assert h[0] != h[2] and h[1] == h[3] and T.numbers(data, s, e).tolist() == [0, 1, 2, 1]
    again = T.hashes(data[1030:], *(x[2:] - 1030 for x in (s, e))) if s[2] >= 1030 else T.hashes(data[s[2] :], s[2:] - s[2], e[2:] - s[2])
    assert (again == h[2:]).all()


def test_contract_columns_come_first(odd):
    assert quality_rules(odd).columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_share"]


def plain_verdict(text):
    raw = (text or "").encode()
    size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x))

    def inside(x):
        lo, hi = [(0.0, float("inf")), *((a, b) for least, a, b in BANDS if len(x) >= least)][-1]
        return lo <= size(x) / len(x) <= hi

    if not raw:
        return True
    if not inside(raw):
        return False
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    return len(chunks) == 1 or sum(len(c) for c in chunks if not inside(c)) <= 0.5 * len(raw)


def test_bands_against_a_plain_version(spark):
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 9))) for _ in range(800)]
    texts = []
    for _ in range(160):
        pick = rnd.choice([vocab, vocab[:6], [chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(500)]])
        text = " ".join(rnd.choice(pick) for _ in range(rnd.choice([5, 30, 90, 300, 1200, 3000])))
        texts.append(text + " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 0, 900]))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.kept for r in quality_rules(df).collect()}
    assert got == {i: not base(t)[5] and plain_verdict(t) for i, t in enumerate(texts)} and len(set(got.values())) == 2


def test_verdict(spark):
    rnd = random.Random(1)
    prose = " ".join("".join(rnd.choice("an the er ti on re st ou in of hea wh ble ly nd es ing sh ed at or to is en for with".split()) for _ in range(rnd.randint(1, 5))) for _ in range(700))
    junk = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) + " " * (i % 9 == 0) for i in range(3000))
    same = " ".join(f"{w} {w} {w}" for w in "ab" * 20) + " x" * 4000
    df = spark.createDataFrame([(0, prose), (1, junk), (2, same), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules(df).collect()} == {0: True, 1: False, 2: False, 3: False}
    assert [r.doc_id for r in keep_good(df).collect()] == [0]


def test_empty_and_columns(empty, odd):
    assert quality_rules(empty).count() == 0
    assert keep_good(empty).count() == 0
    kept = keep_good(odd)
    assert kept.columns == odd.columns
    want = sorted(str(r.doc_id) for r in quality_rules(odd).where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
