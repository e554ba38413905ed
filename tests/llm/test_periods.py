import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import periods as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Every distance by itself: maximal stretches of words equal to those q behind; of one stretch the least q."""
    found, n = {}, len(w)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc_id, text, damage):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if damage and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)), n, len(drop))


def texts(seed, many=400):
    rnd = random.Random(seed)
    for _ in range(many):
        kind, w = rnd.random(), []
        while len(w) < rnd.randint(0, 90):
            if kind < 0.5:
                w += [rnd.choice("abcd") for _ in range(rnd.randint(1, 6))] * rnd.randint(1, 9) + [rnd.choice("abcdefg")] * rnd.randint(0, 2)
            else:
                w.append(rnd.choice("ab" if kind < 0.8 else "abcde é"))
        yield rnd.choice([" ", "\n", " \t "]).join(w)


@pytest.mark.parametrize("damage", [False, True])
def test_against_brute_force(spark, damage):
    rows = list(enumerate(texts(13 + damage)))
    got = Counter(tuple(r) for r in P.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3), damage).collect())
    assert got == Counter(brute(i, t, damage) for i, t in rows)


def test_odd_rows(odd):
    for damage in (False, True):
        assert Counter(tuple(r) for r in P.periodic_runs(odd, damage).collect()) == Counter(brute(r.doc_id, r.text, damage) for r in odd.collect())


def test_query_on_the_table(spark, tables, odd):
    got = P.op13_periodic_runs(spark, tables(odd))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.count() == odd.count()


def test_nested_and_adjacent_runs():
    w = ("a a a a a a b " * 5 + "c d " * 4 + "d c d c d c d").split()
    ids = {x: i for i, x in enumerate(sorted(set(w)))}
    got = P.runs(np.array([ids[x] for x in w]), np.array([0, len(w)]))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute_runs(w)


def test_many_words_on_the_left():
    """A short run behind each of very many different words: neither all pairs nor all classes are looked at."""
    w = [x for i in range(20_000) for x in (i + 1, 0, 0, 0, 0, 0, 0)]
    start, length, period = P.runs(np.array(w), np.array([0, len(w)]))
    assert len(start) == 20_000 and set(length.tolist()) == {6} and set(period.tolist()) == {1}


def test_long_texts_stay_linear():
    for w in ([0] * 150_000, [i % 11 for i in range(150_000)]):
        got = [x.tolist() for x in P.runs(np.array(w), np.array([0, len(w)]))]
        assert got == [[0], [len(w)], [len(set(w))]]


def test_empty(empty):
    assert P.periodic_runs(empty, True).count() == 0
