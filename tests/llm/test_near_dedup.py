import random
import re
from collections import Counter

import pytest

from tallyspark.llm import near_dedup as N
from tallyspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = [shingle_set(r.text, size) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    out = Counter()
    for i, r in enumerate(rows):
        c = least.get(find(i)) if sets[i] else r.doc_id
        out[(r.doc_id, len(sets[i]), c, r.doc_id == c)] += 1
    return out


def near_copies(seed, families=12, copies=14):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    rows = []
    for _ in range(families):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, 220))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append(" ".join(words).upper() if rnd.random() < 0.2 else " ".join(words))
            if rnd.random() < 0.5:
                base = words  # chains that drift
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, monkeypatch, size, percent):
    monkeypatch.setattr(N, "BLOCK", 8)
    df = spark.createDataFrame(near_copies(size), "doc_id long, text string").coalesce(3)
    got = Counter(tuple(r) for r in N.near_dedup(df, size, percent).collect())
    assert got == brute(df.collect(), size, percent)


def test_odd_rows(odd):
    assert Counter(tuple(r) for r in N.near_dedup(odd, 3, 85).collect()) == brute(odd.collect(), 3, 85)
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns


def test_null_and_repeated_ids_keep_one_of_each_component(spark):
    rnd = random.Random(9)
    base = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    text = lambda words, end="": " ".join(words) + end
    a, b, c, e, f, g, h = (base() for _ in range(7))
    rows = [
        (None, text(a)), (None, text(b)), (None, text(b, " more")),  # distinct texts, and near copies, without ids
        (1, text(c)), (1, text(e)), (1, text(e, " more")), (1, text(e)),  # one id: distinct texts, a near copy, a repeated row
        (2, text(f)), (3, text(f, " more")), (None, text(f, " else")),
        (3, text(g)), (3, text(h)), (4, text(h, " more")),  # the id of a copy is that of documents that stay
        (5, None), (5, "  "), (None, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = Counter(tuple(r) for r in N.keep_one(df).collect())
    one_of = [[rows[0]], rows[1:3], [rows[3]], rows[4:6], [rows[7]], [rows[10]], [rows[11]], [rows[13]], [rows[14]], [rows[15]]]
    assert sum(kept.values()) == len(one_of) and all(sum(kept[x] for x in group) == 1 for group in one_of), kept


def test_odd_sketch_estimates():
    import numpy as np

    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 32, (200, N.SAMPLES), dtype=np.uint32)
    other = base.copy()
    other[:, :13] = rnd.integers(0, 1 << 32, (200, 13), dtype=np.uint32)
    apart = np.bitwise_count((N.odd_sketch(base) ^ N.odd_sketch(other)).view(np.uint64)).sum(1)
    estimate = -N.BITS / 4 * np.log(1 - 2 * apart / N.BITS)
    assert abs(estimate.mean() - 13) < 1
    assert (apart <= N.most_bits(0.85)).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 30)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    single = {a for a, b in edges if a == b and a not in got}
    assert got == {x: find(x) for x in parent if x not in single}


def test_empty(empty):
    assert N.near_dedup(empty).count() == 0
