import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import ngram_join as J

from .test_near_dedup import brute, near_copies


def want(rows, size, percent):
    return Counter({k[:3]: 0 for k in brute(rows, size, percent)}) + Counter(x for k, m in brute(rows, size, percent).items() for x in [k[:3]] * m)


@pytest.mark.parametrize("size,percent,rows", [(4, 85, 8), (3, 70, 512)])
def test_against_brute_force(spark, monkeypatch, size, percent, rows):
    monkeypatch.setattr(J, "ROWS", rows)
    df = spark.createDataFrame(near_copies(size + 20), "doc_id long, text string").coalesce(3)
    assert Counter(tuple(r) for r in J.ngram_join(df, size, percent).collect()) == want(df.collect(), size, percent)


def test_a_hub_and_a_common_passage(spark, monkeypatch):
    """One large group of copies that drift, and a passage that many unlike texts share."""
    monkeypatch.setattr(J, "ROWS", 16)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base, passage, rows = [word() for _ in range(90)], [word() for _ in range(60)], []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(90)] = word()
        rows.append(words)
        rows.append(passage + [word() for _ in range(rnd.choice([6, 9, 12, 40]))])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in J.ngram_join(df).collect()) == want(df.collect(), 4, 85)


def test_blocks_of_alike_nodes(spark, monkeypatch):
    """Very many near copies about the threshold, which meet in blocks only; pairs are not put out, or for the last few."""
    monkeypatch.setattr(J, "ROWS", 24)
    monkeypatch.setattr(J, "DENSE", 1)
    monkeypatch.setattr(J, "STARS", 0)
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(70)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(70)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in J.ngram_join(df).collect()) == want(df.collect(), 4, 85)


def test_pairs_put_out_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """A large group of copies that drift about the threshold: a pair comes from one slice, and most nodes are joined by their nearest."""
    made, kept = [], J.map_batches

    def counted(df, run, schema):
        out = kept(df, run, schema)
        if schema == "block string, u long, v long":
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "map_batches", counted)
    monkeypatch.setattr(J, "STARS", 0)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base, other, rows = [word() for _ in range(300)], [word() for _ in range(60)], []
    for i in range(300):  # those with two changes in common, or more, are linked: about one pair in twenty
        words = list(base)
        for k in rnd.sample(range(60), 5):
            words[5 * k] = other[k]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in J.ngram_join(df).collect()) == want(df.collect(), 4, 85)
    assert made and sum(made) <= 6 * len(rows), made


def test_a_pair_has_met_before_where_an_earlier_slice_holds_both():
    none = np.iinfo(np.int64).max
    one, two = np.array([[1, 5, none], [1, 5, none], [-3, 5, none]]), np.array([[4, 5, none], [1, 5, none], [-3, none, none]])
    assert J.met_before(np.array([5, 5, -3]), one, two).tolist() == [False, True, False]


def test_odd_rows(odd):
    assert Counter(tuple(r) for r in J.ngram_join(odd).collect()) == want(odd.collect(), 4, 85)


def test_every_similar_pair_of_sizes_shares_a_band():
    for percent in (50, 70, 85, 99):
        found = J.bands(5000, percent)
        for a in range(1, 2500):
            for b in {a, a + 1, a * 100 // percent}:
                if b <= a * 100 // percent and J._differ(a, b, percent):
                    assert any(low <= a and b <= high for low, high, _ in found), (a, b)


def test_similar_sets_share_a_slice_and_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(6, 500))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n * 16 // 100 + 1))
        new = next((y for y in range(n // 6, -1, -1) if 100 * (n - gone) >= 85 * (n + y)), None)
        if new is None or not gone + new:
            continue
        two = [np.sort(base), np.sort(np.concatenate([base[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))]
        keys, whose = J.slice_keys(np.concatenate(two), np.repeat([0, 1], [len(x) for x in two]), np.array([len(x) for x in two]), 85)
        assert set(keys[whose == 0].tolist()) & set(keys[whose == 1].tolist())
        assert all((whose == i).sum() <= 2 * (J._differ(len(x), len(x) * 100 // 85, 85) + 1) for i, x in enumerate(two))
        a, b = (J.folded(x, J.fold_bits(len(x), 85)) for x in two)
        assert np.bitwise_count(J.short([a])[0] ^ J.short([b])[0]).sum() <= J.distance(a, b) <= gone + new and J.distance(b, b) == 0


def test_query_on_the_table(spark, tables, odd):
    got = J.op12_ngram_join(spark, tables(odd))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == odd.count()


def test_empty(empty):
    assert J.ngram_join(empty).count() == 0
