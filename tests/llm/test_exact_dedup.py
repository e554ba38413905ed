import hashlib
from collections import Counter, defaultdict

from tallyspark.llm.exact_dedup import drop_copies, exact_dedup, identities


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_against_brute_force(odd):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    low = lambda x: -1 if x is None else x
    want = Counter()
    for t, ids in groups.items():
        keep = max(ids, key=low)
        for n, i in enumerate(sorted(ids, key=low, reverse=True)):
            want[(i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup(odd, block=16).collect()) == want
    assert Counter(tuple(r) for r in exact_dedup(odd).collect()) == want


def test_names_tell_texts_apart(spark):
    texts = ["ab" * n for n in range(40)] + ["ab" * 20 + "c", "c" + "ab" * 20, "\0", "\0\0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = identities(df, block=4).collect()
    assert len({(r.level, r.name) for r in ids}) == len(texts) == len(ids)


def test_empty(empty):
    assert exact_dedup(empty).count() == 0


def test_drop_copies_keeps_columns(odd):
    out = drop_copies(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len({norm(r.text) for r in rows}) == len(rows) == len({norm(r.text) for r in odd.collect()})
