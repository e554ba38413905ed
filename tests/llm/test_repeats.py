import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import repeats as R


def brute(rows, length):
    at = defaultdict(int)
    raw = [(r.text or "").encode() for r in rows]
    for t in raw:
        for p in range(len(t) - length + 1):
            at[t[p : p + length]] += 1
    out = Counter()
    for r, t in zip(rows, raw, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if at[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len([1 for x in bytes(gone).split(b"\0") if x])
        out[(r.doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def result(df, length):
    R_LENGTH = R.LENGTH
    docs, changed = R.passages_removed(df, length)
    changed = {bytes(r.sha): r for r in changed.collect()}
    out = Counter()
    for r in docs.collect():
        if r.copies > 1 and r.n_bytes >= length:
            out[(r.doc_id, r.n_bytes, r.n_bytes, 1, hashlib.sha256(b"").hexdigest())] += 1
        elif bytes(r.sha) in changed:
            c = changed[bytes(r.sha)]
            out[(r.doc_id, r.n_bytes, c.n_removed, c.n_spans, hashlib.sha256(c.kept).hexdigest())] += 1
        else:
            out[(r.doc_id, r.n_bytes, 0, 0, bytes(r.sha).hex())] += 1
    assert R_LENGTH == 400
    return out


def texts(seed, many=60):
    rnd = random.Random(seed)
    new = lambda n: "".join(rnd.choice("abcd é") for _ in range(n))
    passages = [new(rnd.randint(30, 90)) for _ in range(8)]
    out = []
    for _ in range(many):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 12)
            parts += [new(rnd.randint(0, 70)), p[a : len(p) - rnd.randint(0, 12)]]
        out.append("".join(parts))
    return out + ["ab" * 150, "x" * 130, "", None, out[3], out[3], out[5] + "q", new(39), new(40)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    df = spark.createDataFrame(list(enumerate(texts(seed))), "doc_id long, text string").coalesce(3)
    assert result(df, 40) == brute(df.collect(), 40)


def test_segments_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts(7, 10) + ["".join(t or "" for t in texts(7, 40))])), "doc_id long, text string").coalesce(1)
    rows = df.collect()
    monkeypatch.setattr(R, "SEGMENT", 300)
    for r in rows:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        spans = [(int(s) + a, int(e) + a) for c, a in R._parts(raw, np.array([0, len(raw)]), 40, 20) for s, e in zip(c.p0, c.p1, strict=True)]
        assert [p for s, e in spans for p in range(s, e + 1)] == list(range(max(0, len(raw) - 39)))


def test_query(odd, spark, tables):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert R.op3_suffix_dedup(spark, tables(odd)).columns[:5] == columns
    got = Counter(tuple(r) for r in R.op3_suffix_dedup(spark, tables(odd)).select(*columns).collect())
    assert got == brute(odd.collect(), 400)


@pytest.mark.parametrize("bucket_rows,partitions", [(50, 20_000), (1000, 20_000), (50, 3)])
def test_many_buckets(spark, monkeypatch, bucket_rows, partitions):
    """A passage in most texts: its equal suffixes fill many buckets, and every boundary cuts through some."""
    monkeypatch.setattr(R, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(R, "PARTITIONS", partitions)
    rnd = random.Random(9)
    hot = "".join(rnd.choice("abcd") for _ in range(90))
    rows = [(i, "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 30))) + hot[rnd.randint(0, 9) :] + str(i) * 3) for i in range(60)]
    df = spark.createDataFrame(rows + [(99, None)], "doc_id long, text string").coalesce(3)
    assert result(df, 40) == brute(df.collect(), 40)


@pytest.mark.parametrize("seed", range(20))
def test_buckets_find_every_equal(seed):
    """Random rows of few values: each row with an equal is found, whichever bucket either is in."""
    rng = np.random.default_rng(seed)
    n = 300
    rows = rng.integers(-4, 5, (n, 2))
    tid, p = np.arange(n) // 3, np.arange(n) % 3
    cut = R.Splitters(np.column_stack([rows, tid])[rng.random(n) < 0.2], 40)
    lead, h = (np.ascontiguousarray(rows[:, i]).view(np.uint64) for i in range(2))
    bucket = cut.bucket(lead, h, tid.astype(np.uint64))
    sent = [(b, *r, t, q) for b, r, t, q in zip(bucket, rows, tid, p, strict=True)]
    told = set()
    for i in np.flatnonzero(cut.alike(bucket - 1, lead, h)):
        back = int(cut.bucket(lead[i : i + 1], h[i : i + 1], np.zeros(1, np.uint64))[0])
        if back not in told:
            told.add(back)
            sent.append((back, *rows[i], tid[i], -1))
    got = set()
    for b in {x[0] for x in sent}:
        mine = np.array([x for x in sent if x[0] == b], np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in mine.T], R.SUFFIX)
        got |= {x for out in R._sorted_buckets(cut)(iter([batch])) for x in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    many = Counter(map(tuple, rows.tolist()))
    assert got == {(int(t), int(q)) for r, t, q in zip(rows.tolist(), tid, p, strict=True) if many[tuple(r)] > 1}


def test_shared_word_passages(spark):
    """Documents that share WORDS words in a row are told, others aren't, though no string of 400 bytes is shared."""
    rnd = random.Random(4)
    new = lambda n: [rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(n)]
    passages = [new(R.WORDS) for _ in range(12)]
    rows = []
    for i in range(48):
        words = new(rnd.randint(0, 80)) + passages[i % 12] + new(rnd.randint(0, 80))
        rows.append((i, " ".join(words if i < 24 else new(150))))
    rows += [(50, rows[30][1]), (51, " ".join(new(10))), (52, None), (53, " ".join(["again"] * 200))]
    docs, _ = R.passages_removed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    told = {r.doc_id for r in docs.collect() if r.n_shared}
    assert told == {*range(24), 30, 50}


def test_long_text(spark):
    """A text of some megabytes that repeats a passage at its ends, over the borders of segments."""
    rnd = random.Random(5)
    body, passage = "".join(rnd.choices("abcdefgh ", k=2_600_000)), "".join(rnd.choices("ABCD ", k=700))
    docs, changed = R.passages_removed(spark.createDataFrame([(1, passage + body + passage), (2, "short")], "doc_id long, text string"))
    (row,) = changed.collect()
    assert (row.n_removed, row.n_spans, bytes(row.kept).decode()) == (1400, 2, body) and docs.count() == 2


def test_empty(empty):
    docs, changed = R.passages_removed(empty)
    assert docs.count() == changed.count() == 0


def test_splitters_grow_with_the_buckets(spark, monkeypatch):
    """Many buckets and few long texts: a sample of their suffixes, however long they are, and the same result."""
    rnd = random.Random(31)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(3000)) + passage[rnd.randrange(300) :] * 2) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(tuple(r) for r in R.passages_removed(df)[1].select("sha", "n_removed", "n_spans", "kept").collect())
    monkeypatch.setattr(R, "BUCKET_ROWS", 20)
    monkeypatch.setattr(R, "SAMPLE_ROWS", 100)
    assert Counter(tuple(r) for r in R.passages_removed(df)[1].select("sha", "n_removed", "n_spans", "kept").collect()) == want
    every = R._every(3)
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 4), (4, 5), (5, 12))]
    assert [x for b in every(batches) for x in b.column(0).to_pylist()] == [2, 5, 8, 11]


def test_whole_texts_are_kept_compressed(spark, tmp_path):
    """Texts that share a passage are kept beside the checkpoints; they take less room there than they have bytes."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    line = "the same few words come again and again in here, "
    df = spark.createDataFrame([(i, f"{i} " + line * 2000 + f" {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    R.passages_removed(df)
    kept = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert kept < sum(len(r.text) for r in df.collect()) / 2, kept
