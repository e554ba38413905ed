"""A text of some megabytes, whose end matters as much as its beginning, and columns with the names that stages use."""

import random

import pytest

import corpus_pipeline
from tallyspark.llm import language, near_dedup, pii, quality, secrets, toxicity
from tallyspark.llm.exact_dedup import drop_copies


@pytest.fixture(scope="module")
def long():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aeiourstnlmd") for _ in range(rnd.randint(2, 8))) for _ in range(5000)]
    return " ".join(rnd.choice(words) for _ in range(400_000))


def test_language(spark, long):
    rows = [(i, long[i * 500 : i * 500 + 400] if i % 2 else "ж" + long[i * 500 : i * 500 + 400].replace("a", "я").replace("s", "ш"), "ab"[i % 2]) for i in range(200)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # most of the text, and all but its first part, is in the second language
    mixed = long[:100_000].replace("a", "я").replace("s", "ш") + long[100_000:]
    ((best, _, score, margin),) = language.Judge(model)([mixed])
    assert best == "b" and score > 0.99 and margin > 0


def test_entities_and_secrets_at_the_end(spark, long):
    key = "AKIA" + "A1B2" * 4
    docs = spark.createDataFrame([(1, f"{long} mail jo.doe@host.example or {key}")], "doc_id long, text string")
    (row,) = pii.replace(docs, "k").collect()
    assert row.text.startswith(long) and "jo.doe@host.example" not in row.text
    assert [(r.value, r.place) for r in secrets.candidates(docs).collect() if r.rule == "format"] == [(key, len(long) + len(" mail jo.doe@host.example or ") + 1)]


def test_toxicity_at_the_end(spark):
    rnd = random.Random(3)
    plain = "the weather was fine and we went for a walk along the old river".split()
    text = lambda bad: " ".join(rnd.choice(plain) for _ in range(30)) + (" you vilescum" if bad else "") + " " + " ".join(rnd.choice(plain) for _ in range(10))
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    body = " ".join(rnd.choice(plain) for _ in range(300_000))
    out = toxicity.score(spark.createDataFrame([(1, body + " you vilescum"), (2, body)], "doc_id long, text string"), model).collect()
    hits = {r.doc_id: r.terms for r in out}
    assert hits[1] and not hits[2]


def test_stages(spark, long):
    rows = [(1, long, "copy", 7), (2, long, "copy", 8), (3, long + " and one more", "copy", 9), (4, None, None, None), (5, "short", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy_id string, _copy_sha int")
    good = quality.keep_good(docs)
    assert {r.doc_id for r in good.collect()} == {1, 2, 3}
    once = drop_copies(good)
    assert sorted((r.doc_id, r.copy_id, r._copy_sha) for r in once.collect()) == [(2, "copy", 8), (3, "copy", 9)]
    one = near_dedup.keep_one(once)
    assert [tuple(r)[2:] for r in one.collect()] == [("copy", 8)]
    packed = corpus_pipeline.pack(spark, corpus_pipeline.personal_data(spark, one, ""), "").collect()
    assert {r.doc_id for r in packed} == {2} and sum(r.length for r in packed) > 400_000


def test_null_and_shared_ids_stay_apart(spark, long):
    texts = [long[i * 3000 : i * 3000 + 2000] for i in range(4)]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3])], "doc_id long, text string")
    for stage in (drop_copies, near_dedup.keep_one):
        assert sorted(r.text for r in stage(docs).collect()) == sorted(texts)
