import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyspark.llm import pii
from tallyspark.llm.quality import quality_rules

from .test_near_dedup import shingle_set


def corpus(spark):
    rnd = random.Random(12)
    syll = "an er ti on re st ou in of hea wh ble ly nd es ing sh ed at or to is the en for with".split()
    word = lambda: "".join(rnd.choice(syll) for _ in range(rnd.randint(1, 4)))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(rnd.randint(25, 300))]
        texts.append(" ".join(words))
        if rnd.random() < 0.4:
            texts.append(" ".join(words).upper() if rnd.random() < 0.5 else " ".join(words))
        if rnd.random() < 0.4:
            near = list(words)
            near[rnd.randrange(len(near))] = word()
            texts.append(" ".join(near))
    texts += [None, "", "too short", "same words again and again " * 40, texts[0] + " mail bo.b@example.com", texts[0][:200] + " call +1 (383) 555-8961 " + texts[3]]
    rnd.shuffle(texts)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def brute(docs):
    """Ids that stay after the first three stages."""
    good = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in good), key=lambda r: r.doc_id)
    by = {}
    for r in rows:
        by[r.text.lower()] = r  # the largest id
    rows = sorted(by.values(), key=lambda r: r.doc_id)
    sets = [shingle_set(r.text, 5) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and label[i] != label[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    return {rows[i].doc_id for i in set(label)}


def test_pipeline_against_brute_force(spark, tables):
    docs = corpus(spark)
    rows = corpus_pipeline.run(spark, tables(docs)).collect()
    assert {r.doc_id for r in rows} == brute(docs)
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        if not re.search(r"[@\d]", texts[r.doc_id]):
            assert r.length == len(tokens.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        assert [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 4096


def test_stages_keep_columns(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.count()


def test_stages_on_empty(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_surrogates_stay_in_effect(spark):
    df = spark.createDataFrame([(1, "write to bo.b@example.com now", "en", "s", 29)], "doc_id long, text string, lang string, source string, n_chars long")
    r = corpus_pipeline.personal_data(spark, df, "").first()
    assert "bo.b@" not in r.text and r.n_chars == len(r.text)
    assert pii.entities(df).count() == 1
