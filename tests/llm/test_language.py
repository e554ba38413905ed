import random

from tallyspark.llm import language as L

SYLL = {"aa": "an er ti on re st ou in of hea wh ble ly nd".split(), "bb": "éau oui ré tre ment eux ç la que des".split(), "cc": "ung keit sch ein ver ß ach der tz ö".split()}


def corpus(spark, n=300):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SYLL))
        words = ["".join(rnd.choice(SYLL[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(8, 800))]
        text = " ".join(words)
        rows.append((i, text.upper() if i % 7 == 0 else text, lang if i % 11 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_held_out_accuracy(spark):
    docs, rows = corpus(spark)
    model = L.fit(docs.where("doc_id % 4 <> 2"))
    assert {name for name, _ in model} == set(SYLL)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2 and r[2]]
    assert sum(got[r[0]].best == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts(spark, odd, empty):
    model = L.fit(corpus(spark, 60)[0])
    got = L.identify(odd, model).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        if not any(map(str.isalpha, texts[r.doc_id] or "")):
            assert (r.best, r.lang, r.score) == ("und", "und", 0.0)
        else:
            assert r.best in SYLL and r.lang in (r.best, "und")
    assert L.identify(empty, model).count() == 0
    assert {r.best for r in L.identify(odd, L.fit(empty)).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    model = [("x", b"abc abd abe " * 50), ("y", b"abc abd abe " * 50)]
    r = L.identify(spark.createDataFrame([(1, "abc abd abe " * 9)], "doc_id long, text string"), model).first()
    assert (r.best, r.lang) == ("x", "und")


def test_against_one_call_for_each_language(spark):
    """The verdicts, worked out anew from the sizes of single compressions."""
    import zstandard

    docs, _ = corpus(spark, 60)
    model = L.fit(docs.where("doc_id % 4 <> 2"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.identify(docs, model).collect():
        raw, sizes = L.plain(texts[r.doc_id]), []
        for _, words in model:
            held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=L.LEVEL)
            sizes.append(sum(len(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=held, write_content_size=False).compress(raw[i : i + L.CHUNK])) for i in range(0, len(raw), L.CHUNK)))
        first, second = sorted(sizes)[:2]
        assert r.best == model[sizes.index(first)][0] and r.lang == (r.best if (second - first) / first >= L.REJECT else "und")


def test_very_many_languages(spark, monkeypatch):
    """None is left out: dictionaries get smaller, and coders made group by group give the same verdicts."""
    monkeypatch.setattr(L, "GROUP", 4)
    rnd = random.Random(2)
    rows = []
    for lang in range(14):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(25)]
        rows += [(len(rows) + i, " ".join(rnd.choice(words) for _ in range(60)), f"l{lang}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert {name for name, _ in model} == {f"l{i}" for i in range(14)}
    judge = L.Judge(model)
    assert len(judge.groups) == 4 and [best for best, *_ in judge([r[1] for r in rows])] == [r[2] for r in rows]
    monkeypatch.setattr(L, "MODEL_BYTES", 14 * 300)
    small = L.fit(df)
    assert {name for name, _ in small} == {name for name, _ in model} and all(0 < len(d) <= 300 for _, d in small)
