import random

from tallyspark.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = _next(row, c, b, i)
    return row[-1]


def _next(row, c, b, i):
    out = [i]
    for j, d in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
    return out


def test_automaton_against_distances():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    terms = sorted({word(rnd.randint(2, 11)) for _ in range(40)})
    a = X.Automaton(terms)
    for _ in range(1500):
        w = word(rnd.randint(0, 12))
        near = sorted((distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= X.allowed(len(t)))
        got = a.match(w)
        assert (got is None) == (not near), w
        if near:
            assert (got[1], got[0]) == near[0]


def test_states_that_overflow(monkeypatch):
    monkeypatch.setattr(X, "STATES", 30)
    a = X.Automaton(["trashy", "worthless"])
    assert [a.match(w) for w in ("trashy", "trsahy", "trashhy", "wortless", "good")] == [(0, 0), None, (0, 1), (1, 1), None]


def corpus(spark, n=600):
    rnd = random.Random(7)
    syll = "an er ti on re st ou in of hea wh ble ly nd es ing".split()
    word = lambda: "".join(rnd.choice(syll) for _ in range(rnd.randint(1, 4)))
    bad = ["blorgish", "snarkwad", "grumblefoo"]
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 90))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w = rnd.choice(bad)
                if rnd.random() < 0.3:
                    k = rnd.randrange(len(w))
                    w = w[:k] + "x" + w[k + 1 :]
                words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, 'the critic wrote "blorgish" once in a long and calm review of it')]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = X.fit(docs, labels.where("doc_id % 5 <> 0"))
    assert {"blorgish", "snarkwad", "grumblefoo"} <= set(model.terms)
    out = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    held = [r for r in labels.collect() if r.doc_id % 5 == 0]
    assert sum((out[r.doc_id] >= 0.5) == bool(r.toxic) for r in held) >= 0.98 * len(held)
    assert out[600] == out[601] < 0.5
    assert len(out) == docs.count()


def test_quotation_counts_less():
    hits = X.Scanner(["blorgish"]).hits('he said "blorgish" then. ' + "w " * 20 + "you are blorgish")
    assert [(q, a) for _, _, q, a in hits] == [(True, False), (False, True)]


def test_without_labels_or_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = X.fit(odd, none)
    assert len({r.score for r in X.score(odd, model).collect()}) == 1
    assert X.score(empty, X.fit(empty, none)).count() == 0
