"""Toxicity by a learned lexicon, found with misspellings, and by what stands around the hits.

The lexicon is learned: words whose presence raises the odds of the label most. It is kept as a trie, with which the
terms' Levenshtein automata are intersected, so misspelled terms are found without comparing with every term. Each hit gets a score
from the window of words around it: within quotation marks or after a word of reporting it counts as quoted, near a word
of address as aimed at someone. A logistic model on sums of hits by kind gives the document's score.

Learning uses a bounded sample: about SAMPLE labelled documents, chosen by a hash of the id.

Defined cases: null and empty texts have no hits and score as any text without hits; without labels of both kinds the
score is the smoothed share of label 1; rows that repeat are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import durable, map_batches, read, remainder
from .near_dedup import shingles

SAMPLE = 20_000
TERMS = 400
LEAST_DOCS, LEAST_SHARE = 4, 0.006  # toxic sample documents that hold a term: at least so many, and so large a share
LEAST_ODDS = 3.0  # smoothed log-odds of a term
WINDOW = 6
CACHE_ITEMS = 300_000
STATES = 1_000_000  # trie nodes in all kept states of the automaton together
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‟«»‘’‚‹›…–—¿¡"
QUOTES = '"“”„«»‹›'
#: Words of reporting and of address in the languages that are common in web text.
REPORTING = frozenset("said says wrote writes quoted quote quotes called reported according term word dit écrit cite selon sagte schrieb zitiert laut dijo escribió cita según".split())
ADDRESS = frozenset("you your you're youre u ur yourself tu te toi vous votre du dich dir ihr euch dein tú usted ustedes vosotros".split())
FEATURES = 8
_PLACES = 1 << 20


def allowed(size: int) -> int:
    """Edits within which a term of this length is found."""
    return 0 if size < 5 else 1 if size < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie.

    A state is a set of trie nodes, each with the fewest edits that lead to it; a node is dropped when its edits exceed what
    any term below allows. Transitions are made when first needed and kept, so a word costs one lookup for each character.
    """

    def __init__(self, terms: list[str], most: list[int] | None = None) -> None:
        self.most = [allowed(len(t)) for t in terms] if most is None else most
        self.children: list[dict[str, int]] = [{}]
        self.room = [0]
        self.term: list[int | None] = [None]
        for i, t in enumerate(terms):
            node = 0
            self.room[0] = max(self.room[0], self.most[i])
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                    self.term.append(None)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], self.most[i])
            self.term[node] = i
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.accept: list[tuple[int, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.size = 0
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # characters of a term that the word lacks
            n = todo.pop()
            for child in self.children[n].values():
                e = nodes[n] + 1
                if e <= self.room[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        key = tuple(sorted(n * 4 + e for n, e in nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.size += len(key)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] is not None and e <= self.most[self.term[n]]]
            self.accept.append(min(ends)[::-1] if ends else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self.room[n] and e < nodes.get(n, 99):
                nodes[n] = e

        for n, e in (divmod(k, 4) for k in self.sets[state]):
            put(n, e + 1)
            for d, child in self.children[n].items():
                put(child, e + (d != c))
        self.moves[state][c] = to = self._state(nodes) if nodes else -1
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term within its allowed edits and the distance, or None."""
        if self.size > STATES:
            self._reset()
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        return self.accept[state]


class Scanner:
    def __init__(self, terms: list[str], most: list[int] | None = None) -> None:
        self.automaton = Automaton(terms, most)
        self.cache: dict[str, tuple | bool] = {}

    def _look(self, word: str) -> tuple[int, int] | bool:
        return self.automaton.match(word.strip(TRIM)) or False

    def hits(self, text: str) -> list[tuple[int, int, bool, bool]]:
        """term, edits, quoted, aimed for each hit."""
        words = text.lower().split()
        found = list(map(self.cache.get, words))
        if None in found:
            new = {w: self._look(w) for w in {w for w, f in zip(words, found, strict=True) if f is None}}
            if len(self.cache) + len(new) > CACHE_ITEMS:
                self.cache.clear()
            if len(new) <= CACHE_ITEMS:
                self.cache.update(new)
            found = [new[w] if f is None else f for w, f in zip(words, found, strict=True)]
        out = []
        for i in [i for i, f in enumerate(found) if f]:
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            bare = {w.strip(TRIM) for w in near}
            before = {w.strip(TRIM) for w in words[max(0, i - WINDOW) : i]}
            left, right = " ".join(words[max(0, i - WINDOW) : i + 1]), " ".join(words[i : i + WINDOW + 1])
            quoted = any(q in left for q in QUOTES) and any(q in right for q in QUOTES) or bool(before & REPORTING)
            out.append((*found[i], quoted, bool(bare & ADDRESS)))
        return out


def features(hits: list[tuple[int, int, bool, bool]], words: int, exact: list[float], fuzzy: list[float]) -> list[float]:
    """A document's features. exact, fuzzy: the weights of each term as written and misspelled; misspellings of weight 0 are no hits."""
    hits = [h for h in hits if not h[1] or fuzzy[h[0]] > 0]
    kinds = [0.0] * 4  # as written, misspelled, quoted, aimed
    total = 0.0
    for term, edits, quoted, aimed in hits:
        total += (fuzzy[term] if edits else exact[term]) * (0.4 if quoted else 1.0) * (1.2 if aimed else 1.0)
        kinds[0] += not edits and not quoted
        kinds[1] += bool(edits) and not quoted
        kinds[2] += quoted
        kinds[3] += aimed
    return [*(math.log1p(k) for k in kinds), math.log1p(total), float(bool(hits)), min(1.0, 20 * len(hits) / (1 + words)), math.log1p(len({h[0] for h in hits}))]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and intercept, by Newton's method with a ridge penalty."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, terms: list[str], exact: list[float], fuzzy: list[float], weights: np.ndarray) -> None:
        self.terms, self.exact, self.fuzzy, self.weights = terms, exact, fuzzy, weights


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of about `sample` labelled documents. The ids are few by the parameter, so they are broadcast."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    n = labels.count()
    if n > sample:
        by_hash = F.xxhash64("label_id", F.lit(23))
        labels = labels.where(F.pmod(by_hash, F.lit(_PLACES)) < math.ceil(sample / n * _PLACES)).orderBy(by_hash, "label_id", "toxic").limit(2 * sample)
    labels = labels.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    mine = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mine.join(F.broadcast(labels), mine["doc_id"] == labels["label_id"]).select("doc_id", "text", "toxic")


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """Of sample texts that share their least shingle of five words, one: else the words of a much copied text look telling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in T.texts(batch.column(0), T.BLOCK):
                keys, of = shingles(data, at, 5)
                n = len(at) - 1
                least = np.zeros(n, np.int64)
                _, one = np.unique(of, return_index=True)
                least[of[one]] = keys[one].view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, n) for i in range(2)), pa.array(least)], ["text", "toxic", "least"])

    keyed = map_batches(rows.select("text", "toxic"), run, "text string, toxic int, least long")
    return keyed.groupBy("least", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic."""
    rows = durable(_one_of_copies(_sample(docs, labels, sample)))
    count = rows.groupBy("toxic").count().collect()
    bad = sum(r["count"] for r in count if r["toxic"] == 1)
    good = sum(r["count"] for r in count if r["toxic"] == 0)
    plain = np.zeros(FEATURES + 1)
    plain[-1] = math.log((bad + 0.5) / (good + 0.5))
    if not bad or not good:
        return Model([], [], [], plain)
    tokens = rows.select("toxic", F.explode(F.array_distinct(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.trim(w, F.lit(TRIM))))).alias("word"))
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * bad))
    words = tokens.where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("b"), F.count("*").alias("n")).where(F.col("b") >= least)
    odds = F.log((F.col("b") + 0.1) / (bad + 0.2)) - F.log((F.col("n") - F.col("b") + 0.1) / (good + 0.2))
    top = words.select("word", "b", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.log1p("b")), "word").limit(TERMS).collect()
    terms, exact = [r["word"] for r in top], [r["odds"] for r in top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t.as_py() or "" for t in batch.column(0)]
                hits = [[x for h in scanner.hits(t) for x in map(int, h)] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([t.count(" ") for t in texts], pa.int32()), pa.array(hits, pa.list_(pa.int32()))], ["toxic", "words", "hits"])

    seen = map_batches(rows.select("text", "toxic"), run, "toxic int, words int, hits array<int>").collect()
    hits = [[(h[i], h[i + 1], bool(h[i + 2]), bool(h[i + 3])) for i in range(0, len(h), 4)] for h in (r["hits"] for r in seen)]
    # a term's misspellings count for as much as they tell in the sample; those that ordinary words match are dropped
    near = np.zeros((2, len(terms)))
    for r, h in zip(seen, hits, strict=True):
        for t in {t for t, edits, *_ in h if edits}:
            near[r["toxic"], t] += 1
    told = np.log((near[1] + 0.1) / (bad + 0.2)) - np.log((near[0] + 0.1) / (good + 0.2))
    fuzzy = [0.0 if n0 and o < LEAST_ODDS else 0.5 * x if not n1 else min(x, o) for n0, n1, o, x in zip(near[0], near[1], told, exact, strict=True)]
    x = np.array([features(h, r["words"], exact, fuzzy) for h, r in zip(hits, seen, strict=True)]).reshape(-1, FEATURES)
    return Model(terms, exact, fuzzy, _logistic(x, np.array([float(r["toxic"]) for r in seen])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: doc_id, score, terms (the terms hit), edits and quoted of each hit."""
    terms, exact, fuzzy, weights = model.terms, model.exact, model.fuzzy, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms, [allowed(len(t)) if f > 0 else 0 for t, f in zip(terms, fuzzy, strict=True)])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t.as_py() or "" for t in batch.column(1)]
                hits = [scanner.hits(t) for t in texts]
                x = np.array([features(h, t.count(" "), exact, fuzzy) for h, t in zip(hits, texts, strict=True)]).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(p),
                        pa.array([[terms[k[0]] for k in h] for h in hits], pa.list_(pa.string())),
                        pa.array([[k[1] for k in h] for h in hits], pa.list_(pa.int32())),
                        pa.array([[k[2] for k in h] for h in hits], pa.list_(pa.bool_())),
                    ],
                    ["doc_id", "score", "terms", "edits", "quoted"],
                )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, terms array<string>, edits array<int>, quoted array<boolean>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
