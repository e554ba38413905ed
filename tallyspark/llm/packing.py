"""Best-fit packing by patterns: which documents share a sequence follows from the histogram of their lengths alone.

Documents are tokenised once. Their lengths, at most `capacity` different ones, make a histogram of bounded size, on which
the driver plans: patterns of few lengths (up to KINDS buckets of capacity / GRID tokens, each any number of times) that fill a sequence are
enumerated; non-negative least squares fits how often to repeat each so that the patterns together use up the histogram; the
repeats are rounded down and drawn from the lengths at hand, longest first, and closed by the longest that fits; what remains
is packed by best fit, also into the gaps of the patterns' sequences. The plan is a table of runs: documents of length L and ranks r0..r1 go, `each` to a
sequence, into sequences from s on, at an offset. Its size depends on `capacity`, not on the number of documents, so it
can be broadcast; the documents find their place by their rank among those of their length.

Ranks need no group of a whole length in one task: a salt from the document's id splits every length into groups of
about GROUP rows, and the groups' sizes give the rank at which each begins.

Defined cases: a null text is the empty text, which is the end id alone; only texts of more than `capacity` ids are cut; rows
that repeat are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, map_batches, read

CAPACITY = 4096
END_ID = 1
GRID = 48  # units that the capacity is cut into; buckets of length end at whole units
LOOK = 48  # lengths tried for a pattern's last but one document
KINDS = 3  # different buckets in a pattern at most, each any number of times
GROUP = 1000
CACHE_ITEMS = 300_000  # words in a worker's cache
CACHE_WORD = 64  # characters of a word that is kept
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words:
    """Token ids of texts by white-space words, through a cache; for tokenizers whose pre-tokens never span white space."""

    _made: dict[str, Words] = {}

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}
        self.bytes = self._byte_letters()
        self.quick = all(self._quick(w) in (None, self._whole(w)) for w in self._probes())

    @staticmethod
    def _probes() -> Iterator[str]:
        """Words that show whether the quick way is this tokenizer's: every Latin-1 character in every place, and pairs of signs."""
        for c in map(chr, (*range(33, 127), *range(161, 256))):
            yield from (c, f"{c}ab", f"ab{c}", f"a{c}b", f"{c}{c}", f"({c}ab{c}),", f"-{c}word{c}.", c.upper() + "Word")

    @staticmethod
    def _byte_letters() -> list[str]:
        """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = (b for b in range(256) if b not in plain)
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        return [names[b] for b in range(256)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _token(self, word: str) -> bytes:
        """The ids of one pre-token in lower case."""
        word = word if word.isascii() else "".join([self.bytes[b] for b in word.encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _quick(self, word: str) -> bytes | None:
        """The ids of a white-space word made of ASCII signs, Latin-1 letters and ASCII signs; of others None."""
        if not word.isascii():
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return None
        word = word.lower()
        inner = word.strip(SIGNS)
        if not inner.isalpha() or "'" in word:
            return None
        if inner == word:
            return self._token(word)
        out = []
        before, _, after = word.partition(inner)
        for p in (before, inner, after):
            if p:
                ids = self.cache.get(p)
                if ids is None:
                    ids = self._token(p)
                    if len(p) <= CACHE_WORD:
                        self.cache[p] = ids
                out.append(ids)
        return b"".join(out)

    def _new(self, words: set[str]) -> dict[str, bytes]:
        new = {}
        for w in words:
            ids = self._quick(w) if self.quick else None
            new[w] = self._whole(w) if ids is None else ids
        return new

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        words = text.lower().split() if text.isascii() else text.split()
        if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space, the tokenizer doesn't
            return self._whole(text)
        found = list(map(self.cache.get, words))
        if None in found:
            new = self._new({w for w, f in zip(words, found, strict=True) if f is None})
            found = [new[w] if f is None else f for w, f in zip(words, found, strict=True)]
            kept = {w: f for w, f in new.items() if len(w) <= CACHE_WORD}
            if len(self.cache) + len(kept) > CACHE_ITEMS:
                self.cache.clear()
            if len(kept) <= CACHE_ITEMS:
                self.cache.update(kept)
        return b"".join(found)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(words.encode(text.as_py() or "") + end)
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            doc, k, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b| with x >= 0, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if not n or w[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            drop = at[low & (x[at] <= 1e-9)]
            if not len(drop):
                drop = at[low][:1]
            x[drop] = 0
            passive[drop] = False
            if not passive.any():
                break
    return x


def patterns(grid: int, kinds: int) -> list[tuple[tuple[int, int], ...]]:
    """All (bucket, times) sets of up to `kinds` different buckets that add up to `grid` units, buckets falling."""
    out: list[tuple[tuple[int, int], ...]] = []

    def grow(head: tuple[tuple[int, int], ...], below: int, rest: int) -> None:
        for b in range(min(below - 1, rest), 0, -1):
            if len(head) == kinds - 1:  # the last bucket has to fill what is left
                if rest % b == 0:
                    out.append((*head, (b, rest // b)))
                continue
            for times in range(1, rest // b + 1):
                if rest == b * times:
                    out.append((*head, (b, times)))
                else:
                    grow((*head, (b, times)), b, rest - b * times)

    grow((), grid + 1, grid)
    return out


class Plan:
    """Runs of placements, from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.left)
        self.rank: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.fitted = 0  # documents placed by patterns
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, rank after the last, first sequence, each, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # by what is free: runs of sequences (first, how many)
        self.free: list[int] = []

    def put(self, length: int, first: int, many: int, each: int, offset: int) -> None:
        r = self.rank[length]
        self.runs.append((length, r, r + many * each, first, each, offset))
        self.rank[length] = r + many * each
        self.left[length] -= many * each
        if not self.left[length]:
            del self.left[length]

    def leave(self, free: int, first: int, many: int) -> None:
        if free and many:
            if free not in self.open:
                self.open[free] = []
                insort(self.free, free)
            self.open[free].append((first, many))

    def fit_patterns(self, grid: int = GRID, kinds: int = KINDS) -> None:
        width = -(-self.capacity // grid)
        whole = self.capacity // width
        bucket = lambda n: min(whole, max(1, round(n / width)))
        found = patterns(whole, kinds)
        have = np.zeros(whole + 1)
        for n, c in self.left.items():
            have[bucket(n)] += c
        found = [p for p in found if all(have[b] >= t for b, t in p)]
        a = np.zeros((whole + 1, len(found)))
        for j, p in enumerate(found):
            for b, t in p:
                a[b, j] = t
        scale = 1 / np.sqrt(np.maximum(have, 1))
        repeats = np.floor(nnls(a * scale[:, None], have * scale) + 1e-6).astype(np.int64)
        stock: dict[int, list[int]] = defaultdict(list)
        for n in sorted(self.left, reverse=True):
            stock[bucket(n)].append(n)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] > 0:
                self._repeat(found[j], int(repeats[j]), stock)

    def _repeat(self, pattern: tuple[tuple[int, int], ...], times: int, stock: dict[int, list[int]]) -> None:
        """The pattern so many times, or as often as there is stock: runs of sequences with the same lengths."""
        while times:
            need: dict[int, int] = {}
            buckets = [b for b, t in pattern for _ in range(t)]
            for b in buckets[:-2]:
                n = self._first(stock[b], need)
                if n is None:
                    return
                need[n] = need.get(n, 0) + 1
            room = self.capacity - sum(n * t for n, t in need.items())
            while room < 0:  # lengths above their buckets' middles: the shortest goes
                n = min(need)
                need[n] -= 1
                room += n
                if not need[n]:
                    del need[n]
            for n in self._closing(room, need, stock[buckets[-2]] if len(buckets) > 1 else []):
                need[n] = need.get(n, 0) + 1
            if not need:
                return
            many = min(times, *(self.left[n] // t for n, t in need.items()))
            offset = 0
            for n, t in need.items():
                self.put(n, self.sequences, many, t, offset)
                offset += n * t
            self.leave(self.capacity - offset, self.sequences, many)
            self.sequences += many
            self.fitted += many * sum(need.values())
            times -= many

    def _first(self, lengths: list[int], need: dict[int, int]) -> int | None:
        """The longest length of a bucket with stock beyond `need`."""
        while lengths and lengths[0] not in self.left:
            lengths.pop(0)
        return next((n for n in lengths if self.left.get(n, 0) > need.get(n, 0)), None)

    def _closing(self, room: int, need: dict[int, int], lengths: list[int]) -> list[int]:
        """The last two documents: of LOOK lengths of the last but one's bucket that which leaves, with the longest behind it, least room."""
        n = self._longest(room, need)
        best, least = ([], room) if n is None else ([n], room - n)
        for n in islice((n for n in lengths if n <= room and self.left.get(n, 0) > need.get(n, 0)), LOOK):
            if not least:
                break
            m = self._longest(room - n, need | {n: need.get(n, 0) + 1})
            if m is not None and room - n - m < least:
                best, least = [n, m], room - n - m
        return best

    def _longest(self, room: int, need: dict[int, int]) -> int | None:
        """The longest length with stock beyond `need` that fits into the room: the last document closes the pattern."""
        i = bisect_right(self.lengths, room)
        while i:
            n = self.lengths[i - 1]
            if n not in self.left:
                self.lengths.pop(i - 1)
            elif self.left[n] > need.get(n, 0):
                return n
            i -= 1
        return None

    def best_fit(self) -> None:
        """What is left, longest first, each into the fullest sequence that has room."""
        for n in sorted(self.left, reverse=True):
            while many := self.left.get(n, 0):
                i = bisect_left(self.free, n)
                if i == len(self.free):
                    each = self.capacity // n
                    rows = max(1, many // each)
                    each = min(each, many)
                    self.put(n, self.sequences, rows, each, 0)
                    self.leave(self.capacity - each * n, self.sequences, rows)
                    self.sequences += rows
                    continue
                free = self.free[i]
                first, rows = self.open[free].pop()
                if not self.open[free]:
                    del self.open[free]
                    self.free.pop(i)
                each = min(free // n, many)
                take = min(rows, many // each)
                self.leave(free, first + take, rows - take)
                self.put(n, first, take, each, self.capacity - free)
                self.leave(free - each * n, first, take)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    out = Plan(histogram, capacity)
    out.fit_patterns()
    out.best_fit()
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, start, length (1..capacity), ids_crc32."""
    spark = rows.sparkSession
    rows = durable(rows)
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # `capacity` rows at most
    made = plan(histogram, capacity)
    salts = max(1, -(-max(histogram.values(), default=1) // group))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = rows.groupBy("length", "salt").count()
    earlier = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", "salt", F.coalesce(earlier, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("place", place).join(groups, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    runs = spark.createDataFrame(made.runs or [(0, 0, 0, 0, 1, 0)], "run_length long, r0 long, r1 long, s0 long, each long, run_offset long")
    fits = (ranked["length"] == runs["run_length"]) & (ranked["rank"] >= runs["r0"]) & (ranked["rank"] < runs["r1"])
    at = F.col("rank") - F.col("r0")
    return ranked.join(F.broadcast(runs), fits).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("s0") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + at % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(pieces(read(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))
