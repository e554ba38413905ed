"""Removal of repeated passages: every byte under a string of `length` bytes that also starts anywhere else.

Suffixes are narrowed first, by content. Of the `gram`-byte strings in each window of `length` bytes the one with the least
hash is the window's anchor, so equal windows have their anchors at the same place. Windows with one anchor are neighbours
and form a chunk. The work narrows in steps, each a count by key:

1. Texts that are equal as wholes are one text from here on; where there are several, all is repeated.
2. Anchors whose gram occurs once can't belong to a repeated window and are dropped; only texts that have others go on.
3. Chunks with equal contents: all their windows are repeated.
4. The suffixes that start in the other chunks are sorted. Splitters sampled from them cut their order into ranges: by the
   leading token of eight bytes, then by a fingerprint of the `length` bytes, then by text, so that even equal suffixes can be
   shared out. Each range is a bucket, sorted locally by multikey quicksort (the fingerprint only where leading tokens
   tie) and compared with its neighbours; suffixes that equal the splitter below their bucket have a partner across
   the boundary, and one copy of them goes back to meet it.

Nothing is gathered by key: a passage in a third of all texts costs what its rows cost. The rest of a suffix isn't moved: at 400
bytes for each start that would be 400 times the input, which is why a fingerprint stands for it behind the leading token.

Beside the removal, the same count of keys tells which texts share a passage of WORDS words or more with another text, however
few bytes those words have: strings of half as many words are sampled in the same way, and each is looked for elsewhere.

Defined cases: null is the empty text; texts shorter than `length` stay whole; matches never cross texts but may overlap;
rows that repeat are copies of each other; long texts are scanned in segments, with the same result; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import durable, join_groups, map_batches, read, written

LENGTH = 400
WORDS = 50  # passages of so many words are told too
SEGMENT = 1 << 20
BUCKET_ROWS = 1 << 20  # suffixes in a bucket, about; 28 bytes of memory each, and 24 for each bucket's splitter
PARTITIONS = 20_000  # at most; more buckets share them
SAMPLE_ROWS, SAMPLE_TEXTS = 50_000, 400  # suffixes, and texts, at the least that splitters are taken from
SAMPLE_EACH = 16  # suffixes sampled for each bucket, where there are many


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(T._TABLE[data] * T.powers(T._BASE, len(data)), out=out[1:])
    return out


def _span(sums: np.ndarray, s: np.ndarray, e: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of data[s:e] from prefix sums."""
    h = (sums[e] - sums[s]) * T.powers(T._BACK, len(sums))[s]
    return T.mix(h ^ np.uint64(salt))


class Chunks:
    """Chunks of the texts of one slice: owner, first and last window start, gram key."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, gram: int) -> None:
        self.data, self.sums = data, _prefix(data)
        self.length = length
        n, wide = len(data), length - gram + 1
        if n < length:
            self.of = self.p0 = self.p1 = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        grams = _span(self.sums, np.arange(n - gram + 1), np.arange(gram, n + 1))
        low = np.uint64((1 << 24) - 1)
        v = (T.mix(grams + np.uint64(77)) & ~low) | np.arange(len(grams), dtype=np.uint64)
        pad = -len(v) % wide
        grid = np.concatenate([v, np.full(pad, ~np.uint64(0))]).reshape(-1, wide)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - length + 1
        least = (np.minimum(back[:count], ahead[wide - 1 : wide - 1 + count]) & low).astype(np.int64)
        starts = np.arange(count)
        of = T.owner(at, starts)
        inside = np.flatnonzero(starts + length <= at[of + 1])
        of, least = of[inside], least[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(inside)) - 1
        self.of, self.p0, self.p1, self.key = of[first], inside[first], inside[last], grams[least[first]]

    def contents(self, i: np.ndarray) -> np.ndarray:
        """Hashes of whole chunks; with the gram's key they stand for the contents."""
        s, e = self.p0[i], self.p1[i] + self.length
        return _span(self.sums, s, e) ^ (e - s).astype(np.uint64)

    def suffixes(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of some chunks: start, leading token of eight bytes, fingerprint of the whole."""
        many = self.p1[i] - self.p0[i] + 1
        p = np.repeat(self.p0[i] - np.cumsum(many) + many, many) + np.arange(many.sum())
        lead = np.zeros(len(p), np.uint64)
        for k in range(min(8, self.length)):
            lead = lead << np.uint64(8) | self.data[p + k]
        return p, lead, _span(self.sums, p, p + self.length, 0x2545F4914F6CDD1D)


def word_strings(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text of a slice the distinct keys of its sampled strings of words // 2 words: in every `words` words there is one."""
    size = words // 2
    starts, ends = T.runs(data, at, T.IS_SPACE)
    of = T.owner(at, starts)
    keys, begin = T.windows(T.hashes(data, starts, ends), of, size)
    wide, n = words - size + 1, len(at) - 1
    count = len(keys) - wide + 1
    if count <= 0:
        return [np.zeros(0, np.int64)] * n
    low = np.uint64((1 << 24) - 1)  # a slice has fewer words, or is one long text, where ties fall to a later place as well
    v = (T.mix(keys + np.uint64(77)) & ~low) | (np.arange(len(keys), dtype=np.uint64) & low)
    grid = np.concatenate([v, np.full(-len(v) % wide, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    base = np.arange(count)
    least = np.minimum(back[:count], ahead[wide - 1 : wide - 1 + count]) & low
    least = base + ((least - base.astype(np.uint64)) & low).astype(np.int64)  # places modulo 2^24, from the window's own
    least = np.unique(least[of[begin[:count]] == of[begin[wide - 1 :]]])
    owner = of[begin[least]]
    cut = np.searchsorted(owner, np.arange(n + 1))
    return [np.unique(keys[least[i:j]]).view(np.int64) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _parts(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> Iterator[tuple[Chunks, int]]:
    """Chunks of a slice, a long text in segments; with where the segment begins."""
    if len(at) > 2 or len(data) <= 2 * SEGMENT:
        yield Chunks(data, at, length, gram), 0
        return
    for a in range(0, len(data) - length + 1, SEGMENT):
        part = data[a : a + SEGMENT + length - 1]
        yield Chunks(part, np.array([0, len(part)]), length, gram), a


def anchors(docs: DataFrame, length: int, gram: int, words: int = WORDS) -> DataFrame:
    """doc_id, sha, n_bytes, keys (of the grams of the text's chunks, in order), strings (of the text's sampled word strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in T.texts(batch.column(1), T.BLOCK):
                n = len(at) - 1
                keys: list = [np.zeros(0, np.int64)] * n
                for c, a in _parts(data, at, length, gram):
                    cut = np.searchsorted(c.of, np.arange(n + 1))
                    k = c.key.view(np.int64)
                    if n == 1:
                        keys[0] = np.concatenate([keys[0], k])
                    else:
                        keys = [k[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
                sha = [hashlib.sha256(data[i:j]).digest() for i, j in zip(at[:-1], at[1:], strict=True)]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, word_strings(data, at, words))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(sha, pa.binary()), pa.array(np.diff(at), pa.int64()), *lists], ["doc_id", "sha", "n_bytes", "keys", "strings"])

    return map_batches(docs, run, "doc_id long, sha binary, n_bytes long, keys array<long>, strings array<long>")


def _each(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[int, int, Chunks, int]]:
    """For each text (column `text`) of a batch and each of its parts: row, number of the first chunk, chunks, place."""
    for first, data, at in T.texts(batch.column("text"), T.BLOCK):
        for row in range(len(at) - 1):
            text, base = data[at[row] : at[row + 1]], 0
            for c, a in _parts(text, np.array([0, len(text)]), length, gram):
                yield first + row, base, c, a
                base += len(c.p0)


def _here(numbers: pa.Scalar, base: int, c: Chunks) -> np.ndarray:
    """Which of the chunk numbers are in this part, counted from its first."""
    if not numbers.is_valid:
        return np.zeros(0, np.int64)
    j = numbers.values.to_numpy()
    return np.sort(j[(j >= base) & (j < base + len(c.p0))]).astype(np.int64) - base


NARROW = ("bucket", "p")  # a text has less than 2^31 bytes


def _batch(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        arrays = (np.concatenate(x) for x in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32 if c in NARROW else np.int64)) for c, x in zip(names, arrays, strict=True)], names)


def _chunk_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # tid, text, js
            tid, js, rows = batch.column("tid").to_numpy(), batch.column("js"), []
            for row, base, c, a in _each(batch, length, gram):
                mine = _here(js[row], base, c)
                if len(mine):
                    rows.append((np.full(len(mine), tid[row]), mine + base, c.key[mine].view(np.int64), c.contents(mine).view(np.int64), c.p0[mine] + a, c.p1[mine] + a))
            yield from _batch(rows, ["tid", "j", "key", "content", "p0", "p1"])

    return run


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their words, most significant first: a word is looked at only where all before it tie."""
    order = np.argsort(words[0])
    new = np.ones(len(order), bool)
    new[1:] = words[0][order][1:] != words[0][order][:-1]
    for w in words[1:]:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        group, rows = np.cumsum(new)[tied], order[tied]
        inner = np.lexsort((w[rows], group))
        order[tied] = rows[inner]
        v = w[order]
        new[1:] |= v[1:] != v[:-1]
    return order


class Splitters:
    """Sampled suffixes (lead, h, tid) that cut the order of all suffixes into buckets; each is the last of its bucket."""

    def __init__(self, rows: np.ndarray, buckets: int) -> None:
        rows = rows.astype(np.int64).reshape(-1, 3).view(np.uint64)
        rows = rows[multikey_order(list(rows.T))] if len(rows) else rows
        at = np.unique(np.arange(1, buckets) * len(rows) // buckets) if len(rows) else np.zeros(0, np.int64)
        rows = rows[at]
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]).any(1)
        self.rows = rows[keep]
        self.lead = np.ascontiguousarray(self.rows[:, 0])
        self.whole = self._bytes(self.rows)

    @staticmethod
    def _bytes(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u8")).view("S24").ravel()

    def bucket(self, lead: np.ndarray, h: np.ndarray, tid: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.lead, lead, "left")
        tie = np.flatnonzero(low < np.searchsorted(self.lead, lead, "right"))
        if len(tie):
            low[tie] = np.searchsorted(self.whole, self._bytes(np.stack([lead[tie], h[tie], tid[tie]], 1)), "left")
        return low

    def alike(self, i: np.ndarray, lead: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether suffixes have the string of the splitters numbered i; -1 is none."""
        if not len(self.rows):
            return np.zeros(len(i), bool)
        r = self.rows[np.maximum(i, 0)]
        return (i >= 0) & (r[:, 0] == lead) & (r[:, 1] == h)


SUFFIX = ["bucket", "lead", "h", "tid", "p"]


def _suffix_rows(length: int, gram: int, splitters: Splitters | None, each: int = 1):
    """A row for each suffix of the chunks asked for; p is -1 in those that are only there to be met by others.

    Without splitters it is a sample, of one in `each`. With them, a suffix that has the string of the splitter below its bucket is
    sent to that splitter's bucket too, once in a task, to be met there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:  # tid, text, asked, met
            tids, rows, size = batch.column("tid").to_numpy(), [], 0
            for row, base, c, a in _each(batch, length, gram):
                for column in ("asked", "met"):
                    mine = _here(batch.column(column)[row], base, c)
                    if not len(mine):
                        continue
                    p, lead, h = c.suffixes(mine)
                    tid = np.full(len(p), tids[row], np.uint64)
                    if splitters is None:
                        some = T.mix(tid * np.uint64(0x9FB21C651E98DF25) ^ (p + a).astype(np.uint64)) % np.uint64(each) == 0
                        rows.append(tuple(x[some].view(np.int64) for x in (np.zeros_like(lead), lead, h, tid, np.zeros_like(lead))))
                    else:
                        bucket = splitters.bucket(lead, h, tid)
                        at = p + a if column == "asked" else np.full(len(p), -1)
                        rows.append((bucket, *(x.view(np.int64) for x in (lead, h, tid)), at))
                        for i in np.flatnonzero(splitters.alike(bucket - 1, lead, h)).tolist():
                            # equal splitters follow each other; the copy goes to the first of them
                            back = int(splitters.bucket(lead[i : i + 1], h[i : i + 1], np.zeros(1, np.uint64))[0])
                            if back not in told:
                                told.add(back)
                                rows.append((np.array([back]), *(x[i : i + 1].view(np.int64) for x in (lead, h, tid)), np.array([-1])))
                    size += len(p)
                if size > 100_000:
                    yield from _batch(rows, SUFFIX)
                    rows, size = [], 0
            yield from _batch(rows, SUFFIX)

    return run


def _sorted_buckets(splitters: Splitters):
    """Of a bucket's suffixes those that were asked for and have an equal: a neighbour, or the splitter below the bucket."""

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        bucket, lead, h, tid, p = (table.column(c).to_numpy() for c in SUFFIX)
        lead, h = lead.view(np.uint64), h.view(np.uint64)
        order = multikey_order([lead, h])
        same = (lead[order][1:] == lead[order][:-1]) & (h[order][1:] == h[order][:-1])
        hit = splitters.alike(bucket[order] - 1, lead[order], h[order])
        hit[1:] |= same
        hit[:-1] |= same
        found = order[hit & (p[order] >= 0)]
        for i in range(0, len(found), 100_000):
            part = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(tid[part]), pa.array(p[part])], ["tid", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one bucket; a partition's buckets come one after the other
        for batch in batches:
            number = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("bucket")[0].as_py() != number[i]:
                    yield from one(held)
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield from one(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of spans (tid, s, e) that come in the order of tid and s; across batches too."""
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tid, s, e = (batch.column(c).to_numpy() for c in ("tid", "s", "e"))
        if last:
            tid, s, e = (np.append(x, y) for x, y in zip(last, (tid, s, e), strict=True))
        first = np.ones(len(tid), bool)
        first[1:] = tid[1:] != tid[:-1]
        group = np.cumsum(first) - 1
        room = np.int64(1) << 40  # more than any text's bytes: one running maximum serves all texts
        reach = np.maximum.accumulate(group * room + e) - group * room
        new = first.copy()
        new[1:] |= s[1:] > reach[:-1]
        a = np.flatnonzero(new)
        rows = tid[a], s[a], reach[np.append(a[1:], len(tid)) - 1]
        last = tuple(x[-1:] for x in rows)
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in rows], ["tid", "s", "e"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["tid", "s", "e"])


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sha, text, s, e
            rows = []
            for sha, text, s, e in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
                mark = np.zeros(len(raw) + 1, np.int32)
                np.add.at(mark, s.values.to_numpy(), 1)
                np.add.at(mark, e.values.to_numpy(), -1)
                gone = np.cumsum(mark[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                rows.append((sha.as_py(), int(gone.sum()), spans, raw[~gone].tobytes()))
            a, b, c, d = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["sha", "n_removed", "n_spans", "kept"])

    return run


def _every(step: int):
    """One row in so many of each sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = step // 2
        for batch in batches:
            at = np.flatnonzero((np.arange(batch.num_rows) + seen) % step == 0)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    return run


def _half(sha: str, part: int):
    """64 bits of a digest as a number; two parts stand for a text in narrow rows."""
    return F.expr(f"cast(conv(hex(substring({sha}, {8 * part - 7}, 8)), 16, -10) as long)")


def _suffixes_met(found: DataFrame, contents: DataFrame, length: int, gram: int) -> DataFrame:
    """tid, p of the suffixes in chunks that share an anchor's gram with a chunk of other contents and have an equal."""
    spark = found.sparkSession
    several = durable(contents.groupBy("key").count().where("count > 1").select("key"))
    todo = contents.join(several, "key", "left_semi").select("one.*", "n")
    alone = F.col("n") == 1
    per_text = todo.groupBy("tid").agg(F.collect_set(F.when(alone, F.col("j"))).alias("asked"), F.collect_set(F.when(~alone, F.col("j"))).alias("met"), F.sum("many").alias("many"))
    per_text = durable(per_text)
    size = per_text.agg(F.sum("many").alias("rows"), F.count("*").alias("texts")).first()
    asked = found.select("tid", "text").join(per_text, "tid").select("tid", "text", "asked", "met")
    kinds = "bucket int, lead long, h long, tid long, p int"
    rows = size["rows"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    # texts enough, then suffixes of them: as many as it takes, but no more, however long the texts are
    want = max(SAMPLE_ROWS, SAMPLE_EACH * buckets)
    share = min(1.0, max(SAMPLE_EACH * want / max(1, rows), SAMPLE_TEXTS / max(1, size["texts"])))
    some = asked.where(F.pmod(F.xxhash64("tid"), F.lit(1 << 20)) < share * (1 << 20))
    sample = map_batches(some, _suffix_rows(length, gram, None, max(1, int(share * rows / want))), kinds)
    order = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in ("lead", "h", "tid")]  # as numbers without a sign
    spread = sample.select("lead", "h", "tid").repartitionByRange(*order).sortWithinPartitions(*order)
    quantiles = map_batches(spread, _every(max(1, want // (4 * buckets))), "lead long, h long, tid long").collect()  # some for each bucket
    splitters = Splitters(np.array([tuple(r) for r in quantiles], np.int64), buckets)
    dealt = map_batches(asked, _suffix_rows(length, gram, splitters), kinds)
    if buckets <= PARTITIONS:
        dealt = dealt.repartitionById(buckets, "bucket")
    else:  # several buckets to a partition, one after the other
        dealt = dealt.repartitionById(PARTITIONS, F.expr(f"CAST(CAST(bucket AS BIGINT) * {PARTITIONS} DIV {buckets} AS INT)")).sortWithinPartitions("bucket")
    return map_batches(dealt, _sorted_buckets(splitters), "tid long, p int")


def passages_removed(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Two frames: doc_id, sha, n_bytes, copies, n_shared of each document; and sha, n_removed, n_spans, kept (bytes) of changed texts.

    Texts that have copies and `length` bytes or more lose everything; they are only in the first frame. n_shared: how many of
    the text's sampled word strings another document holds; a document that shares WORDS words in a row has one at least.
    """
    gram = length // 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = durable(anchors(docs, length, gram))
    texts = durable(seen.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    both = F.concat(F.transform("keys", lambda k, j: F.struct(j.alias("j"), k.alias("key"))), F.transform("strings", lambda k: F.struct(F.lit(-1).alias("j"), k.alias("key"))))
    spots = seen.select(_half("sha", 1).alias("t1"), F.explode(both).alias("x")).select("t1", "x.j", "x.key")
    # in two texts, or at two places of one; copies of a text are one text. The sum stands for both: digests are random
    place = F.try_add("t1", F.col("j").cast("long"))
    place = F.coalesce(place, F.col("t1"))
    twice = durable(spots.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("many")).where("a <> b").select("key", "many"))
    gram_at, string = F.when(F.col("j") >= 0, F.col("j")), F.when(F.col("j") < 0, F.col("key"))
    held = durable(join_groups(spots, twice, ["key"], "many").groupBy("t1").agg(F.collect_set(gram_at).alias("js"), F.size(F.collect_set(string)).alias("n_shared")))
    texts = durable(texts.withColumn("t1", _half("sha", 1)).join(held, "t1", "left").select("sha", "rep", "copies", "js", F.coalesce("n_shared", F.lit(0)).alias("n_shared")))

    # joined and made distinct by the same keys, so that whole texts are moved once; a null id is taken as 0, rows of one sha have one text
    rep = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias("rep")
    mine = docs.select(rep("doc_id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text")
    todo = texts.where(F.size("js") > 0).select("sha", rep("rep"), "copies", "js")
    found = mine.join(todo, ["rep", "sha"]).dropDuplicates(["rep", "sha"])
    found = written(found.select(F.monotonically_increasing_id().alias("tid"), "sha", "text", "js", "copies"), "texts")
    chunks = map_batches(found.select("tid", "text", "js"), _chunk_rows(length, gram), "tid long, j long, key long, content long, p0 long, p1 long")
    one = F.min(F.struct("tid", "j", (F.col("p1") - F.col("p0") + 1).alias("many"))).alias("one")
    contents = written(chunks.groupBy("key", "content").agg(F.count("*").alias("n"), one), "contents")
    full = chunks.join(contents.where("n > 1").select("key", "content"), ["key", "content"], "left_semi").select("tid", F.col("p0").alias("s"), (F.col("p1") + length).alias("e"))
    parts = _suffixes_met(found, contents, length, gram).select("tid", F.col("p").alias("s"), (F.col("p") + length).alias("e"))

    spans = map_batches(full.unionByName(parts).repartition("tid").sortWithinPartitions("tid", "s"), _merged, "tid long, s long, e long")
    spans = spans.groupBy("tid").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    changed = found.where("copies = 1").select("tid", "sha", "text").join(durable(spans), "tid").select("sha", "text", "s", "e")
    changed = map_batches(changed, _cut(length), "sha binary, n_removed long, n_spans long, kept binary")
    shared = F.when(F.col("copies") > 1, F.greatest("n_strings", "n_shared")).otherwise(F.col("n_shared")).cast("long").alias("n_shared")
    each = join_groups(seen.select("doc_id", "sha", "n_bytes", F.size("strings").alias("n_strings")), texts.select("sha", "copies", "n_shared"), ["sha"], "copies")
    return each.select("doc_id", "sha", "n_bytes", "copies", shared), changed


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, changed = passages_removed(read(spark, sf_dir, "documents"))
    changed = durable(changed.select("sha", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    rows = docs.join(changed, "sha", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        "n_shared",
    )
