"""MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of `size` words. Documents with the same set are one node, so exact copies cost
one row each and no pair. Every node has `SAMPLES` MinHash samples. They are folded into a parity bitmap (the odd
sketch): the XOR of two bitmaps has the parity of the samples that differ, and its population count estimates how many
those are, precisely where similarity is high. Bands of samples find candidates, the sketches drop those that are clearly
below the threshold, and the rest are confirmed on the full sets.

No bucket is expanded into all its pairs. First every node of a bucket meets the bucket's least node only; confirmed
links join nodes to components. Then only buckets that still hold nodes of different components are looked at again:
their nodes are cut into blocks of about BLOCK nodes or BYTES of sets, and each pair of blocks is a task's group of bounded size: pairs of
different components whose sketches agree are confirmed there on their full sets, and only links come out. Pairs within
a component need no test, as they can't change the result. So every candidate pair that could matter is tested, none is
emitted, and nothing is capped.

Defined cases: a null text has no words; a text without words has an empty set and is linked with nothing, its
component is its own id; with fewer than `size` words the whole sequence is one shingle; rows that repeat share a set
and so a component, each with its row; null ids are larger than any id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as T
from .common import durable, map_batches, read, spare
from .components import components

SAMPLES = 128
BITS = 512  # of the parity bitmap
BLOCK = 512  # nodes of a block, about
BYTES = 32 << 20  # of a block's sets, about
MISS = 1e-6  # chance at most that a pair at the threshold has no band in common

_seed = np.random.default_rng(41)
_MUL = _seed.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _seed.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def band_rows(similarity: float) -> int:
    """The most samples in a band that keep the chance of a miss below MISS."""
    return max(r for r in range(1, SAMPLES) if r == 1 or (1 - similarity**r) ** (SAMPLES // r) <= MISS)


def most_bits(similarity: float) -> int:
    """Set bits in the XOR of two sketches beyond which a pair is clearly below the threshold (5.5 standard deviations)."""
    off = SAMPLES * (1 - similarity)
    off += 5.5 * math.sqrt(SAMPLES * similarity * (1 - similarity))
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * off))
    return math.ceil(expected)


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a slice, ascending, and the text each belongs to."""
    data = T.TO_LOWER[data]
    starts, ends = T.runs(data, at, T.IS_SPACE)
    of = T.owner(at, starts)
    words = T.hashes(data, starts, ends)
    keys, begin = T.windows(words, of, size)
    owner = of[begin]
    n = len(at) - 1
    many = T.counts(of, n)
    first = np.cumsum(many) - many
    short = np.flatnonzero((many > 0) & (many < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            live = many[short] > k
            extra[live] = extra[live] * np.uint64(T._STEP) + words[first[short[live]] + k]
        extra = T.mix(extra + many[short].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        keys, owner = np.concatenate([keys, extra]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], owner[new]


def set_keys(keys: np.ndarray, first: np.ndarray, many: np.ndarray) -> list[bytes]:
    """128 bits that identify each set: two sums of differently mixed members, with the size."""
    a = np.add.reduceat(T.mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
    b = np.add.reduceat(T.mix(keys * np.uint64(0x9FB21C651E98DF25)), first) ^ many.astype(np.uint64)
    return [x.tobytes() for x in np.stack([a, b], 1).astype(">u8")]


def samples(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples, a row for each text."""
    low = (keys ^ (keys >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(first), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        v = (low ^ _XOR[k]) * _MUL[k]
        out[:, k] = np.minimum.reduceat(v, first)
    return out


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: BITS / 64 longs for each row."""
    bit = T.mix(sig.astype(np.uint64) ^ (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(33))) % np.uint64(BITS)
    flat = np.bincount((np.arange(len(sig))[:, None] * BITS + bit.astype(np.int64)).ravel(), minlength=len(sig) * BITS) & 1
    return np.packbits(flat.astype(np.uint8).reshape(len(sig), BITS), axis=1).view(np.int64)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n = SAMPLES // rows
    out = np.zeros((len(sig), n), np.uint64)
    for k in range(rows):
        out = T.mix(out * np.uint64(T._STEP) + sig[:, k : n * rows : rows])
    return T.mix(out ^ (np.arange(n, dtype=np.uint64) << np.uint64(40))).view(np.int64)


def signatures(docs: DataFrame, size: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key (null for empty sets), bands and sketch, and `sha` of documents that have it."""
    carried = [c for c in ("sha",) if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, at in T.texts(batch.column(1), T.BLOCK):
                n = len(at) - 1
                keys, of = shingles(data, at, size)
                many = T.counts(of, n)
                full = np.flatnonzero(many)
                key: list = [None] * n
                bands: list = [None] * n
                sketch: list = [None] * n
                if len(full):
                    first = (np.cumsum(many) - many)[full]
                    sig = samples(keys, first)
                    for i, k, b, s in zip(full.tolist(), set_keys(keys, first, many[full]), band_keys(sig, rows).tolist(), odd_sketch(sig).tolist(), strict=True):
                        key[i], bands[i], sketch[i] = k, b, s
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array(many), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())), *(batch.column(2 + i).slice(start, n) for i in range(len(carried)))],
                    ["doc_id", "n_shingles", "key", "bands", "sketch", *carried],
                )

    kinds = "doc_id long, n_shingles long, key binary, bands array<long>, sketch array<long>" + "".join(f", {c} binary" for c in carried)
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried), run, kinds)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """key, n (members) and members of each document with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in T.texts(batch.column(0), T.BLOCK):
                keys, of = shingles(data, at, size)
                many = T.counts(of, len(at) - 1)
                many = many[many > 0]
                if len(many):
                    ends = np.cumsum(many)
                    members = [keys[a:b].tobytes() for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(set_keys(keys, ends - many, many), pa.binary()), pa.array(many), pa.array(members, pa.binary())], ["key", "n", "members"])

    return map_batches(docs.select(F.col("text").cast("string")), run, "key binary, n long, members binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v of keys) those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for n, a, m, b in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), strict=True):
                both = _common(*(np.frombuffer(z.as_buffer(), np.uint64) for z in (a, b)))
                yes.append(100 * both >= percent * (n + m - both))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    left = sets.select(F.col("key").alias("u"), F.col("n").alias("n"), F.col("members").alias("a"))
    right = sets.select(F.col("key").alias("v"), F.col("n").alias("m"), F.col("members").alias("b"))
    return map_batches(pairs.join(left, "u").join(right, "v").select("u", "v", "n", "a", "m", "b"), run, "u binary, v binary")


def _apart(a: str, b: str):
    """Bits that differ between two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _blocks_compared(most: int, percent: int):
    """Confirmed links between nodes of different components in one pair of blocks.

    Sizes and sketches come first, full sets last; a pair is looked at in the first band it shares only, and what a link has
    joined needs no second one. So few links come out, however many pairs are alike.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key, side, n = group["key"].to_numpy(), group["side"].to_numpy(), group["n"].to_numpy()
        bits = np.stack(group["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
        bands = np.stack(group["bands"].to_numpy()).astype(np.int64)
        here = int(np.flatnonzero(bands[0] == group["band"].iloc[0])[0])
        code = pd.factorize(pd.Series([bytes(x) for x in group["root"]]))[0]
        members = [np.frombuffer(x, np.uint64) for x in group["members"]]
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        us, vs = [], []
        for i in left.tolist():
            other = right[(code[right] != code[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if not len(other):
                continue
            other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(1) <= most]
            if here and len(other):
                other = other[~(bands[other, :here] == bands[i, :here]).any(1)]
            for j in other.tolist():
                if code[i] != code[j] and 100 * (both := _common(members[i], members[j])) >= percent * (n[i] + n[j] - both):
                    u, v = sorted((bytes(key[i]), bytes(key[j])))
                    us.append(u)
                    vs.append(v)
                    code[code == code[j]] = code[i]
        return pd.DataFrame({"u": us, "v": vs}, dtype=object)

    return run


def _sha(text: Column) -> Column:
    """The identity of a text beside its document's id, which may be null or repeat."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def linked(docs: DataFrame, size: int = 5, percent: int = 80, with_sha: bool = False) -> DataFrame:
    """doc_id, n_shingles, key and root (both null for empty sets), and sha of the text if wanted: documents with one root are one component."""
    rows = band_rows(percent / 100)
    most = most_bits(percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = durable(signatures(docs.withColumn("sha", _sha(F.col("text"))) if with_sha else docs, size, rows))
    nodes = signed.where(F.col("key").isNotNull()).groupBy("key")
    nodes = durable(nodes.agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")))
    banded = nodes.select("key", F.explode("bands").alias("band"))
    shared = durable(banded.groupBy("band").agg(F.min("key").alias("u"), F.count("*").alias("many")).where("many > 1"))
    inside = durable(banded.join(shared.select("band", "u"), "band"))
    wanted = nodes.select("key", "id", "n", "sketch", "bands").join(inside.select("key").distinct(), "key", "left_semi")
    wanted = durable(wanted)
    ids = wanted.select("id").distinct()
    sets = full_sets(docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi"), size)
    sets = durable(sets.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))

    # every node with the least node of its bucket
    stars = inside.where(F.col("key") > F.col("u")).select("u", F.col("key").alias("v")).distinct()
    one = wanted.select(F.col("key").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    two = wanted.select(F.col("key").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    near = stars.join(one, "u").join(two, "v").where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).where(_apart("su", "sv") <= most)
    links = durable(_confirm(durable(near.select("u", "v")), sets, percent))
    found = durable(components(links))

    # buckets that still hold different components
    rooted = durable(wanted.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "sketch", "bands", F.coalesce("root", "key").alias("root")))
    member = durable(inside.select("key", "band").join(rooted.select("key", "root", "n"), "key"))
    mixed = member.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("many"), F.sum("n").alias("members")).where("r0 <> r1")
    parts = F.least("many", F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("members") * 8 / BYTES)))
    mixed = durable(mixed.select("band", parts.cast("int").alias("parts")))
    todo = member.select("key", "band").join(mixed, "band").join(rooted, "key").join(sets.select("key", "members"), "key")
    todo = todo.withColumn("part", F.pmod(F.xxhash64("key", "band"), F.col("parts")).cast("int"))
    todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    todo = todo.select(
        "key",
        "root",
        "n",
        "sketch",
        "bands",
        "members",
        "band",
        F.least("part", "other").alias("p"),
        F.greatest("part", "other").alias("q"),
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    more = durable(todo.groupBy("band", "p", "q").applyInPandas(_blocks_compared(most, percent), "u binary, v binary"))
    if not more.isEmpty():
        found = durable(components(more.unionByName(found.select(F.col("node").alias("u"), F.col("root").alias("v")))))
    return signed.select("doc_id", "n_shingles", "key", *(["sha"] if with_sha else [])).join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (least doc_id of the component), kept."""
    rows = durable(linked(docs, size, percent))
    least = durable(rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least")))
    out = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the one with the least id, all columns as they were.

    A document is known by its id and its text: null ids count as larger than any id, of documents with one id in a component the
    one with the least digest of its text stays, and of rows that repeat an id and a text one stays. Texts without words are
    linked with nothing and stay.
    """
    rows = durable(linked(docs, size, percent, with_sha=True))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")).alias("x")
    keep = rows.where(F.col("root").isNotNull()).groupBy("root").agg(least).select("x.doc_id", "x.sha")
    keep = keep.unionByName(rows.where(F.col("root").isNull()).select("doc_id", "sha").distinct())
    null, ident, sha, place = by = spare(docs.columns, "copy_null", "copy_id", "copy_sha", "copy_place")
    keep = durable(keep.select(F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).alias(ident), F.col("sha").alias(sha)))
    id_of = F.col("doc_id").cast("long")
    mine = docs.withColumns({null: id_of.isNull(), ident: F.coalesce(id_of, F.lit(0)), sha: _sha(F.col("text"))}).join(keep, by[:3], "left_semi")
    first = F.row_number().over(Window.partitionBy(*by[:3]).orderBy("text"))  # rows that repeat an id and a text
    return mine.withColumn(place, first).where(F.col(place) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), size=3, percent=85)
