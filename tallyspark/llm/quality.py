"""Quality rules: counts over words and lines, and compression bands.

Base counts come from vectorised scans of the bytes; words, lines and windows are compared as they are, not by hashes. The method's own verdict: zstandard's ratio (compressed size by raw
size) of the whole text and of each fixed chunk has to lie in a band that depends on the length compressed. A ratio
below the band is repetitive text, one above is text without the redundancy of language. A text goes when the whole is
outside its band, or when more than BAD_SHARE of its bytes are in chunks outside theirs.

Defined cases: null text has no words and is an empty text; it fails the base rule (fewer than MIN_WORDS words), and so
does any other text without words. Texts shorter than the shortest band's length are judged by the base rule alone. An
empty table gives no rows. Rows that repeat are judged each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import map_batches, read

MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words in repeated windows
WINDOW = 8
SYMBOLS = "#*$%&|<>"
CHUNK = 4096
LEVEL = 3
BAD_SHARE = 0.5
#: Bytes from which a band holds, its lowest and highest ratio. Longer text compresses better.
BANDS = ((200, 0.48, 0.92), (500, 0.44, 0.85), (1000, 0.41, 0.78), (2000, 0.39, 0.72), (4096, 0.37, 0.68), (16384, 0.33, 0.64), (65536, 0.30, 0.62))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_share double"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NOT_LINE = np.zeros(256, bool)
_NOT_LINE[10] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs twice or more."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(k), bool)
    out[order] = same
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs of numbers, equal exactly where both are."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _windows(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows of WINDOW words within one text, equal exactly where text and words are, and where each begins."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide, key = 1, words
    while wide < WINDOW:  # WINDOW is a power of two
        key, wide = _pairs(key[:-wide], key[wide:]), 2 * wide
    begin = np.flatnonzero(of[: len(key)] == of[WINDOW - 1 :])
    return _pairs(of[begin], key[begin]), begin


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    n = len(at) - 1
    starts, ends = T.runs(data, at, T.IS_SPACE)
    of = T.owner(at, starts)
    words = T.numbers(data, starts, ends)
    out = {"n_words": T.counts(of, n), "word_chars": T.sums(~T.IS_SPACE[data] & ((data & 0xC0) != 0x80), at), "n_symbols": T.sums(_IS_SYMBOL[data], at)}

    ls, le = T.runs(data, at, _NOT_LINE)
    first = np.searchsorted(starts, ls)
    has_word = (first < len(starts)) & (starts[np.minimum(first, len(starts) - 1)] < le) if len(starts) else np.zeros(len(ls), bool)
    ls, le = ls[has_word], le[has_word]
    line_of = T.owner(at, ls)
    lines = _pairs(line_of, T.numbers(data, ls, le))
    _, one = np.unique(lines, return_index=True)
    out["n_dup_lines"] = T.counts(line_of, n) - T.counts(line_of[one], n)

    keys, begin = _windows(words, of)
    twice = begin[_repeats(keys)]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    out["n_repeat_words"] = T.counts(of[np.cumsum(cover[:-1]) > 0], n)
    return out


def band(size: int) -> tuple[float, float]:
    lo, hi = 0.0, float("inf")
    for least, a, b in BANDS:
        if size >= least:
            lo, hi = a, b
    return lo, hi


def compression(raw: memoryview, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The whole text's ratio, and the share of its bytes in chunks outside their band (1 if the whole is outside)."""
    size = len(raw)
    if not size:
        return 1.0, 0.0
    ratio = len(compressor.compress(raw)) / size
    lo, hi = band(size)
    if not lo <= ratio <= hi:
        return ratio, 1.0
    if size <= CHUNK:
        return ratio, 0.0
    bad = 0
    for i in range(0, size, CHUNK):
        part = raw[i : i + CHUNK]
        lo, hi = band(len(part))
        bad += len(part) * (not lo <= len(compressor.compress(part)) / len(part) <= hi)
    return ratio, bad / size


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for first, data, at in T.texts(batch.column(1), T.BLOCK):
            c = base_counts(data, at)
            raw = memoryview(data)
            both = np.array([compression(raw[a:b], compressor) for a, b in zip(at[:-1], at[1:], strict=True)]).reshape(-1, 2)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])
            kept = ~failed & (both[:, 1] <= BAD_SHARE)
            n = len(at) - 1
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), *(pa.array(c[k], pa.int64()) for k in names), pa.array(failed), pa.array(kept), pa.array(both[:, 0]), pa.array(both[:, 1])],
                ["doc_id", *names, "base_failed", "kept", "ratio", "bad_share"],
            )


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, the counts, ratio, bad_share, base_failed and kept."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _judge, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, in one pass and without a shuffle."""
    text_at = docs.columns.index("text")

    def keep(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for first, data, at in T.texts(batch.column(text_at), T.BLOCK):
                c = base_counts(data, at)
                raw = memoryview(data)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])
                good = [not f and compression(raw[a:b], compressor)[1] <= BAD_SHARE for f, a, b in zip(failed, at[:-1], at[1:], strict=True)]
                yield batch.slice(first, len(good)).filter(pa.array(good, pa.bool_()))

    return map_batches(docs, keep, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
