"""Periodic runs of words: maximal pairs from the LCP-interval tree.

A run of period q and length L begins at s exactly when (s, s + q) is a maximal pair of repeats: the L - q words from s on
equal those from s + q on, and neither the words before nor those behind agree. So runs need no extension: they are the
maximal pairs whose distance is short beside what they share (l >= 3q, and l >= 5 for six words at least). Of pairs that
span the same words the shortest distance is the smallest period.

Words get exact numbers and suffixes are sorted by prefix doubling, each text by itself, vectorised over slices of a
megabyte; ranks of every round give the longest common prefixes. Only suffixes that share five words with another one
nearby can be in a pair: for each group of them the tree of LCP intervals is walked bottom-up, every node holding its
positions by the word on their left, and a smaller child's positions look for partners with another left word, within a
third of the node's depth, in the larger one.

Defined cases: null text has no words and no runs, its hashes are those of the empty string; a null doc_id counts as the
empty text where crc32 is taken; rows that repeat are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import map_batches, read

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
SHARED = LEAST - 1  # words that the suffixes of any pair share at least

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, the place at which each one's group of equals begins, and which of them have equals."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(k)))
    rank = np.empty(len(k), np.int64)
    rank[order] = np.repeat(first, many)
    tied = np.empty(len(k), bool)
    tied[order] = np.repeat(many > 1, many)
    return order, rank, tied


def suffixes(words: np.ndarray, of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of every text in order, text by text, and what each shares with the one before (0 across texts).

    words: numbers; of: each word's text, ascending; ends: where each word's text ends.
    """
    n = len(words)
    _, rank, tied = _ranked(of * (int(words.max()) + 1) + words)
    rounds, step = [rank], 1
    left = np.flatnonzero(tied)
    while len(left):
        behind = np.where(left + step < ends[left], rank[np.minimum(left + step, n - 1)], -1)
        order, again, tied = _ranked(rank[left] * (n + 1) + behind + 1)
        group = rank[left]
        sizes = np.unique(group, return_index=True, return_counts=True)
        # ranks within a group of equals begin at the group's own rank
        before = np.zeros(len(left), np.int64)
        before[order] = np.repeat(np.cumsum(sizes[2]) - sizes[2], sizes[2])
        rank = rank.copy()
        rank[left] = group + again - before
        rounds.append(rank)
        left, step = left[tied], 2 * step
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    at = np.flatnonzero(rounds[0][a] == rounds[0][b])
    a, b = a[at].copy(), b[at].copy()
    far = np.zeros(len(at), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        inside = (a + far < ends[a]) & (b + far < ends[b])
        same = inside & (rounds[k][np.minimum(a + far, n - 1)] == rounds[k][np.minimum(b + far, n - 1)])
        far += same.astype(np.int64) << k
    shared[at + 1] = far
    return order, shared


def _near(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that could be in a pair, with what each shares with the one before among them: those whose nearest suffix with SHARED words in common isn't too far."""
    n = len(order)
    top = np.cumsum(shared < SHARED)  # the tree's roots: groups with SHARED words in common
    most = np.maximum(shared, np.append(shared[1:], 0))
    by_place = np.lexsort((order, top))
    place, group = order[by_place], top[by_place]
    gap = np.where(group[1:] == group[:-1], place[1:] - place[:-1], n + 1)
    nearest = np.full(n, n + 1)
    nearest[by_place[1:]] = gap
    nearest[by_place[:-1]] = np.minimum(nearest[by_place[:-1]], gap)
    keep = np.flatnonzero((most >= SHARED) & (nearest <= most // (TIMES - 1)))
    if not len(keep):
        return keep, keep
    # what two that stay share is the least of what stood between them
    least = np.minimum.reduceat(shared[: keep[-1] + 1], keep[:-1] + 1) if len(keep) > 1 else keep[:0]
    return order[keep], np.append(0, least)


class _Node:
    """Positions below a node of the tree: all, sorted, and by the word on their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all, self.by_left = [place], {left: [place]}


def _partners(node: _Node, place: int, left: int, most: int) -> Iterator[int]:
    """Positions of a node that are at most `most` away and have another word on the left."""
    lo, hi = place - most, place + most
    if len(node.by_left) > 2 * most + 1:
        seen = node.all
        mine = node.by_left.get(left, [])
        for other in seen[bisect_left(seen, lo) : bisect_right(seen, hi)]:
            at = bisect_left(mine, other)
            if at == len(mine) or mine[at] != other:
                yield other
        return
    for word, places in node.by_left.items():
        if word != left:
            yield from places[bisect_left(places, lo) : bisect_right(places, hi)]


def _joined(a: _Node, b: _Node, depth: int, found: list[tuple[int, int, int]]) -> _Node:
    """Two children of a node of this depth: their maximal pairs go to `found`, the smaller one's positions to the larger."""
    if len(a.all) < len(b.all):
        a, b = b, a
    most = depth // (TIMES - 1)
    for left, places in b.by_left.items():
        for place in places:
            for other in _partners(a, place, left, most):
                found.append((min(place, other), abs(place - other), depth))
    for left, places in b.by_left.items():
        mine = a.by_left.setdefault(left, [])
        for place in places:
            insort(mine, place)
            insort(a.all, place)
    return a


def maximal_pairs(order: list[int], shared: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(first place, distance, words shared) of the maximal pairs of one group, its LCP intervals from the bottom up.

    shared[i]: what suffix i has in common with the one before; left: the word before each suffix.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, _Node]] = []  # open nodes; the number is what a node shares with the one below it in the stack
    for place, depth, word in zip(order, shared, left, strict=True):
        node = _Node(place, word)
        while len(stack) > 1 and stack[-1][0] > depth:
            d, top = stack.pop()
            below, under = stack.pop()
            stack.append((below, _joined(under, top, d, found)))
        stack.append((depth, node))
    while len(stack) > 1:
        d, top = stack.pop()
        below, under = stack.pop()
        stack.append((below, _joined(under, top, d, found)))
    return found


def runs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in all words), length and period of every run, by start and period.

    words: numbers of all texts' words; at: where each text's words begin, one more than there are texts.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order, shared = _near(*suffixes(words, of, at[of + 1]))
    if not len(order):
        return none, none, none
    first = at[of[order]] == order
    left = np.where(first, -1 - of[order], words[order - 1])
    begin = np.flatnonzero(shared < SHARED)
    # a group whose words on the left are all the same has no maximal pair
    mixed = np.maximum.reduceat(left, begin) != np.minimum.reduceat(left, begin)
    found: list[tuple[int, int, int]] = []
    for a, b in zip(begin[mixed].tolist(), np.append(begin[1:], len(order))[mixed].tolist(), strict=True):
        found += maximal_pairs(order[a:b].tolist(), shared[a:b].tolist(), left[a:b].tolist())
    if not found:
        return none, none, none
    start, period, depth = np.array(sorted(found), np.int64).T
    length = depth + period
    _, one = np.unique(np.stack([start, length]), axis=1, return_index=True)  # the shortest distance comes first
    one.sort()
    return start[one], length[one], period[one]


def damaged(ids: list, at: np.ndarray) -> np.ndarray:
    """The word that stands at each place after the contract's damage: for one in ten texts, a tail made periodic."""
    place = np.arange(at[-1])
    for k, doc_id in enumerate(ids):
        h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), int(at[k + 1] - at[k])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            tail = np.arange(n - a)
            place[at[k] + a : at[k + 1]] = at[k] + a + tail % p
    return place


def _report(batches: Iterator[pa.RecordBatch], damage: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, text_at in T.texts(batch.column(1), T.BLOCK):
            n = len(text_at) - 1
            ids = batch.column(0).slice(row, n)
            s, e = T.runs(data, text_at, T.IS_SPACE)
            at = np.searchsorted(s, text_at)
            words = T.numbers(data, s, e)
            place = damaged(ids.to_pylist(), at) if damage else np.arange(len(s))
            start, length, period = runs(words[place], at)
            cover = np.zeros(len(s) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            keep = np.cumsum(cover[:-1]) == 0
            raw, s, e = data.tobytes(), s[place], e[place]
            cut = np.searchsorted(start, at)
            out: list[list] = [[] for _ in range(8)]
            for k in range(n):
                i, j, first = int(cut[k]), int(cut[k + 1]), int(at[k])
                mine = list(zip((start[i:j] - first).tolist(), length[i:j].tolist(), period[i:j].tolist(), strict=True))
                best = min(mine, key=lambda r: (-r[1], r[0], r[2])) if mine else None
                stay = np.flatnonzero(keep[first : at[k + 1]]) + first
                text = b" ".join([raw[x:y] for x, y in zip(s[stay].tolist(), e[stay].tolist(), strict=True)])
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in mine).encode()
                values = (len(mine), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest(), int(at[k + 1]) - first - len(stay))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, t) for c, t in zip(out[:7], kinds, strict=True)), pa.array(np.diff(at)), pa.array(out[7], pa.int64())],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )


def periodic_runs(docs: DataFrame, damage: bool = False) -> DataFrame:
    """A row for each document: its longest run, hashes of all runs and of the text without the runs' repeats. One pass, no shuffle."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), lambda batches: _report(batches, damage), SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), damage=True)
