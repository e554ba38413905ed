"""Byte-level BPE: encoding and decoding of whole texts with a rank file.

Pre-tokenisation uses no regular expression. Each code point has a class (letter, number, white space, other); with one
or two characters of look-ahead the classes become the symbols of an eight-state automaton that says where a match of
the pattern begins. Every symbol is a function on the states; the functions that compositions can make are few, so a
composition is one lookup in a table, and the states before all characters come from an associative scan over blocks.
The slices between boundaries go through a cache to pair merging. A slice's first byte is kept with its ids, so that a
token can be traced to its place; decoding holds the slices' places against the tokens' borders.

Defined cases: null and empty texts have no ids and decode to nothing; texts are never cut; repeated rows are encoded
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import map_batches, read

LETTER, NUMBER, SPACE, OTHER = range(4)
#: What may follow an apostrophe that begins a match.
ONE, TWO = "stmd", ("re", "ve", "ll")

# Symbols: the four classes (a space run's inner characters for SPACE), an apostrophe with one or two letters to come,
# a run's last white space before something else: a plain space, or another.
APO1, APO2, LAST_SPACE, LAST_WHITE = range(4, 8)
SYMBOLS = 8  # and as many again for the first character of a text
# States: nothing pending, in letters, in numbers, in others, after a plain space, in white space, one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, PREFIX, IN_SPACE, LEFT1, LEFT2 = range(8)

CACHE_ITEMS = 300_000  # pieces in a worker's cache
CACHE_PIECE = 64  # characters of a piece that is kept


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a match begins at this character."""
    if state == LEFT2:
        return LEFT1, False
    if state == LEFT1:
        return FRESH, False
    if symbol == LAST_SPACE:
        return PREFIX, True
    if symbol == LAST_WHITE:
        return FRESH, True
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    if symbol in (APO1, APO2) and state not in (IN_OTHER, PREFIX):
        return (LEFT1 if symbol == APO1 else LEFT2), True
    into = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHER)
    return into, state not in (into, PREFIX)


class Automaton:
    """Tables of the functions that symbols and their compositions make of the states."""

    def __init__(self) -> None:
        of_symbol = [tuple(_step(q, s)[0] for q in range(8)) for s in range(SYMBOLS)]
        of_symbol += [(f[FRESH],) * 8 for f in of_symbol]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *of_symbol]))}
        todo = list(known)
        gens = list(dict.fromkeys(of_symbol))
        while todo:
            f = todo.pop()
            for g in gens:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        self.size = len(known)
        functions = list(known)
        self.compose = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16).ravel()
        self.symbol = np.array([known[f] for f in of_symbol], np.uint16)
        self.from_fresh = np.array([f[FRESH] for f in functions], np.uint8)
        self.begins = np.array([[_step(q, s)[1] for s in range(SYMBOLS)] + [True] * SYMBOLS for q in range(8)], bool).ravel()

    def prefixes(self, f: np.ndarray, block: int = 64) -> np.ndarray:
        """Inclusive prefix compositions of a sequence of functions, by an associative scan."""
        n = len(f)
        if n <= block:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.compose[int(out[i - 1]) * self.size + int(f[i])]
            return out
        rows = -(-n // block)
        grid = np.zeros(rows * block, np.uint16)  # function 0 is the identity
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, block).T)
        for j in range(1, block):
            grid[j] = self.compose[grid[j - 1].astype(np.int32) * self.size + grid[j]]
        carry = np.zeros(rows, np.uint16)
        carry[1:] = self.prefixes(grid[-1], block)[:-1]
        grid = self.compose[carry.astype(np.int32)[None, :] * self.size + grid]
        return grid.T.ravel()[:n]

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where matches begin; the symbols of a text's first character are SYMBOLS higher."""
        if not len(symbols):
            return np.zeros(0, np.int64)
        before = np.zeros(len(symbols), np.uint8)
        before[1:] = self.from_fresh[self.prefixes(self.symbol[symbols])[:-1]]
        return np.flatnonzero(self.begins[before.astype(np.int32) * (2 * SYMBOLS) + symbols])


def class_table() -> np.ndarray:
    """The class of every code point, by the tables of the tiktoken library itself: other Unicode versions class some otherwise.

    All characters go once through an encoding whose pattern is one class and whose tokens are the 256 bytes; what isn't of the
    class is left out.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        coder = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        members = bytes(coder.encode_ordinary(every)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    return table


def symbols_of(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The automaton's symbols. first: the index of each text's first character; the texts aren't empty."""
    n = len(points)
    kind = classes[points]
    out = kind.copy()
    last = np.zeros(n + 2, bool)
    last[first[1:] - 1] = True
    last[n - 1 :] = True
    after = np.append(kind, [SPACE, SPACE])[1 : n + 1]
    end_of_run = (kind == SPACE) & ~last[:n] & (after != SPACE)
    out[end_of_run] = np.where(points[end_of_run] == 32, LAST_SPACE, LAST_WHITE)
    apo = np.flatnonzero(points == 39)
    if len(apo):
        padded = np.append(points, [0, 0])
        a = np.where(last[apo], 0, padded[apo + 1])
        b = np.where(last[apo] | last[apo + 1], 0, padded[np.minimum(apo + 2, n + 1)])
        out[apo[np.isin(a, [ord(c) for c in ONE])]] = APO1
        for x, y in TWO:
            out[apo[(a == ord(x)) & (b == ord(y))]] = APO2
    out[first] += SYMBOLS
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes slices of texts; one for each Python worker and rank file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.automaton, self.classes = Automaton(), class_table()
        self.cache: dict[str, bytes] = {}

    def _merged(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of new pieces; the cache takes them, and starts anew when full."""
        new = {}
        for p in pieces:
            raw = p.encode()
            one = self.ranks.get(raw)
            new[p] = np.array([one] if one is not None else self.merge(raw), "<u4").tobytes()
        kept = {p: ids for p, ids in new.items() if len(p) <= CACHE_PIECE}
        if len(self.cache) + len(kept) > CACHE_ITEMS:
            self.cache.clear()
        if len(kept) <= CACHE_ITEMS:
            self.cache.update(kept)
        return new

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """For each text of a slice its ids, and the first byte of each pre-token; both little-endian unsigned 32 bits."""
        n = len(at) - 1
        ids, offsets = [b""] * n, [b""] * n
        full = np.flatnonzero(at[1:] > at[:-1])
        if not len(full):
            return ids, offsets
        text = data.tobytes().decode()
        lead = (data & 0xC0) != 0x80
        byte_of = np.flatnonzero(lead)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.searchsorted(byte_of, at[full])
        starts = self.automaton.starts(symbols_of(points, first, self.classes))
        marks = starts.tolist()
        marks.append(len(text))
        pieces = [text[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
        found = list(map(self.cache.get, pieces))
        if None in found:
            new = self._merged({p for p, f in zip(pieces, found, strict=True) if f is None})
            found = [new[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
        begin = np.searchsorted(starts, np.append(first, len(text))).tolist()
        place = byte_of[starts]
        for k, i in enumerate(full.tolist()):
            a, b = begin[k], begin[k + 1]
            ids[i] = b"".join(found[a:b])
            offsets[i] = (place[a:b] - at[i]).astype("<u4").tobytes()
        return ids, offsets


class Decoder:
    _made: dict[str, Decoder] = {}

    @classmethod
    def of(cls, path: str) -> Decoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        size = max(ranks.values()) + 1
        words = [b""] * size
        for word, i in ranks.items():
            words[i] = word
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def decode(self, ids: bytes, offsets: bytes | None = None, step: int = 1 << 18) -> bytes:
        """The bytes of the ids. With the offsets kept by encoding, every slice has to begin where a token begins."""
        ids = np.frombuffer(ids, "<u4")
        out = []
        if offsets is not None:
            begin = np.cumsum(self.lengths[ids]) - self.lengths[ids]
            at = np.frombuffer(offsets, "<u4")
            place = np.searchsorted(begin, at)
            if len(at) and (place[-1] == len(begin) or (begin[place] != at).any()):
                raise ValueError("ids and offsets don't belong together")
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            size = self.lengths[part]
            ends = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.at[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """A row for each document: doc_id, ids and offsets (first byte of each pre-token), as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks)
        for batch in batches:
            for first, data, at in T.texts(batch.column(1), T.BLOCK):
                ids, offsets = encoder.encode(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], ["doc_id", "ids", "offsets"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids binary, offsets binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids, offsets and the decoded bytes; offsets may be null, else they are held against the tokens' borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.of(ranks)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [decoder.decode(x.as_buffer().to_pybytes(), o.as_buffer().to_pybytes() if o.is_valid else None) for x, o in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "offsets", "decoded"])

    return map_batches(encoded.select("doc_id", "ids", "offsets"), run, "doc_id long, ids binary, offsets binary, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(read(spark, sf_dir, "documents"), ranks), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
