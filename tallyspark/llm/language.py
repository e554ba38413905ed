"""Language identification by compression: the language whose zstandard dictionary shrinks a text most.

Each language's raw-content dictionary holds up to DICTIONARY bytes of sampled training text. A text is lower-cased, its
digits and ASCII signs become single spaces, and it is cut into chunks of CHUNK bytes so that the dictionary matters
everywhere; every chunk is compressed with every dictionary, and the sums decide. The margin is the share by which the second smallest sum exceeds the smallest; texts with a
margin below REJECT are rejected: `lang` is then `und`, while `best` still names the smallest.

The training sample is bounded: about SAMPLE documents of each language, chosen by a hash of the id, and of each at most
PIECE characters from a place that the hash chooses. Every language that is there is learned, however many there are: all
dictionaries together have MODEL_BYTES, so with very many languages each one's is smaller, and coders are made GROUP by GROUP.

Defined cases: null text and text without a letter is `und` with score 0; ties go to the language with more training
documents, then by name; rows without a language aren't learned from; with nothing to learn from all is `und`; rows that
repeat are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, remainder

SAMPLE = 400
PIECE = 600
DICTIONARY = 110 << 10
MODEL_BYTES = 64 << 20  # of all dictionaries, which go to every task: with more languages each one's is smaller, and none is left out
FEW = 100_000  # languages up to which their table is broadcast
GROUP = 64  # coders that a task holds at once
CHUNK, LEVEL = 768, 8
REJECT = 0.02
SHARPNESS = 0.45  # of the score, for each byte of difference

UNKNOWN = "und"
_PLACES = 1 << 20


_BLANK = {c: " " for c in range(128) if not chr(c).isalpha()}


def plain(text: str) -> bytes:
    """Lower-cased words, one space between them."""
    return " ".join(text.lower().translate(_BLANK).split()).encode()


def _hash(doc_id: str = "doc_id") -> Column:
    return F.xxhash64(F.col(doc_id), F.lit(17))


def fit(train: DataFrame, sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """Languages, most frequent first, with their dictionaries. train: doc_id, text, lang."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    found = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not found:
        return []
    room = max(64, min(DICTIONARY, MODEL_BYTES // len(found)))
    sample = min(sample, max(1, 4 * room // PIECE))
    counts = train.sparkSession.createDataFrame([(r["lang"], min(_PLACES, math.ceil(1.2 * sample / r["count"] * _PLACES))) for r in found], "lang string, share long")
    counts = F.broadcast(counts) if len(found) <= FEW else counts
    picked = train.join(counts, "lang").where(F.pmod(_hash(), F.lit(_PLACES)) < F.col("share"))
    size = min(PIECE, room)
    start = F.pmod(_hash(), F.greatest(F.lit(1), F.char_length("text") - size)) + 1
    piece = F.substring("text", start, F.lit(size))
    rows = picked.select("lang", _hash().alias("h"), piece.alias("piece")).orderBy("h", "piece").limit(2 * sample * len(found)).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r["lang"]].append(plain(r["piece"]))
    return [(r["lang"], b"\n".join(dict.fromkeys(texts[r["lang"]]))[-room:]) for r in found if texts[r["lang"]]]


class Judge:
    """Verdicts on texts. With more than GROUP languages their coders are made group by group, for each batch of texts anew."""

    def __init__(self, model: list[tuple[str, bytes]]) -> None:
        self.names = [name for name, _ in model]
        self.groups = [[d for _, d in model[i : i + GROUP]] for i in range(0, len(model), GROUP)]
        self.kept = [self._coder(d) for d in self.groups[0]] if len(self.groups) == 1 else None

    @staticmethod
    def _coder(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, str, float, float]]:
        """best, lang, score, margin of each text."""
        raws = [memoryview(plain(t)) if t and any(map(str.isalpha, t)) else None for t in texts]
        sizes: list[list[int]] = [[] for _ in texts]
        for group in self.groups:
            coders = self.kept or [self._coder(d) for d in group]
            for raw, mine in zip(raws, sizes, strict=True):
                if raw is not None:
                    mine += [sum(len(c.compress(raw[i : i + CHUNK])) for i in range(0, len(raw), CHUNK)) for c in coders]
        return [self._verdict(s) for s in sizes]

    def _verdict(self, sizes: list[int]) -> tuple[str, str, float, float]:
        if not sizes:
            return UNKNOWN, UNKNOWN, 0.0, 0.0
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        least = sizes[order[0]]
        score = 1 / sum(math.exp(max(-700.0, (least - s) * SHARPNESS)) for s in sizes)
        margin = (sizes[order[1]] - least) / least if len(order) > 1 else 1.0
        best = self.names[order[0]]
        return best, best if margin >= REJECT else UNKNOWN, score, margin


def identify(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """A row for each document: doc_id, best, lang, score, margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            best, lang, score, margin = zip(*judge(batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "best", "lang", "score", "margin"]
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, best string, lang string, score double, margin double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    out = identify(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("best").alias("lang_pred"), "score", F.col("lang").alias("lang_or_und"), "margin")
