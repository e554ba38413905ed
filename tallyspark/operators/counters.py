"""Increments from cumulative counters: a fold along each session that keeps nothing but the last baseline.

Lines are sorted over range partitions, so a long session is cut and folded in parts at the same time. A part in the middle
of a session needs the state that the part before it ends in; all parts are folded from a fresh state first, then those whose
start turns out to be another are folded again until every start is the end before it. One more round is enough unless a
whole part is stale. What passes through the driver is one state for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.stages import checkpointed

PARTS = ("input", "cached", "output", "reasoning")
#: Baseline, whether only copied history came so far, and the second that it is from.
State = tuple[tuple[int, ...] | None, bool, str | None]
FRESH: State = (None, True, None)
OUT = "file_path string, line_no long, ts string, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, reasoning_output_tokens long"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]


def step(state: State, ts: str | None, replay: bool, last: tuple[int, ...] | None, total: tuple[int, ...] | None) -> tuple[tuple[int, ...] | None, State]:
    """The increment of one line, or None, and the state after it.

    The leading lines of a copied session that share its first second only set the baseline. Unchanged totals are skipped; a
    total a little below the baseline is stale and skipped without moving it; otherwise the reported increment counts, or the
    difference of totals, or after a reset nothing but a new baseline.
    """
    base, leading, second = state
    if replay and leading:
        now = (ts or "")[:19]
        second = now if second is None else second
        if now == second:
            return None, (base if total is None else total, True, second)
    state = (base, False, second)
    lower = base is not None and total is not None and any(t < b for t, b in zip(total, base, strict=True))
    if base is not None and total == base:
        return None, state
    if lower and last is not None:
        a, b, c = sum(total), sum(base), sum(last)
        if min(a, b, c) > 0 and (a * 100 >= b * 98 or a + 2 * c >= b):
            return None, state
    use = last
    if use is None and total is not None and not lower:
        use = total if base is None else tuple(t - b for t, b in zip(total, base, strict=True))
    return (use if use is not None and sum(use) > 0 else None), (base if total is None else total, False, second)


def row(line: tuple, use: tuple[int, ...]) -> tuple:
    """A line (file_path, line_no, ts, model) with its increment: cached input counts once."""
    read = min(use[1], use[0])
    return (*line, use[0] - read, use[2], 0, read, use[3])


def _lines(batch: pa.RecordBatch) -> Iterator[tuple]:
    """file_path, line_no, ts, model, replay, last, total."""
    *plain, last, total = (c.to_pylist() for c in batch.columns)
    four = lambda x: None if x is None else (x["input"], x["cached"], x["output"], x["reasoning"])
    for *line, a, b in zip(*plain, last, total, strict=True):
        yield (*line, four(a), four(b))


def _fold(starts: dict[int, State], emit: bool):
    """The increments of sorted partitions (column 0: their number), or where they begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now, state = None, None, None, FRESH
        for batch in batches:
            out = []
            if part is None and batch.num_rows:
                part, first = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
                now, state = first, starts.get(part, FRESH)
            for path, *line, replay, last, total in _lines(batch.select(list(range(1, batch.num_columns)))):
                if path != now:
                    now, state = path, FRESH
                use, state = step(state, line[1], replay, last, total)
                if use and emit:
                    out.append(row((path, *line), use))
            if emit:
                columns = list(zip(*out, strict=True)) or [[]] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in OUT.split(", ")])
        if not emit and part is not None:
            base, leading, second = state
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": now, "base": base and list(base), "leading": leading, "second": second}], pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("base", pa.list_(pa.int64())), ("leading", pa.bool_()), ("second", pa.string())]))

    return run


_ENDS = "part int, first string, last string, base array<long>, leading boolean, second string"


def counter_increments(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Increments from cumulative counters, in order for each session, in memory that doesn't grow with it.

    lines: file_path, line_no, ts (text), model, replay (the session copies its parent's history), last and total (structs of
    input, cached, output, reasoning; null if absent). Returns file_path, line_no, ts, model and the increment.
    """
    usage = lambda c: F.when(F.col(c).isNotNull(), F.struct(*(F.coalesce(F.col(f"{c}.{p}"), F.lit(0)).cast("long").alias(p) for p in PARTS))).alias(c)
    plain = lines.select(F.col("file_path").cast("string"), F.col("line_no").cast("long"), F.col("ts").cast("string"), F.col("model").cast("string"), F.coalesce("replay", F.lit(False)).alias("replay"), usage("last"), usage("total"))
    order = ["file_path", "line_no"]
    dealt = plain.repartitionByRange(partitions, *order) if partitions else plain.repartitionByRange(*order)
    dealt = checkpointed(dealt.sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "*"))
    starts: dict[int, State] = {}
    ends: dict[int, tuple] = {}
    todo = dealt
    while True:
        for r in todo.mapInArrow(_fold(starts, False), _ENDS).collect():  # a row for each partition
            ends[r.part] = (r.first, r.last, (tuple(r.base) if r.base is not None else None, r.leading, r.second))
        again, before = [], None
        for part in sorted(ends):
            first, last, _ = ends[part]
            start = ends[before][2] if before is not None and ends[before][1] == first else FRESH
            if start != starts.get(part, FRESH):
                starts[part] = start
                if first == last:  # only then its end can change
                    again.append(part)
            before = part
        if not again:
            break
        todo = dealt.where(F.col("part").isin(again))
    return dealt.mapInArrow(_fold(starts, True), OUT)
