"""Repair of conversations at least cost, by auctions on a lattice.

A conversation's rows, in the order of their turns, are to become turns whose role initials read `(s?(ua)+)?`. A row is kept
(0), gets another role (2) or is deleted (3; blank and repeated rows have to be); a turn without text may be inserted
anywhere (2); a truncated row that isn't deleted adds 1. Nodes of the lattice are (rows done, state of the pattern), edits
are its arcs. The cheapest edits are found by the auction algorithm for shortest paths: a path grows from its origin along
the arc that is best by cost and price, and gives up its last node, raising that node's price, where no arc keeps up with
it. Costs are integers and every cycle costs something, so prices settle; then the arcs of all cheapest paths, and only
those among arcs that lead to the end by such arcs, are tight (price = cost + price behind), and of these the path whose
edits' initials are least in ASCII order is traced.

Conversations of any length are cut into chunks of CHUNK rows, by sorted range partitions, so none is gathered: auctions give
each chunk's costs between the pattern's states, sweeps over chunks (those of one partition, then partitions) carry the costs
behind and the states before each chunk, and each chunk is traced with them. A text is moved once to its first row and once
to its conversation's digest; digests run over a conversation's lines as a stream, in one task since SHA-256 is sequential.

Defined cases: a null role or text is one space, also in the string behind the damage; a null turn comes first and doesn't
count for gaps; a null conv_id is a conversation of its own; rows of one turn are ordered by role, then by the digest of
their text, so repeated rows are adjacent; a role with any other initial can't be kept; a conversation without rows has zeros,
an empty audit and the digest of the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, join_groups, map_batches, read

CHUNK = 64
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

# States of the pattern: nothing yet, after the system turn, after a user's turn, after an assistant's turn.
STATES = range(4)
NEXT = (2, 2, 3, 2)  # the state after the user's or assistant's turn that is due
DUE = ("u", "u", "a", "u")
#: What it still costs to end in each state, and the turns to insert for it.
END, ENDING = (0, 2 * INSERT, INSERT, 0), ("", "ua", "a", "")
FAR = 1 << 40

KEY = ["none", "conv"]
AT = [*KEY, "part", "seq"]


def _after(state: int, code: str) -> int | None:
    """The state after a row that is kept, if it may be."""
    initial = code.lower()
    if state == 0 and initial == "s":
        return 1
    return NEXT[state] if initial == DUE[state] else None


@lru_cache(1 << 14)
def lattice(codes: str) -> list[list[tuple[str, int, int]]]:
    """Arcs (initial of the edit, node, cost) of each node 4 * rows + state, in the order of initials.

    codes: a letter for each row: its role's initial (o: any other), a capital if it is truncated, x if it has to go.
    """
    arcs: list[list[tuple[str, int, int]]] = []
    for i, code in enumerate(codes):
        for s in STATES:
            out = [("D", 4 * i + 4 + s, DELETE), ("I", 4 * i + NEXT[s], INSERT)]
            if code != "x":
                more = CUT_OFF * code.isupper()
                if (t := _after(s, code)) is not None:
                    out.append(("K", 4 * i + 4 + t, KEEP + more))
                out.append(("R", 4 * i + 4 + NEXT[s], REROLE + more))
            arcs.append(out)
    return arcs + [[] for _ in STATES]


def auction(arcs: list[list[tuple[str, int, int]]], prices: list[int], origin: int) -> int:
    """The cost of the cheapest path from the origin to the last node; prices are raised until they prove it.

    Prices come in with price <= cost + price behind on every arc, and leave so. The last node can be reached from every node.
    """
    goal, path = len(arcs) - 1, [origin]
    while path[-1] != goal:
        i = path[-1]
        best, to = min((cost + prices[j], j) for _, j, cost in arcs[i])
        if prices[i] < best:
            prices[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[origin] - prices[goal]


def _with_goal(codes: str, behind: tuple[int, ...]) -> list[list[tuple[str, int, int]]]:
    """The lattice with one more node, which the states of its end reach at the costs `behind`, and without nodes that don't lead there."""
    arcs = [list(x) for x in lattice(codes)]
    last = len(arcs) - 4
    for s in STATES:
        arcs[last + s] = [("", len(arcs), behind[s])] if behind[s] < FAR else []
    leads = [False] * len(arcs) + [True]
    for row in range(last, -1, -4):
        for _ in range(3):  # insertions lead from state to state of the same row
            for s in STATES:
                leads[row + s] = leads[row + s] or any(leads[j] for _, j, _ in arcs[row + s])
    return [[a for a in out if leads[a[1]]] for out in arcs] + [[]]


@lru_cache(1 << 14)
def between(codes: str) -> tuple[int, ...]:
    """The least cost of a chunk from each state (rows of the matrix) to each state, FAR where there is no way."""
    out = [[FAR] * 4 for _ in STATES]
    for t in STATES:
        arcs = _with_goal(codes, tuple(0 if s == t else FAR for s in STATES))
        prices = [0] * len(arcs)
        for s in STATES:
            if arcs[s]:
                out[s][t] = auction(arcs, prices, s)
    return tuple(x for row in out for x in row)


@lru_cache(1 << 15)
def traced(codes: str, state: int, behind: tuple[int, ...]) -> tuple[str, int, int]:
    """The edits' initials of a chunk, least in ASCII order among the cheapest, what they cost, and the state they lead to.

    state: in which the chunk begins; behind: what all that comes after it costs from each state.
    """
    arcs = _with_goal(codes, behind)
    goal, prices = len(arcs) - 1, [0] * len(arcs)
    auction(arcs, prices, state)
    tight = [[a for a in out if prices[i] == a[2] + prices[a[1]]] for i, out in enumerate(arcs)]
    leads = [False] * goal + [True]
    for row in range(goal - 4, -1, -4):
        for _ in range(3):
            for s in STATES:
                leads[row + s] = leads[row + s] or any(leads[j] for _, j, _ in tight[row + s])
    node, audit, cost = state, [], 0
    while True:
        initial, to, more = next(a for a in tight[node] if leads[a[1]])
        if to == goal:
            return "".join(audit), cost, node % 4
        audit.append(initial)
        node, cost = to, cost + more


def turns(codes: str, audit: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit's initial, row or None, new role or None) of the turns that the edits leave."""
    row = 0
    for edit in audit:
        if edit == "K":
            yield edit, row, None
            state = _after(state, codes[row])
        elif edit in "RI":
            yield edit, row if edit == "R" else None, ROLES[DUE[state]]
            state = NEXT[state]
        row += edit != "I"


def conversation_rows(rows: DataFrame, damage: bool = False) -> DataFrame:
    """none (is conv_id null), conv, turn, role, text, times (the row occurs; 0: it is dropped), sha, blank, cut (off)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20 if damage else F.lit(-1)
    conv = F.col("conv_id").cast("long")
    out = rows.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long")
    out = out.select(*KEY, "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    end = F.rtrim("text", F.lit(SPACE))
    return out.withColumns({"sha": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "blank": end == "", "cut": ~F.substring(end, -1, 1).isin(".", "!", "?")})


def faulted(rows: DataFrame) -> DataFrame:
    """A row for each turn, role and text of a conversation, without the text: how often it occurs, and whether it is the first of its role and text."""
    narrow = durable(rows.groupBy(*KEY, "turn", "role", "sha", "blank", "cut").agg(F.sum("times").alias("times")))
    same = [*KEY, "role", "sha"]
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    several = narrow.where("times > 0").groupBy(*same).agg(F.min(order).alias("least"), F.count("*").alias("many")).where("many > 1")
    out = join_groups(narrow, durable(several), same, "many", "left")
    return out.select(*KEY, "turn", "role", "sha", "times", "blank", "cut", (F.col("least").isNull() | (F.col("least") == order)).alias("first"))


CHUNKS = "none boolean, conv long, part int, seq long, codes string, roles array<string>, shas array<binary>, illegal long, begins string, ends string"
_CHUNK_KINDS = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.int64(), pa.string(), pa.string()]
LEGAL = ("su", "ua", "au")


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])


def _cut_up(size: int):
    """Sorted rows of a partition as chunks of up to `size` rows; conversations don't share a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, open_, out = None, 0, None, []

        def done() -> None:
            codes, roles, shas, illegal, begins, ends = open_
            out.append((*now, seq, "".join(codes), roles, shas, illegal, begins, ends))

        for batch in batches:
            for none, conv, part, role, sha, times, blank, cut, first in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if (none, conv, part) != now:
                    if open_:
                        done()
                    now, seq, open_, last = (none, conv, part), 0, None, None
                initial = role[:1]
                stays = first and not blank
                while times:
                    if open_ and len(open_[0]) >= size:
                        done()
                        seq, open_ = seq + 1, None
                    if not open_:
                        open_ = [[], [], [], 0, initial, initial]
                    many = min(times, size - len(open_[0]))
                    open_[3] += many - 1 + (last is not None and last + initial not in LEGAL)
                    if stays:
                        code = initial if initial in ("s", "u", "a") else "o"
                        open_[0].append(code.upper() if cut else code)
                        open_[1].append(role)
                        open_[2].append(sha)
                        open_[0] += "x" * (many - 1)
                    else:
                        open_[0] += "x" * many
                    stays, last, open_[5], times = False, initial, initial, times - many
            if len(out) > 1000:
                yield _batch(out, _CHUNK_KINDS, CHUNKS)
                out.clear()
        if open_:
            done()
        yield _batch(out, _CHUNK_KINDS, CHUNKS)

    return run


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of faulted(), sorted over partitions by ranges, as chunks in the order of part and seq."""
    order = [*KEY, F.col("turn").asc_nulls_first(), "role", "sha"]
    dealt = rows.where("times > 0").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select(*KEY, F.spark_partition_id().alias("part"), "role", "sha", "times", "blank", "cut", "first")
    return map_batches(dealt, _cut_up(size), CHUNKS)


def _times(a: list[int], b: list[int]) -> list[int]:
    """Product of two four by four matrices of costs: the least sum takes the place of the sum of products."""
    return [min(min(a[4 * i + k] + b[4 * k + j] for k in STATES), FAR) for i in STATES for j in STATES]


def _along(row: list[int], m: list[int], forward: bool) -> list[int]:
    if forward:
        return [min(min(row[k] + m[4 * k + j] for k in STATES), FAR) for j in STATES]
    return [min(min(m[4 * i + k] + row[k] for k in STATES), FAR) for i in STATES]


def carried(costs: DataFrame, start: tuple[int, ...], forward: bool) -> DataFrame:
    """Costs carried along a conversation's chunks: AT and v, the costs by state before each chunk (or behind it, going back).

    costs: AT and m, the matrix of each chunk. Chunks of one partition are multiplied first, so no group is larger than a
    partition's chunks or than there are partitions.
    """

    def product(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        m = list(group["m"].iloc[0])
        for x in group["m"].iloc[1:]:
            m = _times(m, list(x))
        return group.iloc[:1][[*KEY, "part"]].assign(m=[m])

    def sweep(by: str, first: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(by, ascending=forward)
            v, out = list(group[first].iloc[0]), []
            for m in group["m"]:
                out.append(v)
                v = _along(v, list(m), forward)
            return group[[*KEY, "part"] + ["seq"] * (by == "seq")].assign(v=out)

        return run

    costs = durable(costs)
    parts = costs.groupBy(*KEY, "part").applyInPandas(product, "none boolean, conv long, part int, m array<long>")
    parts = parts.withColumn("begin", F.array(*(F.lit(x).cast("long") for x in start)))
    parts = parts.groupBy(*KEY).applyInPandas(sweep("part", "begin"), "none boolean, conv long, part int, v array<long>")
    inner = costs.join(parts.withColumnRenamed("v", "begin"), [*KEY, "part"])
    return durable(inner.groupBy(*KEY, "part").applyInPandas(sweep("seq", "begin"), "none boolean, conv long, part int, seq long, v array<long>"))


_MATRIX = "none boolean, conv long, part int, seq long, m array<long>"
_MATRIX_KINDS = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield _batch([(*at, between(codes)) for *at, codes in rows], _MATRIX_KINDS, _MATRIX)


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To which state each state leads: 0 there, FAR elsewhere."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        out = []
        for *at, codes, v in rows:
            ends = [traced(codes, s, tuple(v))[2] for s in STATES]
            out.append((*at, [0 if ends[s] == t else FAR for s in STATES for t in STATES]))
        yield _batch(out, _MATRIX_KINDS, _MATRIX)


_LINE = pa.struct([("idx", pa.int64()), ("edit", pa.string()), ("own", pa.string()), ("sha", pa.binary()), ("role", pa.string())])
EDITS = "none boolean, conv long, part int, seq long, cost long, audit string, lines array<struct<idx:long,edit:string,own:string,sha:binary,role:string>>"
_EDIT_KINDS = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(_LINE)]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for *at, codes, roles, shas, v, state, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            audit, cost, end = traced(codes, state, tuple(v))
            number = [i for i, c in enumerate(codes) if c != "x"]
            place = {row: k for k, row in enumerate(number)}
            lines = []
            for i, (edit, row, role) in enumerate(turns(codes, audit, state)):
                own, sha = (None, None) if row is None else (roles[place[row]], shas[place[row]])
                lines.append({"idx": i, "edit": edit, "own": own, "sha": sha, "role": own if edit == "K" else role})
            if last:
                for initial in ENDING[end]:
                    lines.append({"idx": len(lines), "edit": "I", "own": None, "sha": None, "role": ROLES[initial]})
                audit, cost = audit + "I" * len(ENDING[end]), cost + INSERT * len(ENDING[end])
            out.append((*at, cost, audit, lines))
        yield _batch(out, _EDIT_KINDS, EDITS)


def edits(cut: DataFrame) -> DataFrame:
    """Cost, audit and turns of each chunk (EDITS). cut: chunks(), checkpointed."""
    counts = durable(cut.groupBy(*KEY).agg(F.count("*").alias("many"), F.max(F.struct("part", "seq")).alias("final")))
    cut = join_groups(cut, counts, KEY, "many").withColumn("last", F.struct("part", "seq") == F.col("final"))
    wanted = [*AT, "codes", "roles", "shas"]
    ready = cut.where("many = 1").select(*wanted, F.array(*(F.lit(x).cast("long") for x in END)).alias("v"), F.lit(0).alias("state"), "last")
    long = cut.where("many > 1")
    if not counts.where("many > 1").isEmpty():
        behind = carried(map_batches(long.select(*AT, "codes"), _costs, _MATRIX), END, False)
        long = durable(long.join(behind, AT))
        before = carried(map_batches(long.select(*AT, "codes", "v"), _ways, _MATRIX), (0, FAR, FAR, FAR), True)
        before = before.select(*AT, (F.array_position("v", 0) - 1).cast("int").alias("state"))
        ready = ready.unionByName(long.join(before, AT).select(*wanted, "v", "state", "last"))
    return map_batches(ready, _edited, EDITS)


def _lines(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: AT, idx, edit, role, text."""
    line = edited.select(*AT, F.explode("lines").alias("x")).select(*AT, "x.*")
    texts = rows.where("times > 0 and not blank").groupBy(*KEY, F.col("role").alias("own"), "sha").agg(F.min("text").alias("text"))
    own = line.where("sha is not null").join(texts, [*KEY, "own", "sha"]).select(*AT, "idx", "edit", "role", "text")
    return own.unionByName(line.where("sha is null").select(*AT, "idx", "edit", "role", F.lit("").alias("text")))


def repaired(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """The repaired conversations themselves: conv_id, part, seq, idx (their order), edit (K, R or I), role and text of every turn."""
    rows = conversation_rows(conversations, damage)
    out = _lines(rows, durable(edits(durable(chunks(faulted(rows))))))
    return out.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "part", "seq", "idx", "edit", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the sorted lines of each conversation, as they stream by."""
    now, sha, out = None, None, []
    for batch in batches:
        for none, conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (none, conv) != now:
                if sha:
                    out.append((*now, sha.hexdigest()))
                now, sha = (none, conv), hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line.as_buffer())
    if sha:
        out.append((*now, sha.hexdigest()))
    yield _batch(out, [pa.bool_(), pa.int64(), pa.string()], "none boolean, conv long, digest string")


def repair(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """A row for each conversation: conv_id, gaps, faults, illegal neighbours, the cheapest repair's cost and edits, and the repaired text's digest."""
    rows = conversation_rows(conversations, damage)
    found = durable(faulted(rows))
    there, turn = F.col("times") > 0, F.when(F.col("times") > 0, F.col("turn"))
    stay = there & ~F.col("blank") & F.col("first")
    stats = found.groupBy(*KEY).agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("times")) - F.when(stay, 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(stay & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    cut = durable(chunks(found))
    parts = cut.groupBy(*KEY, "part").agg(F.sum("illegal").alias("illegal"), F.min_by("begins", "seq").alias("begins"), F.max_by("ends", "seq").alias("ends"))
    seam = F.concat(F.lag("ends").over(Window.partitionBy(*KEY).orderBy("part")), "begins")  # a row for each partition that the conversation is in
    bad = parts.withColumn("seam", seam).groupBy(*KEY).agg(F.sum(F.col("illegal") + F.when(~F.col("seam").isin(*LEGAL), 1).otherwise(0)).alias("illegal"))
    edited = durable(edits(cut))
    pieces = F.sort_array(F.collect_list(F.struct("part", "seq", "audit")))
    audits = edited.groupBy(*KEY).agg(F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
    lines = _lines(rows, edited).select(*AT, "idx", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    lines = lines.repartition(*KEY).sortWithinPartitions(*AT, "idx").select(*KEY, "line")
    digests = map_batches(lines, _digests, "none boolean, conv long, digest string")
    out = stats.join(bad, KEY, "left").join(audits, KEY, "left").join(digests, KEY, "left")
    return out.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"), damage=True)
