"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles of `size` words. Two sets with a Jaccard similarity of p per cent or more differ in
at most (|A| + |B|)(100 - p) / (100 + p) members. Sets are sketched in bands of sizes: band (low, high) has `slices` slices,
and each member flips one bit in the slice that its hash names. A bit differs only where a member does, so the Hamming
distance of two sketches is never more than the symmetric difference, and of k slices at least k - d agree when d members
differ. That gives an exact join, nothing is missed:

* pigeonhole: every set puts out the hash of its slices (the XOR of its bits' hashes), and sets that could be similar share
  one. A set that can differ in d members from any partner puts out its d + 1 fullest slices only: slices are ranked by what
  is in them, so those that agree rank alike in both sets, and the first of k - d equal ones stands among the d + 1.
  That leaves out nearly all slices with no or few members, which would meet by chance.
* bound: candidates' sketches, folded to a few bits per member, must not differ in more bits than members may.
* verify: what is left is confirmed on the full sets.

Bands overlap so that both sets of any similar pair are in one of them; a set is in one or two. Equal sets are one node.
In STARS rounds every node meets one node of each slice it shares; then, in slices that still hold different components, nodes
of different ones meet in pairs of blocks, with their sketches alone; blocks are bounded by rows and bytes. That is done twice:
first each node puts out the nearest one that its sketch allows, a pair a row at most, then, in slices that hold different
components even so, all that are allowed. A pair that meets in several slices is put out in one: each node knows the
first FIRSTS slices it meets others in, and a later slice leaves out pairs that share one of them. Full sets follow for pairs
put out, as a stream, one pair in memory at a time. A block where very many are allowed doesn't put out pairs: its nodes get
their sets, and only links come out. Nothing is capped.

Defined cases: a null text has no words; a text without words has an empty set and is linked with nothing, its component is
its own id; with fewer than `size` words the whole sequence is one shingle; rows that repeat share a set; null ids are
larger than any id; an empty table gives no rows; other columns are ignored. Sets are of 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import drop_written, durable, join_groups, map_batches, read, written
from .components import components
from .near_dedup import _common, full_sets, set_keys, shingles

WIDTH = 1 << 16  # bits of a slice
ROWS = 512  # nodes of a block, about
BYTES = 8 << 20  # of a block's sets, about
DENSE = 16  # pairs for each row of a block up to which they are put out
STARS = 1  # rounds in which nodes meet one node of each slice
FIRSTS = 16  # slices of a node by which a pair is known to have met before
LEAST_BITS = 512  # of a folded sketch
SPARE = 16  # one slice in so many more than the pigeonhole needs, so that weak ones can be left out


def _differ(a: int, b: int, percent: int) -> int:
    """Members at most in which similar sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands(most: int, percent: int) -> list[tuple[int, int, int]]:
    """(low, high, slices) of the bands up to sets of `most` members. Any two sizes that can be similar share a band."""
    out, low = [], 1
    while low <= most:
        high = 2 * low
        need = _differ(high, high, percent) + 1
        out.append((low, high, need + 1 + need // SPARE))
        while low * 100 // percent <= high:
            low += 1
    return out


def _reach(size: int, high: int, percent: int) -> int:
    """Members at most in which a set of this size differs from a similar one of its band, none larger than `high`."""
    return _differ(size, min(high, size * 100 // percent), percent)


def fold_bits(size: int, percent: int) -> int:
    """Bits of the folded sketch: a power of two, eight for each member that may differ, so that few fall together."""
    return 1 << max(LEAST_BITS.bit_length() - 1, (8 * _differ(size, size, percent)).bit_length())


def slice_keys(members: np.ndarray, of: np.ndarray, many: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the slices that each set puts out, and whose they are. members: hashes; of: each one's set; many: sizes."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b, (low, high, slices) in enumerate(bands(int(many.max(initial=0)), percent)):
        reach = np.array([_reach(n, high, percent) if low <= n <= high else 0 for n in many.tolist()])
        sets = np.flatnonzero(reach)  # where no member may differ, equal sets are one node already
        if not len(sets):
            continue
        at = np.full(len(many), -1)
        at[sets] = np.arange(len(sets))
        mine = np.flatnonzero(at[of] >= 0)
        bit = T.mix(members[mine] ^ T.mix(np.uint64([b + 1]))) % np.uint64(slices * WIDTH)
        place = at[of[mine]] * slices + (bit // np.uint64(WIDTH)).astype(np.int64)
        order = np.argsort(place)
        place, bit = place[order], T.mix(bit[order] + np.uint64(1))
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        content = np.zeros(len(sets) * slices, np.uint64)
        content[place[first]] = np.bitwise_xor.reduceat(bit, first)  # bits that two members flip fall out
        held = np.bincount(place, minlength=len(content))
        which = np.arange(len(content))
        number = np.lexsort((which % slices, content, -held, which // slices))  # the fullest slices of each set first
        rank = which % slices
        out = number[rank <= np.repeat(reach[sets], slices)]
        salt = (np.uint64(b) << np.uint64(40)) + (out % slices).astype(np.uint64)
        keys.append(T.mix(content[out] ^ T.mix(salt + np.uint64(1))))
        owners.append(sets[out // slices])
    return np.concatenate(keys), np.concatenate(owners)


def folded(members: np.ndarray, bits: int) -> bytes:
    """The parity sketch of a set in so many bits."""
    odd = np.bincount((T.mix(members + np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def distance(one: bytes, two: bytes) -> int:
    """Bits that differ between two sketches. The longer one is folded: bits a power of two apart are added modulo two."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    least = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, least), 0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def short(sketches: list[bytes]) -> np.ndarray:
    """The sketches folded to LEAST_BITS, a row each."""
    out = np.empty((len(sketches), LEAST_BITS // 64), np.uint64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, LEAST_BITS // 64), 0)
    return out


def _batches_of_sets(docs: DataFrame, size: int, percent: int, kind: str) -> DataFrame:
    """One row for each text: its set's key and size (kind "key"), or key, sketch and slices of texts with a set (kind "slices")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, at in T.texts(batch.column(1), T.BLOCK):
                n = len(at) - 1
                members, of = shingles(data, at, size)
                many = T.counts(of, n)
                begin = np.append(0, np.cumsum(many))
                full = np.flatnonzero(many)
                keys = set_keys(members, begin[full], many[full]) if len(full) else []
                if kind == "key":
                    key: list = [None] * n
                    for i, k in zip(full.tolist(), keys, strict=True):
                        key[i] = k
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(many), pa.array(key, pa.binary())], ["doc_id", "n", "key"])
                    continue
                slices, whose = slice_keys(members, of, many, percent)
                each = np.append(0, np.cumsum(T.counts(whose, n)[full]))
                lists = pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.array(slices[np.argsort(whose, kind="stable")].view(np.int64)))
                sketch = [folded(members[begin[i] : begin[i + 1]], fold_bits(int(many[i]), percent)) for i in full.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sketch, pa.binary()), lists], ["key", "sketch", "slices"])

    schema = "doc_id long, n long, key binary" if kind == "key" else "key binary, sketch binary, slices array<long>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, work: int) -> Iterator[tuple[list, ...]]:
    """Columns of whole blocks (column 0, in order), several small ones at once: up to about so many rows, or comparisons."""
    held: list[list] = []
    begin = longest = 0  # begin: of the last block in held
    for batch in batches:
        held = held or [[] for _ in batch.columns]
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held[0] and values[0] != held[0][-1]:
                longest, begin = max(longest, len(held[0]) - begin), len(held[0])
                if begin >= rows or longest * begin > work:
                    yield tuple(held)
                    held, begin, longest = [[] for _ in values], 0, 0
            for column, value in zip(held, values, strict=True):
                column.append(value)
    if held and held[0]:
        yield tuple(held)


def met_before(slices: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the first slices of both nodes of each pair, a row each, have one in common that is less than the pair's slice."""
    return ((one[:, :, None] == two[:, None, :]) & (one < slices[:, None])[:, :, None]).any((1, 2))


def _met(percent: int, nearest: bool):
    """What a block's sizes and sketches allow among nodes of different components. Rows are (block, node, side, root, n, sketch, slice, firsts).

    In a block of side 0 all nodes meet, else those of side 1 those of side 2. A block with few such pairs puts out the pairs
    (u, v), one where most nodes are alike puts out its nodes that have any (block, u), and never the pairs. With `nearest`
    each node puts out one pair at most. Small blocks are compared many at once: each row with the one a step behind it, for every step.
    """

    def compared(block, node, side, root, n, sketch, slices, firsts) -> pa.RecordBatch:
        number = np.unique(np.array(block), return_inverse=True)[1]
        name, node, side, root, n = block, np.array(node), np.array(side), np.array(root), np.array(n)
        bits, of = short(sketch), np.bincount(number)
        longest, dense = int(of.max()), np.zeros(len(of), bool)
        pairs, some, held = np.zeros(len(of), np.int64), np.zeros(len(node), bool), []
        slices, first = np.array(slices), np.full((len(node), FIRSTS), np.iinfo(np.int64).max)
        for k, x in enumerate(firsts):
            first[k, : len(x)] = x
        least, mate = np.full(len(node), LEAST_BITS + 1), np.full(len(node), -1)
        for step in range(1, longest):
            i = np.flatnonzero((number[step:] == number[:-step]) & (root[step:] != root[:-step]))
            j = i + step
            most = (n[i] + n[j]) * (100 - percent) // (100 + percent)
            ok = ((side[i] == 0) | (side[i] != side[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j, most = i[ok], j[ok], most[ok]
            away = np.bitwise_count(bits[i] ^ bits[j]).sum(1)
            ok = away <= most
            i, j, most, away = i[ok], j[ok], most[ok], away[ok]
            ok = ~met_before(slices[i], first[i], first[j])
            i, j, most, away = i[ok], j[ok], most[ok], away[ok]
            if nearest:
                for a, b in ((i, j), (j, i)):
                    closer = away < least[a]
                    least[a[closer]], mate[a[closer]] = away[closer], b[closer]
                continue
            some[i] = some[j] = True
            pairs += np.bincount(number[i], minlength=len(of))
            dense = pairs > DENSE * of
            few = ~dense[number[i]]
            held.append(np.stack([i[few], j[few], most[few]]))
        if nearest:
            i = np.flatnonzero(mate >= 0)
            j = mate[i]
            held = [np.stack([i, j, (n[i] + n[j]) * (100 - percent) // (100 + percent)])]
        i, j, most = np.concatenate(held, 1) if held else np.zeros((3, 0), np.int64)
        few = [(a, b) for a, b, m in zip(i.tolist(), j.tolist(), most.tolist(), strict=True) if not dense[number[a]] and distance(sketch[a], sketch[b]) <= m]
        two = np.unique(np.sort(node[np.array(few, np.int64).reshape(-1, 2)], axis=1), axis=0)
        many = np.flatnonzero(some & dense[number]).tolist()
        columns = [[None] * len(two) + [name[k] for k in many], two[:, 0].tolist() + node[many].tolist(), two[:, 1].tolist() + [None] * len(many)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["block", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 1 << 13, 1 << 22):
            yield compared(*rows)

    return run


def _linked_in_blocks(percent: int):
    """Links within blocks where most nodes are alike, on full sets. Rows are (block, node, side, root, n, sketch, members).

    What a link has joined needs no second one, so few sets are compared and few links come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, node, side, root, n, sketch, members in _blocks(batches, 1, 1):
            bits, sets = short(sketch), [np.frombuffer(x, np.uint64) for x in members]
            side, n, found = np.array(side), np.array(n), []
            code = np.unique(np.array(root), return_inverse=True)[1]
            right = np.flatnonzero(side != 1)
            for i in np.flatnonzero(side != 2).tolist():
                j = right[(code[right] != code[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
                most = (n[i] + n[j]) * (100 - percent) // (100 + percent)
                ok = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= most
                for k, m in zip(j[ok].tolist(), most[ok].tolist(), strict=True):
                    if code[i] != code[k] and distance(sketch[i], sketch[k]) <= m and 100 * (both := _common(sets[i], sets[k])) >= percent * (n[i] + n[k] - both):
                        found.append((node[i], node[k]))
                        code[code == code[k]] = code[i]
            columns = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v"])

    return run


def _confirmed(percent: int):
    """Of pairs those whose full sets are similar enough. Rows (u, part, node, n, members) come hub by hub, the hub's own set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, mine = None, 0, None
        for batch in batches:
            us, vs = [], []
            for u, part, node, n, members in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                this = np.frombuffer(members.as_buffer(), np.uint64)
                if (u, part) != hub:
                    hub, size, mine = (u, part), n, this.copy()
                elif 100 * (both := _common(mine, this)) >= percent * (size + n - both):
                    us.append(u)
                    vs.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (u, v) those that are similar. A hub's set goes once to each part of ROWS of its pairs, the others' once for each pair."""
    pairs = durable(pairs)
    size_of = durable(pairs.groupBy("u").agg(F.count("*").alias("many")).withColumn("parts", F.ceil(F.col("many") / ROWS).cast("long")))
    dealt = durable(join_groups(pairs, size_of, ["u"], "many").select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v"))
    rows = dealt.select("u", "part", F.col("v").alias("node"), F.lit(1).alias("side")).unionByName(dealt.select("u", "part", F.col("u").alias("node"), F.lit(0).alias("side")).distinct())
    whole = rows.join(nodes.select("node", "key", "n"), "node").join(sets.select("key", "members"), "key")
    whole = whole.repartition("u", "part").sortWithinPartitions("u", "part", "side").select("u", "part", "node", "n", "members")
    return map_batches(whole, _confirmed(percent), "u long, v long")


def _mixed(rows: DataFrame, rooted: DataFrame, turn: int) -> DataFrame:
    """slice, many, most (members of its largest set) of slices that hold several components, and for this turn one node of it: u, of the component ru."""
    member = rows.join(rooted.select("node", "root", "n"), "node")
    one = F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("one")
    found = member.groupBy("slice").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("many"), F.max("n").alias("most"), one)
    return durable(found.where("r0 <> r1").select("slice", "many", "most", F.col("one.node").alias("u"), F.col("one.root").alias("ru")))


def _in_blocks(rows: DataFrame, rooted: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """slice, node of slices that hold several components, and the rows of their blocks, as _met takes them."""
    mixed = _mixed(rows, rooted, turn)
    mixed = durable(mixed.select("slice", "many", F.greatest(F.lit(1), F.ceil(F.col("many") / ROWS), F.ceil(F.col("many") * F.col("most") * 8 / BYTES)).cast("long").alias("parts")))
    rows = written(join_groups(rows, mixed, ["slice"], "many").select("slice", "node", "parts"), "mixed-slices")
    first = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("slice")), 1, FIRSTS).alias("firsts"))
    todo = rows.withColumn("part", F.pmod(F.xxhash64("node", "slice"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    block = F.concat_ws(",", F.col("slice").cast("string"), F.least("part", "other").cast("string"), F.greatest("part", "other").cast("string"))
    todo = todo.select(block.alias("block"), "node", side.alias("side"), "slice").join(rooted.join(first, "node"), "node")
    return rows.select("slice", "node"), todo.select("block", "node", "side", "root", "n", "sketch", "slice", "firsts")


def _pairs_met(todo: DataFrame, percent: int, nearest: bool) -> DataFrame:
    return durable(map_batches(todo.repartition("block").sortWithinPartitions("block"), _met(percent, nearest), "block string, u long, v long"))


def _joined(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """rooted with the components that these links of nodes join."""
    if links.isEmpty():
        return rooted
    root = rooted.select("node", "root")
    edges = links.join(root.toDF("u", "ru"), "u").join(root.toDF("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    found = durable(components(edges.distinct())).toDF("root", "whole")
    return durable(rooted.join(found, "root", "left").withColumn("root", F.coalesce("whole", "root")).select(*rooted.columns))


def linked(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n and root of each document (root null for empty sets): documents with one root are one component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = durable(_batches_of_sets(docs, size, percent, "key"))
    nodes = signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    one_each = lambda of: docs.join(of.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    cut = _batches_of_sets(one_each(nodes), size, percent, "slices").join(nodes.select("key", "node", "n"), "key")
    cut = written(cut.select("node", "key", "n", "sketch", "slices"), "slices")
    held = cut.select("node", F.explode("slices").alias("slice"))
    shared = durable(held.groupBy("slice").agg(F.count("*").alias("many")).where("many > 1"))
    inside = written(join_groups(held, shared, ["slice"], "many").select("slice", "node"), "shared-slices")
    wanted = durable(cut.drop("slices").join(inside.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    drop_written(cut)
    sets = full_sets(one_each(nodes.join(wanted.select("node"), "node", "left_semi")), size)
    sets = written(sets.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")

    # every node with one node of each slice that holds several components, another one in each round
    rooted, rows = durable(wanted.select("node", "n", "sketch", F.col("node").alias("root"))), inside
    for turn in range(STARS):
        mixed = _mixed(rows, rooted, turn)
        rows = written(join_groups(rows, mixed, ["slice"], "many").select("slice", "node", "u", "ru"), "mixed-slices")
        spoke = rooted.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"), F.col("root").alias("rv"))
        stars = rows.select("u", "ru", F.col("node").alias("v")).distinct().join(spoke, "v").where("ru <> rv")
        near = stars.join(wanted.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u").where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
        near = map_batches(near.select("u", "v", "nu", "nv", "su", "sv"), _allowed(percent), "u long, v long")
        rooted = _joined(rooted, durable(confirmed(near, wanted, sets, percent)))
        rows = rows.select("slice", "node")

    # all nodes of slices that still hold different components: the nearest of each node, then, where components still differ, all
    rows, todo = _in_blocks(rows, rooted, STARS)
    met = _pairs_met(todo, percent, nearest=True)
    rooted = _joined(rooted, durable(confirmed(met.select("u", "v").distinct(), wanted, sets, percent)))
    todo = _in_blocks(rows, rooted, STARS + 1)[1]
    met = _pairs_met(todo, percent, nearest=False)
    more = confirmed(met.where("block IS NULL").select("u", "v").distinct(), wanted, sets, percent)
    alike = met.where("block IS NOT NULL").select("block", F.col("u").alias("node"))
    if not alike.isEmpty():
        alike = todo.drop("slice", "firsts").join(alike, ["block", "node"]).join(wanted.select("node", "key"), "node").join(sets.select("key", "members"), "key")
        alike = alike.select("block", "node", "side", "root", "n", "sketch", "members").repartition("block").sortWithinPartitions("block")
        more = more.unionByName(map_batches(alike, _linked_in_blocks(percent), "u long, v long"))
    found = _joined(rooted, durable(more)).select("node", "root")
    roots = nodes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return signed.join(roots, "key", "left").select("doc_id", "n", "root")


def _allowed(percent: int):
    """Of pairs (u, v, sizes, sketches) those whose sketches don't differ in more bits than similar sets may in members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)
            yield batch.select([0, 1]).filter(pa.array([distance(a, b) <= _differ(n, m, percent) for n, m, a, b in sizes], pa.bool_()))

    return run


def ngram_join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (least doc_id of its component)."""
    rows = durable(linked(docs, size, percent))
    least = durable(rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least")))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))
