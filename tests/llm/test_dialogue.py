import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import dialogue as D

CHAR = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, cut string, first int"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, turns) by plain dynamic programming from the end. rows: (role, text, fault)."""
    best = {"": (0, "", []), "a": (0, "", []), "s": None, "u": None}
    for i in range(len(rows), -1, -1):
        now = dict(best) if i == len(rows) else {}
        if i < len(rows):
            role, text, fault = rows[i]
            for s in NEXT:
                options = [(3, "D", None, s)]
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    if role[:1] and role[:1] in NEXT[s]:
                        options.append((extra, "K", (role, text), role[:1]))
                    options += [(2 + extra, "R", (r, text), r[0]) for r in ("user", "assistant") if r[0] in NEXT[s]]
                now[s] = min(((best[t][0] + c, e + best[t][1], ([x] if x else []) + best[t][2]) for c, e, x, t in options), key=lambda z: z[:2])
        for _ in range(4):
            for s in NEXT:
                for r in ("user", "assistant"):
                    if r[0] in NEXT[s] and now[r[0]]:
                        c, e, x = now[r[0]]
                        option = (c + 2, "I" + e, [(r, ""), *x])
                        now[s] = option if now[s] is None else min(now[s], option, key=lambda z: z[:2])
        best = now
    return best[""]


def brute(table, damage):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        rows = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20 if damage else -1
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = Counter()
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            chars = CHAR.findall(text)
            faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
        count = Counter(faults)
        out[(conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)] += 1
    return out


def table(seed, many, longest):
    rnd = random.Random(seed)
    for conv in range(many):
        order = 0
        for _ in range(rnd.randint(1, longest)):
            order += rnd.choice([0, 1, 1, 1, 1, 3])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None])
            text = rnd.choice(["Yes.", "No?", "cut off", "", " \t", None, "Ünïcödé!", "ends. \n", f"{rnd.random()}"])
            yield (conv, rnd.choice([order] * 9 + [None]), role, text)


@pytest.mark.parametrize("damage,chunk", [(False, 64), (True, 3)])
def test_against_dynamic_programming(spark, monkeypatch, damage, chunk):
    rows = list(table(chunk + damage, 60, 14))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    cut = D.chunks
    monkeypatch.setattr(D, "chunks", lambda x: cut(x, chunk))
    got = Counter(tuple(r) for r in D.repair(df, damage).collect())
    assert got == brute(rows, damage)


def test_one_conversation_has_most_rows(spark, monkeypatch):
    """It is cut by chunks and by partitions, and one of its rows occurs very often."""
    rnd = random.Random(3)
    rows = [(7, i // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Fine.", "cut", f"Number {i}."])) for i in range(900)] + [(7, 100, "user", "Again.")] * 300 + list(table(5, 9, 4))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    cut = D.chunks
    monkeypatch.setattr(D, "chunks", lambda x: cut(x, 32))
    assert Counter(tuple(r) for r in D.repair(df, True).collect()) == brute(rows, True)


def test_nulls_and_conversations_that_lose_every_row(spark):
    gone = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (1,)))
    rows = [(gone, 1, "user", "Hello."), (None, None, None, None), (None, 2, "system", "Be brief."), (None, None, "user", "Who?"), (5, None, "user", "Alone."), (6, 3, "assistant", "So."), (6, 1, "user", "Well?")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = Counter(tuple(r) for r in D.repair(df, True).collect())
    want = brute(rows, True)
    assert got == want and (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in want


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Hello"), (1, 4, "user", "Bye.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in D.repaired(df).orderBy("part", "seq", "idx").select("edit", "role", "text").collect()]
    assert got == [("K", "system", "Be kind."), ("K", "user", "Hi."), ("K", "assistant", "Hello"), ("K", "user", "Bye."), ("I", "assistant", "")]


def test_prices_prove_the_cost():
    """Every arc keeps price <= cost + price behind, and the origin's price is the cost of the traced path."""
    rnd = random.Random(8)
    for _ in range(200):
        codes = "".join(rnd.choice("suaoSUAOx") for _ in range(rnd.randint(0, 20)))
        arcs = D._with_goal(codes, D.END)
        prices = [0] * len(arcs)
        cost = D.auction(arcs, prices, 0)
        assert all(prices[i] <= c + prices[j] for i, out in enumerate(arcs) for _, j, c in out)
        audit, spent, end = D.traced(codes, 0, D.END)
        assert spent + D.END[end] == cost == D._along(list(D.END), list(D.between(codes)), False)[0]
        assert sum(e != "I" for e in audit) == len(codes)


def test_query_on_the_table(spark, tables):
    df = spark.createDataFrame([(*r, "x", 1) for r in table(1, 20, 6)], SCHEMA)
    got = D.op11_dialogue_repair(spark, tables(df, "conversations"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.count() == df.select("conv_id").distinct().count()
    assert all(t == "bigint" for c, t in got.dtypes if c not in ("audit", "repaired_sha256"))


def test_empty(spark):
    assert D.repair(spark.createDataFrame([], SCHEMA), True).count() == 0
    assert D.repaired(spark.createDataFrame([], SCHEMA).withColumn("text", F.col("text"))).count() == 0
