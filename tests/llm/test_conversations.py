"""Conversation repair against a search over all edits, and against a plain dynamic programme on tables and odd rows."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from statloom.llm.conversations import audit, audit_damaged, damage, repair
from statloom.llm.queries import op12_conversations

SPACE = " \t\n\x0b\x0c\r"
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FULL = {1: "user", 2: "user", 3: "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", name(text))}.get(k, name(text))
        out += [(conv, turn, "user" if k == 4 else name(role), text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, letters, lines) over all edits, state by state."""
    best = {0: (0, "", ())}

    def put(to, q, way):
        if q not in to or way[:2] < to[q][:2]:
            to[q] = way

    def insert(now):
        for _ in range(3):
            for q, (cost, letters, lines) in list(now.items()):
                for r in (2, 3):
                    if MOVES[FULL[r][0]].get(q) == r:
                        put(now, r, (cost + 2, letters + "I", lines + (FULL[r] + ":",)))
        return now

    best = insert(best)
    for (_, _, role, text), fault in zip(rows, faults(rows)):
        to = {}
        for q, (cost, letters, lines) in best.items():
            put(to, q, (cost + 3, letters + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if (r := MOVES.get(role[:1], {}).get(q)) is not None:
                put(to, r, (cost + more, letters + "K", lines + (f"{role}:{text}",)))
            for name in ("user", "assistant"):
                if (r := MOVES[name[0]].get(q)) is not None:
                    put(to, r, (cost + 2 + more, letters + "R", lines + (f"{name}:{text}",)))
        best = insert(to)
    return min((best[q] for q in (0, 3) if q in best), key=lambda w: w[:2])


def plain(originals, rows):
    key = lambda r: (r[0] is None, r[0] or 0)
    order = lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    by = {k: list(g) for k, g in groupby(sorted(rows, key=order), key)}
    out = []
    for conv in set(originals):
        own = by.get((conv is None, conv or 0), [])
        turns, kinds = [r[1] for r in own if r[1] is not None], faults(own)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, letters, lines = cheapest(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df, key="conv_id"):
    names = [key, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_conversations(spark, sf)) == plain([r[0] for r in rows], damaged(rows))


def random_rows(seed, n):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No", "", " \t", "Why? ", "ok!\n", "a.b", None, "é。", "x" * 10])
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Sys", None])
    return [(rng.choice([None, *range(n // 6)]), rng.choice([None, 0, 1, 2, 3, 5, 8, 9]), role(), text()) for _ in range(n)]


def test_odd_rows(spark):
    rows = random_rows(1, 900)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as copies", "2 as kind", "'x' as conv", "3 as place", "'y' as ending")
    assert got(audit_damaged(df)) == plain([r[0] for r in rows], damaged(rows))
    assert audit_damaged(df.limit(0)).count() == 0


def test_all_dropped(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = audit_damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_long_conversation_with_hot_turns(spark):
    rng = random.Random(4)
    rows = [(5, i % 700, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"turn {i % 50}."])) for i in range(3000)] + [(5, 0, "user", "Hot.")] * 1500 + [(6, 1, "user", "Hot.")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").selectExpr("*", "1L as copies")
    assert got(audit(df), "conv") == plain([5, 6], rows)


@pytest.mark.parametrize("seed", range(3))
def test_small_against_every_sequence_of_edits(spark, seed):
    """Brute force without a programme by states: all letters, all roles, by growing cost."""
    rows = [r for r in random_rows(seed + 10, 60) if r[0] is not None]
    rows = [(r[0] + 100 * seed, i, r[2] or " ", r[3] or " ") for i, r in enumerate(rows)]
    by = {k: list(g) for k, g in groupby(sorted(rows), lambda r: r[0])}
    small = {k: g[:4] for k, g in by.items()}
    df = spark.createDataFrame([r for g in small.values() for r in g], "conv long, turn long, role string, text string").selectExpr("*", "1L as copies")
    found = {r.conv: (r.cost, r.audit) for r in audit(df).collect()}

    def every(own, kinds, done, cost, letters, inserts):
        if not own:
            if re.fullmatch("(s?(ua)+)?", done):
                yield cost, letters
        else:
            (_, _, role, _), fault = own[0], kinds[0]
            yield from every(own[1:], kinds[1:], done, cost + 3, letters + "D", inserts)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for letter, initial, c in (("K", role[:1] or "-", 0), ("R", "u", 2), ("R", "a", 2)):
                    yield from every(own[1:], kinds[1:], done + initial, cost + c + more, letters + letter, inserts)
        if inserts < 3:
            for initial in "ua":
                yield from every(own, kinds, done + initial, cost + 2, letters + "I", inserts + 1)

    for conv, own in small.items():
        assert found[conv] == min(every(own, faults(own), "", 0, "", 0)), own


def test_repaired_turns(spark):
    rows = random_rows(2, 300)
    df = damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns, digests = {}, {r.conv: (r.repaired_sha256, r.audit) for r in audit(df).collect()}
    for r in sorted(repair(df).collect(), key=lambda r: r.at):
        turns.setdefault(r.conv, []).append(r)
    assert set(turns) <= set(digests)
    for conv, (digest, letters) in digests.items():
        own = turns.get(conv, [])
        assert [r.at for r in own] == list(range(1, len(own) + 1))
        assert "".join(r.edit for r in own) == letters.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest
