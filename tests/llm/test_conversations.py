"""Conversation repair against a search over all edits and a plain dynamic programme."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from aerolith.llm import conversations

STATES = {"": 0, "s": 1, "u": 2, "a": 3}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FORCED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def plain(rows):
    """Report of one conversation from (turn, role, text) in any order: every state keeps its best (cost, audit, turns)."""
    rows = sorted(((t is not None, t or 0), t, *(" " if x is None else x for x in (r, s))) for t, r, s in rows)
    rows = sorted(rows, key=lambda r: (r[0], r[2], ORDER.get(r[3], 0), r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    report = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0) | {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0}
    seen, kinds = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            report[kind] += 1
    report["illegal"] = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    best = {0: (0, "", ())}

    def inserted(found):
        for _ in range(4):
            for q, (c, e, t) in list(found.items()):
                role, to = FORCED[q]
                found[to] = min(found.get(to, (10**9,)), (c + 2, e + "I", (*t, f"{role}:")))
        return found

    for kind, (_, _, role, text) in zip(kinds, rows):
        after, cut = {}, kind == "truncated"
        for q, (c, e, t) in inserted(best).items():
            ways = [(q, 3, "D", t)]
            if kind not in ("blank", "duplicate"):
                if (q, role[:1]) in KEEP:
                    ways.append((KEEP[q, role[:1]], cut, "K", (*t, f"{role}:{text}")))
                ways.append((FORCED[q][1], 2 + cut, "R", (*t, f"{FORCED[q][0]}:{text}")))
            for to, cost, letter, said in ways:
                after[to] = min(after.get(to, (10**9,)), (c + cost, e + letter, said))
        best = after
    ends = inserted(best)
    cost, audit, said = min(ends[q] for q in (0, 3) if q in ends)
    return report | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest()}


ORDER: dict[str, int] = {}


def order_of(spark, texts):
    """Ties of a turn and role go by hash of the text, then text."""
    ORDER.update((r.t, r.h) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect())


def test_edits_against_all_sequences():
    """Every short sequence: the audit is the ASCII-least of the cheapest of all edit strings."""

    def cost(audit, symbols):
        q, total, at = 0, 0, iter(symbols)
        for e in audit:
            s = None if e == "I" else next(at, -1)
            if s == -1:
                return None
            kind = None if s is None or s == 8 else ("s", "u", "a", "x")[s // 2]
            if e == "I":
                q, total = FORCED[q][1], total + 2
            elif e == "D":
                total += 3
            elif s == 8:
                return None
            elif e == "R":
                q, total = FORCED[q][1], total + 2 + s % 2
            elif (q, kind) in KEEP:
                q, total = KEEP[q, kind], total + s % 2
            else:
                return None
        return total if q in (0, 3) and next(at, None) is None else None

    for n in range(4):
        strings = ["".join(x) for m in range(n, n + 4) for x in itertools.product("DIKR", repeat=m) if m - x.count("I") == n]
        for symbols in itertools.product(range(9), repeat=n):
            audit, state = conversations.audit_of(bytes(symbols), 0, 0)
            audit += conversations.closing(state)[0]
            best = min((c, s) for s in strings if (c := cost(s, symbols)) is not None)
            assert (conversations.cost_of(audit, bytes(symbols)), audit) == best


def test_blocks_equal_single_symbols():
    one, block, _ = conversations.tables()
    rng = random.Random(1)
    assert len(one) < 200 and block.shape == (len(one), 9**4)
    for n in (0, 1, 3, 4, 5, 17):
        symbols = bytes(rng.randrange(9) for _ in range(n))
        expected = list(range(len(one)))
        for s in reversed(symbols):
            expected = [one[v, s] for v in expected]
        assert list(conversations.chained(symbols)) == expected


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.choice([0, 1, 2, 5, 9])):
            turn = rng.choice([t, t, t, t, t + 3, None, 2])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ü"]), rng.choice(["Yes.", "No", " \n", "", None, "Wait!\n ", "é?", f"a{t}.", "x " * 200 + "."])))
            rows += [rows[-1]] * rng.choice([0, 0, 0, 1, 3])
    rows += [(500, i % 700, ("user", "assistant", "system")[i * i % 3], f"line {i % 900}{'.' if i % 4 else ''}") for i in range(2500)]
    return rows


def check(spark, rows, **limits):
    order_of(spark, {r[3] if r[3] is not None else " " for r in rows})
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, done string").repartition(6)
    got = {r.conv_id: r.asDict() for r in conversations.repair(df, **limits).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        expected = plain([x[1:] for x in rows if x[0] == c])
        assert {k: r[k] for k in expected} == expected, c
        said = "\n".join(f"{t['role']}:{t['text']}" for t in r["turns"])
        assert hashlib.sha256(said.encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["turns"]))


def test_repair(spark):
    check(spark, rows_of(3))


def test_pieces(spark, monkeypatch):
    """The same with conversations cut into pieces of seven symbols; functions are shipped by value, so limits are set where they are read."""
    monkeypatch.setattr(conversations.Piece, "full", property(lambda p: len(p.symbols) >= 7))
    row = conversations.Piece.row
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t % 40}.") for t in range(100)]
    pieces, piece, seen = [], conversations.Piece(1), set()
    for _, t, role, text in rows:
        if piece.full:
            pieces.append(row(piece, 0, len(pieces)))
            piece = conversations.Piece(1)
        piece.add(t, role, text, (role, text) in seen)
        seen.add((role, text))
    pieces.append(row(piece, 0, len(pieces)))
    v = 0
    for p in reversed(pieces):
        p["behind"] = v
        v = p["front"][v]
    ends = conversations.Ends(1, False)
    for p in pieces:
        ends.add(p)
    expected = plain([r[1:] for r in rows])
    assert len(pieces) > 10 and {k: ends.row()[k] for k in ("gaps", "illegal", "cost", "audit")} == {k: expected[k] for k in ("gaps", "illegal", "cost", "audit")}


def test_whole_query(spark, data):
    """The damaged table against plain Python, and nulls, lost conversations, an empty table."""
    table = spark.read.parquet(f"{data}/conversations.parquet")
    odd = [(None, None, None, None), (None, 3, "user", "Hm."), (-7, None, "assistant", "So."), *((-100 - i, 0, "user", "Lost.") for i in range(40)), (-8, 1, "user", "Very long. " * 100_000)]
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()] + odd
    df = table.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(odd, table.select("conv_id", "turn", "role", "text").schema))
    got = {r.conv_id: r.asDict() for r in conversations.repair_damaged(df).collect()}
    after = {c: [] for c in {r[0] for r in rows}}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            after[c] += [(t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    order_of(spark, {x[2] for v in after.values() for x in v})
    assert set(got) == set(after) and any(not v for v in after.values())
    for c, r in got.items():
        assert {k: v for k, v in r.items() if k != "conv_id"} == plain(after[c]), c
    assert conversations.repair_damaged(df.limit(0)).count() == 0
