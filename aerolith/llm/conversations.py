"""Operator 11: conversation structure repair with Four-Russians block tables.

Each row of a conversation is a symbol: its role's initial, whether its text is cut off, or that it has to go. The cheapest edits to the
role pattern `(s?(ua)+)?` are an edit distance to an automaton of four states. The least cost from each state to the end is
a vector of four small numbers; less its least entry only a few dozen such vectors exist, whatever the length. For every block of
four symbols and every vector behind it a table holds the vector before it, so a conversation is worked off from its end by
one lookup a block. Edits are read off forwards: a block is expanded backwards into the vectors between its rows, and
at each place the least letter that keeps the least cost is taken, so ties end in the ASCII-least audit.

Rows are sorted by range of (conversation, turn), so a conversation of any size is spread over tasks. One that lies inside a task
is done there. The others leave pieces of bounded size, each with its own map from the vector behind it to the vector before it; these
maps, a few bytes a piece, are chained from the end, and then pieces are edited and hashed in order, as a stream: SHA-256 is
sequential, so that last step reads a conversation in one task, but never holds it. Rows that are equal in all columns used are
counted first, so that copies don't meet in one task.

Defined results: null roles and texts are one space; rows of one turn are ordered by role, then text; a null conversation id is a conversation;
an empty or unknown role has to be rerolled or deleted; an empty table gives an empty table; other columns are ignored. The audit holds
K (keep), R (rerole), D (delete), I (insert).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.shared import discard, written

SPACE = " \t\n\v\f\r"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; only the first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that an inserted or rerolled row becomes in each state, and the state behind it.
ROLE, NEXT = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
#: The state behind a kept row, by its initial and the state before it.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
INITIALS, GONE, SYMBOLS = "sua", 8, 9
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
END = (0, 4, 2, 0)
BLOCK = 4
#: A piece of a conversation ends at so many symbols, or characters of text.
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 19


def symbol(role: str, cut_off: bool) -> int:
    at = INITIALS.find(role[:1]) if role else -1
    return 2 * (at if at >= 0 else 3) + cut_off


def options(q: int, sym: int) -> Iterator[tuple[str, int, int]]:
    """(edit, its cost, the state behind it) of the edits that consume a row of this symbol in state q."""
    yield "D", DELETE, q
    if sym != GONE:
        kind, cut_off = divmod(sym, 2)
        behind = KEEP["sua"[kind] if kind < 3 else ""].get(q)
        if behind is not None:
            yield "K", cut_off * CUT_OFF, behind
        yield "R", REROLE + cut_off * CUT_OFF, NEXT[q]


def before(g: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """Least costs in front of a row, from those behind it."""
    out = [min(cost + g[to] for _, cost, to in options(q, sym)) for q in range(4)]
    for _ in range(3):
        out = [min(v, INSERT + out[NEXT[q]]) for q, v in enumerate(out)]
    return tuple(out)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """The table of single symbols, that of blocks (vector behind, block) -> vector before, and the edits of each (vector behind, symbol).

    Vectors are numbered as they are found; number 0 is the one at the end. An entry of the edits is, by state, the letters up to and
    including the one that consumes the row, and the state behind it.
    """
    vectors, number, single = [END], {END: 0}, []
    at = 0
    while at < len(vectors):
        row = []
        for sym in range(SYMBOLS):
            v = before(vectors[at], sym)
            v = tuple(x - min(v) for x in v)
            if v not in number:
                number[v] = len(vectors)
                vectors.append(v)
            row.append(number[v])
        single.append(row)
        at += 1
    one = np.array(single, np.uint8)
    block = one.copy()
    for m in range(1, BLOCK):  # the first symbol is the most significant digit, and is met last
        block = one[block.astype(np.int64)].transpose(0, 2, 1).reshape(len(vectors), SYMBOLS ** (m + 1))
    edits = []
    for g in vectors:
        of_vector = {}
        for sym in range(SYMBOLS):
            full = before(g, sym)
            for q in range(4):
                letters, state = "", q
                while True:
                    ways = [(e, cost + g[to], to) for e, cost, to in options(state, sym)] + [("I", INSERT + full[NEXT[state]], NEXT[state])]
                    edit, _, to = min(w for w in ways if w[1] == full[state])
                    letters, state = letters + edit, to
                    if edit != "I":
                        break
                of_vector[sym, q] = (letters, state)
        edits.append(of_vector)
    return one, block, edits


def codes(symbols: bytes) -> tuple[list[int], np.ndarray]:
    """Symbols in front of the first whole block, and the numbers of the blocks behind them."""
    head = len(symbols) % BLOCK
    digits = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, BLOCK).astype(np.int64)
    return list(symbols[:head]), digits @ SYMBOLS ** np.arange(BLOCK)[::-1]


def chained(symbols: bytes) -> bytes:
    """The vector in front of the symbols, for every vector behind them."""
    one, block, _ = tables()
    head, numbers = codes(symbols)
    at = np.arange(len(one))
    for c in numbers[::-1]:
        at = block[at, c]
    for s in reversed(head):
        at = one[at, s]
    return at.astype(np.uint8).tobytes()


def audit_of(symbols: bytes, behind: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits of the symbols, with the vector behind them, from a state; and the state behind them."""
    one, block, edits = tables()
    head, numbers = codes(symbols)
    bounds = [behind]
    for c in numbers[::-1]:
        bounds.append(int(block[bounds[-1], c]))
    parts = [(head, bounds.pop())] if head else []
    if not head:
        bounds.pop()
    parts += [(symbols[len(head) + BLOCK * i : len(head) + BLOCK * (i + 1)], b) for i, b in enumerate(reversed(bounds))]
    out = []
    for part, v in parts:
        inside = [v]
        for s in part[:0:-1]:
            inside.append(int(one[inside[-1], s]))
        for s, v in zip(part, reversed(inside)):
            letters, state = edits[v][s, state]
            out.append(letters)
    return "".join(out), state


def closing(state: int) -> tuple[str, int]:
    """Insertions at the end."""
    letters = ""
    while END[state]:
        letters, state = letters + "I", NEXT[state]
    return letters, state


def edited(audit: str, symbols: bytes, kept: Iterator[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns; kept yields those of rows that don't have to go."""
    at = iter(symbols)
    for e in audit:
        sym = None if e == "I" else next(at)
        role, text = ("", "") if sym is None or sym == GONE else next(kept)
        if e == "K":
            state = KEEP[role[0]][state]
            yield role, text
        elif e != "D":
            yield ROLE[state], text
            state = NEXT[state]


def cost_of(audit: str, symbols: bytes) -> int:
    at = iter(symbols)
    total = 0
    for e in audit:
        sym = None if e == "I" else next(at)
        total += {"I": INSERT, "D": DELETE, "R": REROLE, "K": 0}[e] + (CUT_OFF if e in "KR" and sym % 2 else 0)
    return total


COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECES = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("done", pa.bool_()), ("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("symbols", pa.binary()), ("front", pa.binary()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
DDL = "conv_id long, part int, k int, done boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns array<struct<role:string,text:string>>, low long, high long, distinct long, first string, last string, symbols binary, front binary, roles array<string>, texts array<string>"
REPORT = ("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


class Piece:
    """What one task has of one conversation since its last piece."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.roles, self.texts, self.chars = conv_id, bytearray(), [], [], 0
        self.low = self.high = self.first = self.last = None
        self.distinct, self.counts = 0, dict.fromkeys(COUNTS, 0)

    def add(self, turn, role: str, text: str, again: bool) -> None:
        bare = text.rstrip(SPACE)
        gone = not bare or again
        cut_off = not gone and bare[-1] not in ".!?"
        self.counts["blank"] += not bare
        self.counts["duplicate"] += bool(bare) and again
        self.counts["truncated"] += cut_off
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.symbols.append(GONE if gone else symbol(role, cut_off))
        if not gone:
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)

    @property
    def full(self) -> bool:
        return len(self.symbols) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def row(self, part: int, k: int) -> dict:
        """The piece, to be put together with others."""
        return {
            "conv_id": self.conv_id, "part": part, "k": k, "done": False, **self.counts, "low": self.low, "high": self.high, "distinct": self.distinct, "first": self.first, "last": self.last,
            "symbols": bytes(self.symbols), "front": chained(bytes(self.symbols)), "roles": self.roles, "texts": self.texts,
        }

    def whole(self, with_text: bool) -> dict:
        """The result of a conversation that is this piece alone."""
        ends = Ends(self.conv_id, with_text)
        ends.add(self.row(0, 0) | {"behind": 0})
        return ends.row() | {"done": True}


class Ends:
    """A conversation put together from its pieces in order."""

    def __init__(self, conv_id, with_text: bool):
        self.conv_id, self.state, self.audit, self.cost, self.sha, self.any, self.turns = conv_id, START, [], 0, hashlib.sha256(), False, [] if with_text else None
        self.low = self.high = self.last = None
        self.distinct, self.counts = 0, dict.fromkeys(COUNTS, 0)

    def say(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True
            if self.turns is not None:
                self.turns.append({"role": role, "text": text})

    def add(self, p: dict) -> None:
        audit, state = audit_of(p["symbols"], p["behind"], self.state)
        self.say(edited(audit, p["symbols"], zip(p["roles"], p["texts"]), self.state))
        self.state, self.cost = state, self.cost + cost_of(audit, p["symbols"])
        self.audit.append(audit)
        for c in COUNTS:
            self.counts[c] += p[c]
        if self.last is not None:
            self.counts["illegal"] += self.last + p["first"] not in ("su", "ua", "au")
        self.last = p["last"]
        if p["low"] is not None:
            self.distinct += p["distinct"] - (p["low"] == self.high)
            self.low, self.high = p["low"] if self.low is None else self.low, p["high"]

    def row(self) -> dict:
        letters, _ = closing(self.state)
        self.say(edited(letters, b"", iter(()), self.state))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost + INSERT * len(letters), "audit": "".join(self.audit) + letters, "repaired_sha256": self.sha.hexdigest(), "turns": self.turns}


def batches_of(rows: Iterator[dict], schema: pa.Schema, at_most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 200 + sum(map(len, r.get("texts") or ())) + len(r.get("audit") or "") + sum(len(t["text"]) for t in r.get("turns") or ())
        if weight > at_most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(with_text: bool):
    """Sorted rows of a task to done conversations and pieces of the others: the first and last of a task, and long ones."""

    def found(batches) -> Iterator[dict]:
        part, k, piece, at_edge, split = TaskContext.get().partitionId(), 0, None, True, False
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv_id, turn, role, text, copies, again in zip(*columns):
                if piece is not None and conv_id != piece.conv_id:
                    if at_edge or split:
                        yield piece.row(part, k)
                        k += 1
                    else:
                        yield piece.whole(with_text)
                    piece, at_edge, split = None, False, False
                piece = piece or Piece(conv_id)
                for i in range(copies):
                    if piece.full:
                        yield piece.row(part, k)
                        k, piece, split = k + 1, Piece(conv_id), True
                    piece.add(turn, role, text, again or i > 0)
        if piece is not None:
            yield piece.row(part, k)

    return lambda batches: batches_of(found(batches), PIECES)


def _behind(batches):
    """Pieces from the last to the first of each conversation, to the vector behind each."""
    seen, conv_id, v = False, None, 0
    for batch in batches:
        out = []
        for c, front in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if not seen or c != conv_id:
                seen, conv_id, v = True, c, 0
            out.append(v)
            v = front[v]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.int32())], ["part", "k", "behind"])


def _ends(with_text: bool):
    """Pieces in order, with the vector behind each, to conversations."""
    schema = pa.schema([PIECES.field(c) for c in (*REPORT, "turns")])

    def found(batches) -> Iterator[dict]:
        ends = None
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.slice(i, 1).to_pylist()[0]
                if ends is not None and ends.conv_id != p["conv_id"]:
                    yield ends.row()
                    ends = None
                ends = ends or Ends(p["conv_id"], with_text)
                ends.add(p)
        if ends is not None:
            yield ends.row()

    return lambda batches: batches_of(found(batches), schema)


def repair(rows: DataFrame, with_text: bool = True, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, the faults by kind, cost, audit, repaired_sha256 and, with_text, the repaired turns of each conversation of rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    counted = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    counted = counted.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(7), "text")})
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    said = counted.groupBy("conv_id", "role", "h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("start")).where("n > 1").drop("n")
    said = said.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "h", "g")), "start")
    same = F.lit(True)
    for c in ("conv_id", "role", "h", "g"):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = counted.join(said, same, "left").select("conv_id", "turn", "role", "text", "copies", F.coalesce(turn > F.col("start"), F.lit(False)).alias("again"), "h")
    placed = marked.repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h", "text").drop("h")
    pieces = written(placed.mapInArrow(_pieces(with_text), DDL), "pieces")
    opened = pieces.where("not done")
    chain = opened.select("conv_id", "part", "k", "front").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("k"))
    behind = written(chain.mapInArrow(_behind, "part int, k int, behind int"), "behind")
    wanted = opened.select("conv_id", "part", "k", "low", "high", "distinct", "first", "last", *COUNTS, "symbols", "roles", "texts").join(behind, ["part", "k"])
    stitched = wanted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").mapInArrow(_ends(with_text), ", ".join(f"{c} {t}" for c, t in pieces.select(*REPORT, "turns").dtypes))
    out = written(pieces.where("done").select(*REPORT, "turns").unionByName(stitched), "repaired")
    discard(pieces, behind)
    return out if with_text else out.drop("turns")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of conv_id:turn modulo 20; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """A row for every conversation of the input, also for those that lost all their rows."""
    report = repair(damaged(conversations), with_text=False)
    names = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(F.col("conv_id").alias("name"))
    none = {c: F.lit(0).cast("long") for c in ("gaps", *COUNTS, "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return names.join(report, F.col("name").eqNullSafe(F.col("conv_id")), "left").select(F.col("name").alias("conv_id"), *(F.coalesce(c, v).alias(c) for c, v in none.items()))
