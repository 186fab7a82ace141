"""Conversation structure repair by weighted finite-state composition.

A conversation is an acceptor of its rows; the edit transducer keeps, reroles, deletes and inserts rows at costs; the grammar
accepts the role initials (s?(ua)+)?. Their composition is never built: its states, a row and a grammar state, are made as
the shortest path reaches them, row by row, which is their topological order. Weights are pairs of cost and edit string,
the least cost first and of equal ones the least string. Two paths between the same states never have one cost and strings
of which one begins the other (the longer one would have paid for its inserts), so weights add up in any bracketing: long
conversations are cut into pieces, each piece's weights between all grammar states are found apart, and pieces are composed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.shared import small_batches, written

#: The grammar (state and initial, next state), its accepting states, and neighbours that are in order.
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FINAL = ("", "a")
LEGAL = ("su", "ua", "au")
#: Costs of the edits, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\v\f\r"
#: Rows of a piece of a conversation.
PIECE_ROWS = 1024
STATES = ("", "s", "u", "a")
ARCS = "array<struct<entry:string,exit:string,cost:bigint,audit:string>>"
PIECES = f"conv_id {{}}, head bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first string, last string, low bigint, high bigint, arcs {ARCS}"
AUDITS = "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
TURNS = "conv_id {}, place bigint, edit string, role string, text string"

Weights = dict[str, tuple[int, str]]


def _relax(best: dict, state, weight: tuple[int, str]) -> None:
    if state not in best or weight < best[state]:
        best[state] = weight


def inserted(best: Weights) -> Weights:
    """Weights after inserts at one place; from any state, two inserts reach all that inserts can reach at less than a circle."""
    best = dict(best)
    for _ in range(2):
        for state, (cost, audit) in list(best.items()):
            for initial in ROLES:
                if (state, initial) in GRAMMAR:
                    _relax(best, GRAMMAR[state, initial], (cost + INSERT, audit + "I"))
    return best


def _edits(initial: str, fault: str) -> Iterator[tuple[str, int, str]]:
    """Arcs of the edit transducer that take a row: (label, cost, initial given out)."""
    yield "D", DELETE, ""
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        yield "K", KEEP + more, initial or "-"
        for out in ROLES:
            yield "R", REROLE + more, out


def path(rows: tuple[tuple[str, str], ...], entry: str) -> Weights:
    """Least weights from grammar state entry, before the rows (initial, fault), to each state after the last; inserts stand before rows."""
    best: Weights = {entry: (0, "")}
    for initial, fault in rows:
        after: Weights = {}
        for state, (cost, audit) in inserted(best).items():
            for label, more, out in _edits(initial, fault):
                to = GRAMMAR.get((state, out)) if out else state
                if to is not None:
                    _relax(after, to, (cost + more, audit + label))
        best = after
    return best


#: Short conversations are much alike.
_short_path = lru_cache(maxsize=1 << 14)(path)
_SHORT = 16


@dataclass
class Piece:
    """Consecutive rows of a conversation: counts, ends, and the weights between grammar states."""

    n: int = 0
    faults: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0})
    illegal: int = 0
    turns: int = 0
    first: str = ""
    last: str = ""
    low: int | None = None
    high: int | None = None
    arcs: dict[tuple[str, str], tuple[int, str]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple], entries: tuple[str, ...]) -> Piece:
        """Of rows (turn, initial, fault) in order."""
        out = Piece(n=len(rows), first=rows[0][1], last=rows[-1][1])
        for _, _, fault in rows:
            if fault:
                out.faults[fault] += 1
        out.illegal = sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
        turns = [t for t, _, _ in rows if t is not None]
        if turns:
            out.turns, out.low, out.high = len(set(turns)), turns[0], turns[-1]
        shape = tuple((i, f) for _, i, f in rows)
        out.arcs = {(entry, to): weight for entry in entries for to, weight in (_short_path if len(shape) <= _SHORT else path)(shape, entry).items()}
        return out

    def then(self, other: Piece) -> Piece:
        """Both, one after the other."""
        out = Piece(n=self.n + other.n, faults={k: v + other.faults[k] for k, v in self.faults.items()}, first=self.first, last=other.last)
        out.illegal = self.illegal + other.illegal + (self.last + other.first not in LEGAL)
        out.turns = self.turns + other.turns - (self.high is not None and self.high == other.low)
        out.low, out.high = self.low if self.low is not None else other.low, other.high if other.high is not None else self.high
        for (entry, middle), (cost, audit) in self.arcs.items():
            for (begin, to), (more, rest) in other.arcs.items():
                if begin == middle:
                    _relax(out.arcs, (entry, to), (cost + more, audit + rest))
        return out

    def cheapest(self) -> tuple[int, str]:
        """Cost and edits of the whole conversation."""
        ends = inserted({to: weight for (entry, to), weight in self.arcs.items() if not entry})
        return min(ends[s] for s in FINAL if s in ends)


def _pieces(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows (conv, mid, turn, initial, fault). Only the partition's first conversation may have begun elsewhere."""
    conv, rows, head, entries = None, [], None, STATES

    def piece() -> dict:
        p = Piece.of(rows, entries)
        arcs = [{"entry": a, "exit": b, "cost": c, "audit": s} for (a, b), (c, s) in p.arcs.items()]
        return {"conv_id": conv, "head": head, "n": p.n, **p.faults, "illegal": p.illegal, "turns": p.turns, "first": p.first, "last": p.last, "low": p.low, "high": p.high, "arcs": arcs}

    for batch in batches:
        out = []
        for c, mid, turn, initial, fault in zip(*(batch.column(x).to_pylist() for x in ("conv", "mid", "turn", "initial", "fault")), strict=True):
            if rows and (c != conv or len(rows) == PIECE_ROWS):
                out.append(piece())
                entries = STATES if c == conv else ("",)
                rows = []
            if not rows:
                conv, head = c, mid
            rows.append((turn, initial, fault))
        yield pa.RecordBatch.from_pylist(out, schema)
    if rows:
        yield pa.RecordBatch.from_pylist([piece()], schema)


def _composed(pieces: list[Piece]) -> list[Piece]:
    """Pieces with those of like size composed, so that every row is copied as often as sizes double."""
    while len(pieces) > 1 and pieces[-2].n <= pieces[-1].n:
        pieces[-2:] = [pieces[-2].then(pieces[-1])]
    return pieces


def _audits(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of sorted pieces."""
    conv, held = None, []

    def audit() -> dict:
        while len(held) > 1:
            held[-2:] = [held[-2].then(held[-1])]
        p = held[0]
        cost, edits = p.cheapest()
        return {"conv_id": conv, "gaps": 0 if p.low is None else p.high - p.low + 1 - p.turns, **p.faults, "illegal": p.illegal, "cost": cost, "audit": edits}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held and r["conv_id"] != conv:
                out.append(audit())
                held = []
            conv = r["conv_id"]
            arcs = {(x["entry"], x["exit"]): (x["cost"], x["audit"]) for x in r["arcs"]}
            held.append(Piece(r["n"], {k: r[k] for k in ("blank", "duplicate", "truncated")}, r["illegal"], r["turns"], r["first"], r["last"], r["low"], r["high"], arcs))
            held = _composed(held)
        yield pa.RecordBatch.from_pylist(out, schema)
    if held:
        yield pa.RecordBatch.from_pylist([audit()], schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text and the text's digest; nulls of role and text are one space."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    out = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    return out.withColumn("digest", F.unhex(F.sha2("text", 256)))


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation, as a written table.

    Rows are in order of turn (nulls first), then role, then the text's SHA-256; equal rows are rows each. Null roles and
    texts are one space; rows of null ids are one conversation. A row's first fault counts: blank, without any character
    but white space; duplicate, its role and text seen earlier in the conversation; truncated, its last character not one
    of '.!?'. audit has the cheapest edits in order, of equal cost the ASCII-least; illegal counts neighbours out of
    order, gaps the turns missing between the least and the greatest. Other columns are not carried, whatever their names;
    an empty table gives no rows. Texts are read once, to digests, and not shuffled; a conversation of any length is
    dealt over tasks in order, and its duplicates are found by sums over (conversation, role, digest).
    """
    spark = turns.sparkSession
    rows = _turns(turns, id_col, turn_col, role_col, text_col)
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    rows = rows.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), end.alias("end")).withColumn("uid", F.monotonically_increasing_id())
    rows = written(rows, "repair-rows")
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "uid"))["uid"].alias("first_uid")).select("first_uid")
    fault = (
        F.when(F.col("end") == "", "blank").when(F.col("first_uid").isNull(), "duplicate")
        .when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    )
    judged = rows.join(firsts, F.col("uid") == F.col("first_uid"), "left").withColumn("fault", fault)
    keys = ["conv", "turn", "role", "digest", "uid"]
    in_order = judged.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id())
    kind = dict(rows.dtypes)["conv"]
    pieces, audits = PIECES.format(kind), AUDITS.format(kind)
    cut = in_order.select("conv", "mid", "turn", "initial", "fault").mapInArrow(partial(_pieces, _arrow(spark, pieces)), pieces)
    return written(cut.repartition("conv_id").sortWithinPartitions("conv_id", "head").mapInArrow(partial(_audits, _arrow(spark, audits)), audits), "repair-audits")


def _apply(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows of conversations, each of which comes as its audit and then its rows in order."""
    conv, audit, at, state, place = None, "", 0, "", 0
    out: list[tuple] = []

    def give(edit: str, role: str, text: str) -> None:
        nonlocal state, place
        out.append((conv, place, edit, role, text))
        state, place = GRAMMAR[state, role[:1]], place + 1

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            give("I", ROLES["a" if state == "u" else "u"], "")
            at += 1

    for batch in batches:
        for c, kind, role, text, edits in zip(*(batch.column(x).to_pylist() for x in ("conv", "kind", "role", "text", "audit")), strict=True):
            if kind == 0:
                insert()
                conv, audit, at, state, place = c, edits, 0, "", 0
                continue
            insert()
            if audit[at] == "K":
                give("K", role, text)
            elif audit[at] == "R":
                give("R", ROLES["a" if state == "u" else "u"], text)
            at += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        out.clear()
    insert()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def repaired(turns: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text): the rows that each conversation's audit leaves, places from 0, edit K, R or I.

    Rows come out conversation by conversation in order. Texts are shuffled once, by conversation, sorted with the audit
    in front, and pass as a stream: a task holds a batch and one audit, whatever a conversation's length.
    """
    small_batches(turns.sparkSession)
    kind = dict(audits.dtypes)["conv_id"]
    rows = _turns(turns, id_col, turn_col, role_col, text_col).select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    heads = audits.select(F.col("conv_id").alias("conv"), F.lit(0), none("bigint", "turn"), none("string", "role"), none("binary", "digest"), none("string", "text"), "audit")
    both = rows.union(heads).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")
    schema = TURNS.format(kind)
    return both.mapInArrow(partial(_apply, _arrow(turns.sparkSession, schema)), schema)


def _digests(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sha = None, None
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if sha is None or c != conv:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, sha.hexdigest()), schema, strict=True)], schema=schema)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256): of the lines role:text of each conversation with rows. rows as repaired() gives them, not shuffled since.

    A digest is one chain, so the rows of a conversation pass one task, in the order in which repaired() streams them.
    """
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, sha256 string"
    return rows.mapInArrow(partial(_digests, _arrow(rows.sparkSession, schema)), schema)
