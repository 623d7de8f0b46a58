"""Conversation structure repair by composition of weighted automata.

A conversation is an acceptor of its rows' symbols: role initial and fault. An
edit transducer keeps, reroles, deletes or inserts turns at a cost; a grammar
accepts an optional system turn and then pairs of user and assistant. Their
composition is made arc by arc, as far as it is asked for. Its shortest path
over (cost, label string) is found in two passes: costs to the end against the
order of rows, then labels along it, the least one that keeps the cost at each
step, from all states that the labels so far allow. Prepending a label
keeps the order of label strings, which appending to strings of different
lengths does not: so costs run backwards. Costs to the end, less their least,
take few values, so both passes are look-ups in tables that fill themselves.

Rows are dealt by ranges of conversation and turn, so a conversation of any
length is split over tasks, and most others are solved where they lie. What
crosses a range is solved from one byte a row, no more than the audit that is
returned; texts stay in their pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, fields, map_rows, stage

BLANKS = " \t\n\x0b\x0c\r"
#: The costs of edits, by label, and of a truncated turn that stays.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
INITIALS = "-sua"  # classes of role initials; the first is any other, or none
NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
SYSTEM, USER, ASSISTANT = 1, 2, 3
#: Grammar (s?(ua)+)?: by state, the classes that it takes and where they lead. States 0 and 3 are final.
GRAMMAR = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
START, FINAL = 0, (0, 3)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: A piece of a conversation ends at so many rows or characters.
PIECE_ROWS, PIECE_CHARS = 1 << 16, 1 << 22
#: Repeated texts up to this number, 100 bytes each, are joined by broadcast; beyond it rows are shuffled.
BROADCAST_REPEATS = 500_000
_MEMO = 1 << 16


class Composition:
    """Shortest paths in rows o edits o grammar."""

    def __init__(self) -> None:
        self._arcs: dict = {}
        self._back: dict = {}
        self._fore: dict = {}
        self.end = self._inserted([0 if q in FINAL else 99 for q in range(len(GRAMMAR))])

    def arcs(self, code: int, q: int) -> list[tuple[str, int, int]]:
        """(label, cost, next state) of the arcs that read a row of this code in state q."""
        key = code, q
        if key not in self._arcs:
            initial, fault = divmod(code, 4)
            out = [("D", COST["D"], q)]
            if fault < BLANK:
                more = TRUNCATED_COST if fault == TRUNCATED else 0
                out += [("K", COST["K"] + more, to) for c, to in GRAMMAR[q].items() if c == initial]
                out += [("R", COST["R"] + more, to) for c, to in GRAMMAR[q].items() if c in (USER, ASSISTANT)]
            self._arcs[key] = out
        return self._arcs[key]

    @staticmethod
    def inserts(q: int) -> list[int]:
        return [to for c, to in GRAMMAR[q].items() if c in (USER, ASSISTANT)]

    def _inserted(self, v: list[int]) -> tuple[int, ...]:
        """Costs to the end if turns may be inserted first; a path without a cycle has at most as many as there are states."""
        for _ in GRAMMAR:
            v = [min([x, *(COST["I"] + v[to] for to in self.inserts(q))]) for q, x in enumerate(v)]
        return tuple(v)

    def back(self, code: int, v: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        """Costs to the end before a row, from those after it: their least, and each less it."""
        key = code, v
        if key not in self._back:
            w = self._inserted([min(cost + v[to] for _, cost, to in self.arcs(code, q)) for q in range(len(GRAMMAR))])
            self._back[key] = min(w), tuple(x - min(w) for x in w)
        return self._back[key]

    def fore(self, states: frozenset[int], code: int | None, v: tuple[int, ...]) -> tuple[str, frozenset[int]]:
        """The least labels from any of the states until a row is read, or to the end without one; and the states then. v: costs to the end after the row."""
        key = states, code, v
        if key not in self._fore:
            labels, here = "", states
            if code is None:
                w = v
            else:
                least, w = self.back(code, v)
                w = tuple(x + least for x in w)
            while True:
                if code is None and any(q in FINAL and w[q] == 0 for q in here):
                    break
                steps = [("I", to, False) for q in here for to in self.inserts(q) if COST["I"] + w[to] == w[q]]
                if code is not None:
                    steps += [(label, to, True) for q in here for label, cost, to in self.arcs(code, q) if cost + v[to] == w[q]]
                label = min(s[0] for s in steps)
                labels, here = labels + label, frozenset(to for x, to, _ in steps if x == label)
                if label != "I":
                    break
            self._fore[key] = labels, here
        return self._fore[key]

    def solve(self, pieces: list[bytes]) -> tuple[int, list[str]]:
        """The cost, and the labels by piece; those after the last row are the last piece's. pieces: codes. Costs to the end are kept between pieces, and made again within each."""
        total, ends = 0, [self.end]
        for codes in reversed(pieces):
            v = ends[-1]
            for c in reversed(codes):
                less, v = self.back(c, v)
                total += less
            ends.append(v)
        total += ends[-1][START]
        out, states = [], frozenset([START])
        for codes, v in zip(pieces, reversed(ends[:-1]), strict=True):
            after = [v]
            for c in reversed(codes):
                after.append(self.back(c, after[-1])[1])
            after.pop()
            labels = []
            for c in codes:
                said, states = self.fore(states, c, after.pop())
                labels.append(said)
            out.append("".join(labels))
        if out:
            out[-1] += self.fore(states, None, self.end)[0]
        return total, out


def edited(codes: bytes, labels: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], list[str], int, int]:
    """The turns that a piece's labels leave: roles, texts, the cost, and the grammar's state then. roles, texts: of the rows that may stay, in order."""
    left, out_roles, out_texts, cost, at = iter(zip(roles, texts, strict=True)), [], [], 0, 0
    for label in labels:
        cost += COST[label]
        role = text = ""
        initial = fault = 0
        if label != "I":
            initial, fault = divmod(codes[at], 4)
            at += 1
            if fault < BLANK:
                role, text = next(left)
        if label == "D":
            continue
        if label != "K":
            initial = USER if USER in GRAMMAR[state] else ASSISTANT
            role = "user" if initial == USER else "assistant"
        cost += TRUNCATED_COST if fault == TRUNCATED else 0
        out_roles.append(role)
        out_texts.append(text)
        state = GRAMMAR[state][initial]
    return out_roles, out_texts, cost, state


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, the copies of each row after damage by a hash of its place; a dropped row has n = 0 and no role. Nulls are one space, in the hash, too."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(place.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("n"))
    gone = F.col("n") == 0
    return rows.select("conv_id", *[F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")], "n")


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def pieces_of(rows: DataFrame) -> DataFrame:
    """Rows, as damage() gives them, as pieces of conversations in order, with the fault of each row.

    A row is blank, or has a role and text that came earlier, or ends without
    [.!?]; the first that holds is its fault. Rows with equal turns are
    ordered by the heads of role and text, then by a hash of both.
    """
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    # Equal rows are counted first: no key that follows repeats.
    some = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", _digest())
    when = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    seen = rows.where("role is not null").withColumn("digest", _digest()).groupBy("conv_id", "digest").agg(F.min(when).alias("first"), F.count("*").alias("c"))
    seen = stage(seen.where("c > 1").select(F.col("conv_id").alias("conv_"), F.col("digest").alias("digest_"), F.col("first.b").alias("first_")), "repeats")
    same = F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_"))
    some = some.join(F.broadcast(seen) if seen.count() <= BROADCAST_REPEATS else seen, same, "left")
    some = some.withColumn("new", F.col("digest_").isNull() | F.col("turn").eqNullSafe(F.col("first_")))
    order = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "digest"]
    dealt = some.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("range"), "turn", "role", "text", "n", "new")
    schema = fields(("conv_id", conv), ("range", "int"), ("seq", "bigint"), ("whole", "boolean"), ("codes", "binary"), ("roles", "array<string>"), ("texts", "array<string>"), ("first_turn", turn), ("last_turn", turn), ("n_turns", "bigint"))

    def cut(batches: Iterator[list[tuple]]) -> Iterator[tuple]:
        waits, seq = None, 0  # the last conversation's last piece: it may go on in the next range
        for number, ((conv_id,), group) in enumerate(by_key(batches, 1)):
            if waits:
                yield waits
                waits = None
            codes, roles, texts, chars, turns, first, last, whole = bytearray(), [], [], 0, 0, None, None, number > 0
            for _, part, turn_, role, text, n, new in group:
                if n and turn_ is not None and turn_ != last:
                    first, last, turns = turn_ if first is None else first, turn_, turns + 1
                if role is None:
                    continue
                kind = max(0, INITIALS.find(role[0])) if role else 0
                body = text.rstrip(BLANKS)
                fault = BLANK if not body else DUPLICATE if not new else NONE if body[-1] in ".!?" else TRUNCATED
                if fault < BLANK:
                    roles.append(role)
                    texts.append(text)
                    codes.append(4 * kind + fault)
                    chars, n, fault = chars + len(text), n - 1, DUPLICATE
                while True:
                    take = min(n, PIECE_ROWS - len(codes))
                    codes += bytes([4 * kind + fault]) * take
                    n -= take
                    if len(codes) < PIECE_ROWS and chars < PIECE_CHARS:
                        break
                    yield conv_id, part, seq, False, bytes(codes), roles, texts, first, last, turns
                    codes, roles, texts, chars, turns, first, whole, seq = bytearray(), [], [], 0, 0, None, False, seq + 1
                    if not n:
                        break
            waits, seq = (conv_id, part, seq, whole, bytes(codes), roles, texts, first, last, turns), seq + 1
        if waits:
            yield (*waits[:3], False, *waits[4:])

    return map_rows(dealt, cut, schema, 512)


def _faults(codes: bytes, before: int | None) -> tuple[int, int, int, int, int | None]:
    """Blank, duplicate and truncated rows, illegal neighbours, and the last row's class. before: the class of the row before, if there is one."""
    faults, kinds = bytes(c & 3 for c in codes), [c >> 2 for c in codes]
    line = kinds if before is None else [before, *kinds]
    illegal = sum(pair not in LEGAL for pair in zip(line, line[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, line[-1] if line else None


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations, in pieces.

    rows: conv_id, turn, role, text and n, as damage() gives them. Returns conv_id,
    piece, whole (the conversation has no other piece), the repaired roles and
    texts, audit (the piece's edits), cost, blank, duplicate, truncated,
    illegal, and first_turn, last_turn, n_turns of its rows. A conversation
    all of whose rows are dropped, and any with nothing left, has pieces
    without turns. A null conv_id is a conversation; an empty role has no
    initial and can't be kept.
    """
    held = stage(pieces_of(rows), "pieces")
    conv, turn = (held.schema[c].dataType.simpleString() for c in ("conv_id", "first_turn"))
    counts = [(c, "bigint") for c in ("cost", "blank", "duplicate", "truncated", "illegal")]
    schema = fields(("conv_id", conv), ("piece", "bigint"), ("whole", "boolean"), ("roles", "array<string>"), ("texts", "array<string>"), ("audit", "string"), *counts, ("first_turn", turn), ("last_turn", turn), ("n_turns", "bigint"))

    def whole(batches):
        net, known = Composition(), {}
        for batch in batches:
            for conv_id, codes, roles, texts, *turns in batch:
                if codes not in known:
                    if len(known) >= _MEMO:
                        known.clear()
                    known[codes] = net.solve([codes])[1][0], _faults(codes, None)[:4]
                labels, faults = known[codes]
                roles, texts, cost, _ = edited(codes, labels, roles, texts)
                yield conv_id, 0, True, roles, texts, labels, cost, *faults, *turns

    def paths(batches):
        net = Composition()
        for _, group in by_key(batches, 1):
            parts = [(r[1], r[2], r[3]) for r in group]
            state, before = START, None
            for i, ((part, seq, codes), labels) in enumerate(zip(parts, net.solve([p[2] for p in parts])[1], strict=True)):
                *faults, last = _faults(codes, before)
                before = last if last is not None else before
                yield part, seq, i, labels, state, faults
                kept = sum(c & 3 < BLANK for c in codes)
                state = edited(codes, labels, [""] * kept, [""] * kept, state)[3]

    def broken(batches):
        for batch in batches:
            for conv_id, codes, roles, texts, i, labels, state, faults, *turns in batch:
                roles, texts, cost, _ = edited(codes, labels, roles, texts, state)
                yield conv_id, i, False, roles, texts, labels, cost, *faults, *turns

    turns = ("first_turn", "last_turn", "n_turns")
    inside = map_rows(held.where("whole").select("conv_id", "codes", "roles", "texts", *turns), whole, schema, 512)
    crossing = held.where("not whole")
    in_order = crossing.select("conv_id", "range", "seq", "codes").repartition("conv_id").sortWithinPartitions("conv_id", "range", "seq")
    found = stage(map_rows(in_order, paths, fields(("range", "int"), ("seq", "bigint"), ("piece", "bigint"), ("audit", "string"), ("state", "int"), ("faults", "array<bigint>")), 512), "paths")
    both = crossing.join(found, ["range", "seq"]).select("conv_id", "codes", "roles", "texts", "piece", "audit", "state", "faults", *turns)
    return inside.unionByName(map_rows(both, broken, schema, 512))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, place (from 0 in the piece), role and text of each repaired turn."""
    each = F.posexplode(F.arrays_zip("roles", "texts"))
    return pieces.select("conv_id", "piece", each.alias("place", "t")).select("conv_id", "piece", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def conversation_reports(pieces: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    pieces are staged first. A conversation in several pieces is one stream of
    hashing and so one task, with a piece at a time in memory.
    """
    held = stage(pieces, "repaired")
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")
    conv = held.schema["conv_id"].dataType.simpleString()
    schema = fields(("conv_id", conv), ("gaps", "bigint"), *[(c, "bigint") for c in sums], ("audit", "string"), ("repaired_sha256", "string"))

    def run(batches):
        for (conv_id,), group in by_key(batches, 1):
            total, labels, h, began, first, last, turns = [0] * len(sums), [], hashlib.sha256(), False, None, None, 0
            for row in group:
                audit, roles, texts, a, b, n = row[2:8]
                total = [x + y for x, y in zip(total, row[8:], strict=True)]
                labels.append(audit)
                for role, text in zip(roles, texts, strict=True):
                    h.update(f"{chr(10) * began}{role}:{text}".encode())
                    began = True
                if a is not None:
                    first, turns, last = a if first is None else first, turns + n - (last == a), b
            yield conv_id, 0 if first is None else last - first + 1 - turns, *total, "".join(labels), h.hexdigest()

    columns = ["conv_id", "piece", "audit", "roles", "texts", "first_turn", "last_turn", "n_turns", *sums]
    one = map_rows(held.where("whole").select(*columns), run, schema)
    several = held.where("not whole").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return one.unionByName(map_rows(several, run, schema))
