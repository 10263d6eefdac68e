"""Finding the faults of conversations and the cheapest edits that give them a legal form.

The rows of a conversation stand by turn (nulls first), then role and text. The first fault of a row
counts: blank (no character but white space), duplicate (role and text seen earlier in the
conversation), truncated (its last such character is none of ``.!?``). Edits, in the order of the rows:
keep (K, cost 0), rerole to user or assistant (R, 1), delete (D, 2; required for
blank and duplicate rows) and insert an empty user or assistant row (I, 5); a truncated
row that stays adds 5. What is left must have the role initials ``(s?(ua)+)?``. Of the cheapest audits
(the letters of the edits) the least in ASCII order is taken.

The edit lattice has a node for each number of rows gone and each state of that pattern. A
bidirectional Dijkstra search finds the audit: a forward heap from the start and a reverse heap from
the goals meet, all crossings of the least cost are finished, and the least concatenation of a
forward and a reverse audit wins. Two audits of one cost from one node to another never are
the beginning of each other (the rest would be a free loop), so the least parts make the least whole.

Rows are cut into pieces of at most ``PIECE_ROWS`` rows. For conversations of several pieces the
search runs in every piece between each two states, and then over the lattice of pieces, by the same
routine. So a long conversation is worked on by many tasks; only its codes and audits (a byte a
row each) meet in one, as does the one string of its audit.

Null roles and texts are one space, as in the damage of the query; null turns count as turns before all others, a null
``conv_id`` is a conversation of its own, and repeated rows are duplicates. An empty table gives no
rows. Other columns are left behind, so no name can clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarespark.llm.prefilter import mark_possible
from rarespark.llm.rows import NO_ID
from rarespark.operators.joins import heavy_keys, salted_join
from rarespark.session import materialize

PIECE_ROWS = 128
_PIECE_BYTES = 1 << 22

# --- fixed values: costs of edits, initials, states --------------------------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE, BLANK, DUPLICATE, CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
GOALS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
WHITE = " \t\n\r\x0b\x0c"
# --- end of fixed values ------------------------------------------------------

Node = tuple[int, int]
Edges = Callable[[Node], Iterable[tuple[Node, int, str]]]


def least_path(sources: list[Node], goals: list[Node], ahead: Edges, back: Edges) -> tuple[int, str] | None:
    """(cost, labels) of the cheapest path, the least in ASCII order among equals; None if there is none.

    Edges that cost nothing must go from a smaller first component to a larger one: nodes of one
    cost are settled in that order (reversed in reverse), so all free ways into a
    node are known when it is settled."""
    sides = []
    for starts, edges, sign in ((sources, ahead, 1), (goals, back, -1)):
        sides.append(({n: (0, "") for n in starts}, set(), [(0, sign * n[0], n) for n in starts], edges, sign))
        heapq.heapify(sides[-1][2])
    best: tuple[int, str] | None = None
    for node in set(sources) & set(goals):
        best = (0, "")
    while sides[0][2] and sides[1][2]:
        if best is not None and sides[0][2][0][0] + sides[1][2][0][0] > best[0]:
            break
        way = 0 if sides[0][2][0][0] <= sides[1][2][0][0] else 1
        known, settled, heap, edges, sign = sides[way]
        other_known, other_settled = sides[1 - way][:2]
        cost, _, node = heapq.heappop(heap)
        if node in settled or known[node][0] != cost:
            continue
        settled.add(node)
        said = known[node][1]
        for to, more, label in edges(node):
            labels = said + label if way == 0 else label + said
            if to in other_settled:
                rest = other_known[to]
                whole = (cost + more + rest[0], labels + rest[1] if way == 0 else rest[1] + labels)
                if best is None or whole < best:
                    best = whole
            if to not in settled and (to not in known or (cost + more, labels) < known[to]):
                if to not in known or cost + more < known[to][0]:
                    heapq.heappush(heap, (cost + more, sign * to[0], to))
                known[to] = (cost + more, labels)
    return best


def edit_edges(codes: str) -> tuple[Edges, Edges]:
    """Forward and reverse edges of the lattice of ``codes`` (initial and fault of each row)."""
    n = len(codes) // 2

    def row_edges(i: int, state: int) -> Iterator[tuple[int, int, str]]:
        initial, fault = codes[2 * i], int(codes[2 * i + 1])
        yield state, DELETE, "D"
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED if fault == CUT else 0
        for letter, to in NEXT[state].items():
            if letter == initial:
                yield to, KEEP + extra, "K"
            if letter in ROLES:
                yield to, REROLE + extra, "R"

    def inserts(state: int) -> Iterator[int]:
        yield from (to for letter, to in NEXT[state].items() if letter in ROLES)

    def ahead(node: Node):
        i, state = node
        yield from (((i, to), INSERT, "I") for to in inserts(state))
        if i < n:
            yield from (((i + 1, to), cost, label) for to, cost, label in row_edges(i, state))

    def back(node: Node):
        i, state = node
        for was in NEXT:
            if state in inserts(was):
                yield (i, was), INSERT, "I"
            if i:
                yield from (((i - 1, was), cost, label) for to, cost, label in row_edges(i - 1, was) if to == state)

    return ahead, back


def cheapest_edits(codes: str) -> tuple[int, str]:
    n = len(codes) // 2
    return least_path([(0, START)], [(n, s) for s in GOALS], *edit_edges(codes))


def edits_between_states(codes: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a piece, wherever there is a way."""
    n, (ahead, back) = len(codes) // 2, edit_edges(codes)
    out = []
    for a in NEXT:
        for b in NEXT:
            found = least_path([(0, a)], [(n, b)], ahead, back)
            if found:
                out.append((a, b, *found))
    return out


def join_pieces(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Cost and the audit of each piece, from the edits between states of the pieces."""
    out, into = {}, {}
    for i, edges in enumerate(pieces):
        for a, b, cost, audit in edges:
            out.setdefault((i, a), []).append(((i + 1, b), cost, audit))
            into.setdefault((i + 1, b), []).append(((i, a), cost, audit))
    cost, audit = least_path([(0, START)], [(len(pieces), s) for s in GOALS], lambda n: out.get(n, ()), lambda n: into.get(n, ()))
    return cost, _cut_audit(audit, [sum(1 for c in edges[0][3] if c != "I") for edges in pieces])


def _cut_audit(audit: str, rows: list[int]) -> list[str]:
    """Parts of the audit; those but the last end with the last of their rows, so inserts between
    two pieces go with the later one."""
    parts, at = [], 0
    for number, count in enumerate(rows):
        end = at
        while count:
            count -= audit[end] != "I"
            end += 1
        end = len(audit) if number == len(rows) - 1 else end
        parts.append(audit[at:end])
        at = end
    return parts


def apply_edits(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The repaired ``(role, text)`` rows and the state after them."""
    out, rows = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        letter = role[:1] if edit == "K" else next(x for x in NEXT[state] if x in ROLES)
        out.append((role if edit == "K" else ROLES[letter], text))
        state = NEXT[state][letter]
    return out, state


def fault_of(text: str, again: bool) -> int:
    said = text.rstrip(WHITE)
    if not said:
        return BLANK
    if again:
        return DUPLICATE
    return NONE if said[-1] in ".!?" else CUT


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


_PIECES = (
    "_conv bigint, seg bigint, sub bigint, codes string, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " first string, last string, low bigint, high bigint, turns bigint, roles array<string>, texts array<string>"
)


def conversation_pieces(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of up to ``piece_rows`` rows with the initials and faults of their rows.

    Rows are dealt by ranges of turn numbers. A role and text that occurs again in its conversation is found by
    hashes; its earliest turn is joined to the rows that may have one."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("_conv"), F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_ID)).alias("_turn"),
        _spaced("role").alias("role"), _spaced("text").alias("text"),
    )
    rows = rows.withColumns({
        "seg": F.when(F.col("_turn") == NO_ID, NO_ID).otherwise(F.floor(F.col("_turn") / piece_rows)).cast("bigint"),
        "h1": F.xxhash64("_conv", "role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role", "_conv"),
    })
    again = rows.groupBy("h1", "h2").agg(F.min("_turn").alias("_since"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = materialize(again, "said-again")
    marked = mark_possible(rows, again, ["h1", "h2"])
    some = marked.where("_maybe").drop("_maybe")
    found = salted_join(some, again, ["h1", "h2"], heavy_keys(some, "h1"), "h1", F.struct("_conv", "_turn"), "left")
    columns = ["_conv", "seg", "_turn", "role", "text", "_since"]
    rows = marked.where("NOT _maybe").withColumn("_since", F.lit(None).cast("bigint")).select(*columns).unionByName(found.select(*columns))

    def cut(batches):
        said = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        ready, size = [], 0
        for (conv, seg), group in groupby(said, key=lambda r: r[:2]):
            sub, before = 0, None
            codes, roles, texts, turns = [], [], [], []
            counts, pairs, chars = [0, 0, 0, 0], 0, 0

            def piece():
                known = [t for t in turns if t is not None]
                return (
                    conv, seg, sub, "".join(codes), counts[BLANK], counts[DUPLICATE], counts[CUT], pairs, roles[0][:1], roles[-1][:1],
                    min(known, default=None), max(known, default=None), len(known), list(roles), list(texts),
                )

            for _, _, turn, role, text, since in group:
                # the copies of a row stand side by side
                fault = fault_of(text, (since is not None and turn > since) or before == (turn, role, text))
                if codes and (len(codes) >= piece_rows or chars + len(text) > _PIECE_BYTES):
                    ready.append(piece())
                    size, sub = size + chars, sub + 1
                    codes, roles, texts, turns = [], [], [], []
                    counts, pairs, chars = [0, 0, 0, 0], 0, 0
                if roles:
                    pairs += roles[-1][:1] + role[:1] not in LEGAL_PAIRS
                counts[fault] += 1
                # each turn number once: those of a range lie in one run
                turns.append(turn if turn != NO_ID and (before is None or before[0] != turn) else None)
                before = (turn, role, text)
                initial = role[:1]
                codes.append((initial if initial in ("s", "u", "a") else "x") + str(fault))
                roles.append(role), texts.append(text)
                chars += len(text)
            ready.append(piece())
            size += chars
            if size > _PIECE_BYTES or len(ready) > 4096:
                yield _batch(ready, _PIECE_SCHEMA)
                ready, size = [], 0
        if ready:
            yield _batch(ready, _PIECE_SCHEMA)

    order = ["_conv", "seg", "_turn", "role", "text"]
    return rows.repartition("_conv", "seg").sortWithinPartitions(*order).mapInArrow(cut, _PIECES)


_PIECE_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("_conv", "seg", "sub")] + [("codes", pa.string())] + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string())] + [(n, pa.int64()) for n in ("low", "high", "turns")]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
_WAYS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_AUDITS = "_conv bigint, seg bigint, sub bigint, part string, state int, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string"
_AUDIT_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("_conv", "seg", "sub")] + [("part", pa.string()), ("state", pa.int32())] + [(c, pa.int64()) for c in _COUNTS] + [("audit", pa.string())]
)


def audit_pieces(pieces: DataFrame) -> DataFrame:
    """One row for each piece: its part of the audit and the state it begins with; the first piece
    of a conversation also carries the counts and the whole audit."""
    narrow = pieces.drop("roles", "texts")
    long = narrow.groupBy("_conv").agg(F.count("*").alias("_n")).where("_n > 1").select("_conv")
    marked = mark_possible(narrow, long, ["_conv"])
    names = narrow.columns

    def ways(batches):
        for batch in batches:
            several = batch.column(len(names)).to_pylist()
            codes = batch.column(names.index("codes")).to_pylist()
            found = [[dict(zip(("a", "b", "cost", "audit"), w)) for w in edits_between_states(c)] if m else None for c, m in zip(codes, several)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, _WAYS)], [*names, "ways"])

    schema = _PIECES.rsplit(", roles", 1)[0] + ", ways array<struct<a: int, b: int, cost: bigint, audit: string>>"
    solved = marked.mapInArrow(ways, schema)

    def settle(batches):
        rows = (dict(zip(batch.schema.names, row)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        ready = []
        for conv, group in groupby(rows, key=lambda r: r["_conv"]):
            places, edges, codes, state = [], [], [], START
            sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
            low = high = last = None
            for row in group:
                places.append((row["seg"], row["sub"]))
                edges.append([tuple(w.values()) for w in row["ways"]] if row["ways"] is not None else None)
                codes.append(row["codes"])
                for name in sums:
                    sums[name] += row[name]
                if last is not None:
                    sums["illegal"] += last + row["first"] not in LEGAL_PAIRS
                last = row["last"]
                if row["low"] is not None:
                    low = row["low"] if low is None else min(low, row["low"])
                    high = row["high"] if high is None else max(high, row["high"])
            if len(places) == 1:
                cost, whole = cheapest_edits(codes[0])
                parts = [whole]
            else:
                cost, parts = join_pieces(edges)
                whole = "".join(parts)
            gaps = 0 if low is None else high - low + 1 - sums["turns"]
            counts = (gaps, *(sums[c] for c in _COUNTS[1:5]), cost, whole)
            for number, (place, part, code) in enumerate(zip(places, parts, codes)):
                ready.append((conv, *place, part, state, *(counts if number == 0 else [None] * len(counts))))
                state = apply_edits(((initial, "") for initial in code[::2]), part, state)[1]
            if len(ready) > 4096:
                yield _batch(ready, _AUDIT_SCHEMA)
                ready = []
        if ready:
            yield _batch(ready, _AUDIT_SCHEMA)

    return solved.repartition("_conv").sortWithinPartitions("_conv", "seg", "sub").mapInArrow(settle, _AUDITS)


def _edited(pieces: DataFrame, audits: DataFrame, by: list[str], finish, schema: str) -> DataFrame:
    """``finish`` over ``((conv, seg, sub), repaired rows)`` in order; an audit comes just before the rows of its piece."""
    kinds = {"roles": "array<string>", "texts": "array<string>", "part": "string", "state": "int"}
    sides = []
    for number, side in enumerate((audits, pieces)):
        missing = {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in side.columns}
        sides.append(side.withColumns(missing).select("_conv", "seg", "sub", F.lit(number).alias("kind"), *kinds))

    def apply(batches):
        def repaired():
            part, state = "", START
            for batch in batches:
                for conv, seg, sub, kind, roles, texts, said, before in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind == 0:
                        part, state = said, before
                    else:
                        yield (conv, seg, sub), apply_edits(zip(roles, texts), part, state)[0]

        yield from finish(repaired())

    rows = sides[0].unionByName(sides[1]).repartition(*by).sortWithinPartitions("_conv", "seg", "sub", "kind")
    return rows.mapInArrow(apply, schema)


def repaired_turns(pieces: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, seg, sub, place, role, text)``: the rows that are left, in the order of the first four."""
    names = ["_conv", "seg", "sub", "place", "role", "text"]
    kinds = pa.schema([(n, pa.int64()) for n in names[:4]] + [(n, pa.string()) for n in names[4:]])

    def finish(pieces):
        for key, rows in pieces:
            if rows:
                yield _batch([(*key, i, role, text) for i, (role, text) in enumerate(rows)], kinds)

    turns = _edited(pieces, audits, ["_conv", "seg"], finish, "_conv bigint, seg bigint, sub bigint, place bigint, role string, text string")
    return turns.select(F.nullif("_conv", F.lit(NO_ID)).alias("conv_id"), *names[1:])


def repaired_digests(pieces: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the ``role:text`` rows that are left, joined by line ends. A digest
    needs its conversation in order, but only a piece of it is held at a time."""
    kinds = pa.schema([("_conv", pa.int64()), ("repaired_sha256", pa.string())])

    def finish(pieces):
        ready = []
        for conv, group in groupby(pieces, key=lambda p: p[0][0]):
            digest, join = hashlib.sha256(), ""
            for _, rows in group:
                for role, text in rows:
                    digest.update(f"{join}{role}:{text}".encode())
                    join = "\n"
            ready.append((conv, digest.hexdigest()))
            if len(ready) > 4096:
                yield _batch(ready, kinds)
                ready = []
        if ready:
            yield _batch(ready, kinds)

    digests = _edited(pieces, audits, ["_conv"], finish, "_conv bigint, repaired_sha256 string")
    return digests.select(F.nullif("_conv", F.lit(NO_ID)).alias("conv_id"), "repaired_sha256")


def repair_conversations(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(reports, pieces, audits)``: per conversation ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``,
    and what ``repaired_turns`` and ``repaired_digests`` take. Both are stored."""
    pieces = materialize(conversation_pieces(conversations, piece_rows), "conversation-pieces")
    audits = materialize(audit_pieces(pieces), "conversation-audits")
    reports = audits.where("audit IS NOT NULL").select(F.nullif("_conv", F.lit(NO_ID)).alias("conv_id"), *_COUNTS, "audit")
    return reports, pieces, audits
