"""Repair of conversations: the cheapest edits that make roles alternate, with an audit of every edit.

The turns of a conversation are read in order and each is kept (K), given another role (R) or deleted (D); turns may be
inserted anywhere (I). What is left has to be empty, or a system turn if there is one and then pairs of a user's and an
assistant's turn. A state says what the turns so far end with; of each state the cheapest edits stay, and of those the
ones whose audit is the least in ASCII.

Edits are persistent: a state's edits are a node that links to the edits before it, so states share what they have in
common and a step adds a node each. Nodes know their ancestors 1, 2, 4, ... steps back and a rolling hash of all edits up
to them. Where two audits cost the same, the search for their longest common prefix goes back by these ancestors as
long as hashes differ, and compares the first edits that do. Equal hashes are verified edit by edit.

A conversation may be long: sorted turns are cut into chunks of bounded size, each chunk gives the cheapest edits from
every state to every state, and one row a chunk is put together in order. A chunk that begins its conversation starts
from the empty state only. Chunks then carry out the edits chosen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake import session

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn with this initial; what is missing can't follow.
FOLLOWS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State after a turn that gets the role it has to have.
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: Turns, and characters of text, of a chunk.
CHUNK_TURNS, CHUNK_CHARS = 4096, 1 << 20


class Edits:
    """Sequences of edits as linked nodes; node 0 has none. ``modulus`` is that of the rolling hash."""

    def __init__(self, modulus: int = (1 << 61) - 1):
        self.modulus = modulus
        self.edit, self.depth, self.hash, self.back = [""], [0], [0], [()]
        self.twin: dict[int, int] = {}

    def add(self, node: int, edit: str) -> int:
        back = [node]
        while len(self.back[back[-1]]) >= len(back):
            back.append(self.back[back[-1]][len(back) - 1])
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * 1_000_003 + ord(edit)) % self.modulus)
        self.back.append(tuple(back))
        return len(self.edit) - 1

    def spelled(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.back[node][0]
        return "".join(reversed(out))

    def _upto(self, node: int, depth: int) -> int:
        over = self.depth[node] - depth
        while over:
            step = over.bit_length() - 1
            node = self.back[node][step]
            over -= 1 << step
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same; walks back to the node that they share."""
        seen = []
        while (a := self.twin.get(a, a)) != (b := self.twin.get(b, b)):
            if self.edit[a] != self.edit[b]:
                return False
            seen.append((max(a, b), min(a, b)))
            a, b = self.back[a][0], self.back[b][0]
        self.twin.update(seen)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` come before those of ``b`` in ASCII."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._upto(a, depth), self._upto(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
        else:
            for step in range(depth.bit_length() - 1, -1, -1):
                if step < len(self.back[x]) and self.hash[self.back[x][step]] != self.hash[self.back[y][step]]:
                    x, y = self.back[x][step], self.back[y][step]
            if self.edit[x] != self.edit[y] and self._same(self.back[x][0], self.back[y][0]):
                return self.edit[x] < self.edit[y]
        return self.spelled(a) < self.spelled(b)  # equal hashes of different edits


def cheapest(turns: list[tuple[bool, str, bool]], start: int = EMPTY, modulus: int = (1 << 61) - 1) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest edits by the state that they lead to from ``start``.

    A turn is (must be deleted, initial of its role, truncated).
    """
    edits = Edits(modulus)
    best: dict[int, tuple[int, int]] = {start: (0, 0)}

    def offer(into: dict, state: int, cost: int, node: int, edit: str) -> bool:
        """``into`` holds (cost, node before the last edit, last edit, node or None)."""
        held = into.get(state)
        if held is not None:
            if cost > held[0]:
                return False
            if cost == held[0]:
                made = edits.add(node, edit)
                other = held[3] if held[3] is not None else edits.add(held[1], held[2])
                into[state] = (*held[:3], other)
                if not edits.less(made, other):
                    return False
                into[state] = (cost, node, edit, made)
                return True
        into[state] = (cost, node, edit, None)
        return True

    def settled(offered: dict) -> dict:
        done = {s: (c, m if m is not None else edits.add(n, e)) for s, (c, n, e, m) in offered.items()}
        return inserted(done)

    def inserted(states: dict) -> dict:
        changed = True
        while changed:
            changed = False
            for state in (EMPTY, SYSTEM, USER, ASSISTANT, USER):
                if state in states:
                    cost, node = states[state]
                    to = MADE[state]
                    if to not in states or cost + INSERT <= states[to][0]:
                        made = edits.add(node, "I")
                        if to not in states or cost + INSERT < states[to][0] or edits.less(made, states[to][1]):
                            states[to] = (cost + INSERT, made)
                            changed = True
        return states

    best = inserted(best)
    for must, initial, truncated in turns:
        extra = TRUNCATED if truncated else 0
        offered: dict = {}
        for state, (cost, node) in best.items():
            offer(offered, state, cost + DELETE, node, "D")
            if not must:
                if (state, initial) in FOLLOWS:
                    offer(offered, FOLLOWS[state, initial], cost + extra, node, "K")
                offer(offered, MADE[state], cost + REROLE + extra, node, "R")
        best = settled(offered)
    return {state: (cost, edits.spelled(node)) for state, (cost, node) in best.items()}


def apply(edits: str, start: int, roles: list, texts: list) -> tuple[list[tuple], int]:
    """(edit, role, text) of each edit and the state after them; role and text are null where a turn goes."""
    out, state, at = [], start, 0
    for edit in edits:
        if edit == "I":
            state = MADE[state]
            out.append((edit, ROLES[state], ""))
            continue
        role, text = roles[at], texts[at]
        at += 1
        if edit == "K":
            state = FOLLOWS[state, role[:1]]
        elif edit == "R":
            state = MADE[state]
            role = ROLES[state]
        else:
            role = text = None
        out.append((edit, role, text))
    return out, state


@dataclass
class Repaired:
    """``audits``: a row for each conversation; ``turns``: the edits carried out, in pieces of bounded size."""

    audits: DataFrame
    turns: DataFrame


_FOUND = "rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, least long, most long, turns long"
_CHUNK = f"part int, seq int, {_FOUND}, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
_AUDIT = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, path array<struct<part:int,seq:int,state:int,edits:string>>"


def ordered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies, fresh) sorted in range partitions; ``fresh``: no earlier row has its role and text.

    Rows alike in all four are one with their number; of rows of one turn the smaller role, then text, is first.
    """
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("said", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    first = rows.groupBy(F.col("conv").alias("conv_"), F.col("said").alias("said_")).agg(F.min(F.struct("turn")).alias("first"))
    rows = rows.join(first, rows["conv"].eqNullSafe(F.col("conv_")) & (F.col("said") == F.col("said_")))
    rows = rows.select("conv", "turn", "role", "text", "copies", F.col("turn").eqNullSafe(F.col("first.turn")).alias("fresh"))
    return rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")


class _Chunk:
    """Turns of one conversation, as they come."""

    def __init__(self, conv, begins: bool, limit: int):
        self.conv, self.begins, self.limit = conv, begins, limit
        self.codes, self.roles, self.texts, self.chars = [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.least = self.most = None

    def add(self, turn, role: str, text: str, fresh: bool) -> None:
        said = text.rstrip(WHITE)
        blank = not said
        truncated = not blank and fresh and said[-1] not in ".!?"
        self.blank += blank
        self.duplicate += not blank and not fresh
        self.truncated += truncated
        initial = role[:1]
        if self.head is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in PAIRS
        self.tail = initial
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        must = blank or not fresh
        self.codes.append((must, initial, truncated))
        self.roles.append(None if must else role)
        self.texts.append(None if must else text)
        self.chars += 0 if must else len(text)

    @property
    def full(self) -> bool:
        return len(self.codes) >= self.limit or self.chars >= CHUNK_CHARS

    def row(self, part: int, seq: int) -> tuple:
        costs, audits = [None] * 16, [None] * 16
        for start in (EMPTY,) if self.begins else range(4):
            for state, (cost, audit) in cheapest(self.codes, start).items():
                costs[start * 4 + state], audits[start * 4 + state] = cost, audit
        found = (len(self.codes), self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.least, self.most, self.turns)
        return (self.conv, part, seq, *found, costs, audits, self.roles, self.texts)


def _stream(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over an iterator of all rows of a partition, its results in small batches."""
    columns = rows.columns
    typed = rows.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(typed.schema)

    def run(batches):
        def each() -> Iterator[tuple]:
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    part = batch.slice(low, 256)
                    yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)

        held, size = [], 0
        for row, weight in fn(each()):
            held.append(row)
            size += weight
            if size > CHUNK_CHARS:
                yield _batch(held, shape)
                held, size = [], 0
        if held:
            yield _batch(held, shape)

    return rows.mapInArrow(run, typed.schema)


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)


def chunks(rows: DataFrame, limit: int = CHUNK_TURNS) -> DataFrame:
    """A row for each chunk of at most ``limit`` ``ordered`` rows: what was found, the cheapest edits from state to state, and its turns."""

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        chunk, seq = None, 0
        for part, conv, turn, role, text, copies, fresh in rows:
            for copy in range(copies):
                if chunk is not None and (chunk.conv != conv or chunk.full):
                    yield chunk.row(part, seq), chunk.chars + 64 * len(chunk.codes) + 256
                    seq += 1
                    chunk = _Chunk(conv, chunk.conv != conv, limit)
                elif chunk is None:
                    chunk = _Chunk(conv, False, limit)  # its first turns may be in the partition before
                chunk.add(turn, role, text, fresh and not copy)
        if chunk is not None:
            yield chunk.row(part, seq), 0

    kind = rows.schema["conv"].dataType.simpleString()
    numbered = rows.select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "text", "copies", "fresh")
    return _stream(numbered, cut, f"conv {kind}, {_CHUNK}")


def _put_together(parts: DataFrame) -> DataFrame:
    """One row for each conversation from its chunks in order."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, total, states = None, None, {}
        for row in rows:
            if total is None or row[0] != conv:
                if total is not None:
                    yield _audited(conv, total, states)
                conv, total, states = row[0], None, {EMPTY: (0, (), "")}
            part, seq, n, blank, duplicate, truncated, illegal, head, tail, least, most, turns, costs, audits = row[1:]
            if total is None:
                total = [n, blank, duplicate, truncated, illegal, tail, least, most, turns]
            else:
                illegal += total[5] + head not in PAIRS
                turns -= least is not None and least == total[7]
                for k, x in enumerate((n, blank, duplicate, truncated, illegal)):
                    total[k] += x
                total[5:9] = tail, least if total[6] is None else total[6], total[7] if most is None else most, total[8] + turns
            after: dict = {}
            for state, (cost, path, audit) in states.items():
                for to in range(4):
                    if costs[state * 4 + to] is not None:
                        c, edits = cost + costs[state * 4 + to], audits[state * 4 + to]
                        if to not in after or (c, audit + edits) < (after[to][0], after[to][2]):
                            after[to] = (c, (path, (part, seq, state, edits)), audit + edits)
            states = after
        if total is not None:
            yield _audited(conv, total, states)

    kind = parts.schema["conv"].dataType.simpleString()
    found = parts.select("conv", "part", "seq", *[c.split()[0] for c in _FOUND.split(", ")], "costs", "audits")
    return _stream(found.repartition("conv").sortWithinPartitions("conv", "part", "seq"), fold, f"conv {kind}, {_AUDIT}")


def _audited(conv, total: list, states: dict) -> tuple[tuple, int]:
    cost, path, audit = min((states[s] for s in (EMPTY, ASSISTANT) if s in states), key=lambda s: (s[0], s[2]))
    steps = []
    while path:
        path, step = path
        steps.append(dict(zip(("part", "seq", "state", "edits"), step, strict=True)))
    n, blank, duplicate, truncated, illegal, _, least, most, turns = total
    gaps = 0 if least is None else most - least + 1 - turns
    return (conv, n, gaps, blank, duplicate, truncated, illegal, cost, steps[::-1]), len(audit) + 256


def _carried_out(parts: DataFrame, audits: DataFrame) -> DataFrame:
    chosen = audits.select(F.explode("path").alias("p")).select("p.*")
    rows = parts.select("conv", "part", "seq", "roles", "texts").join(chosen, ["part", "seq"])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, seq, roles, texts, state, edits in rows:
            made, _ = apply(edits, state, roles, texts)
            yield (conv, part, seq, [dict(zip(("edit", "role", "text"), m, strict=True)) for m in made]), sum(len(m[2] or "") + 16 for m in made)

    kind = parts.schema["conv"].dataType.simpleString()
    return _stream(rows.select("conv", "part", "seq", "roles", "texts", "state", "edits"), run, f"conv {kind}, part int, seq int, edits array<struct<edit:string,role:string,text:string>>")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS) -> Repaired:
    """What is wrong with each conversation, the cheapest edits, and the turns after them.

    ``audits`` has a row for each conversation of ``rows``: n_rows, gaps (turn numbers left out between the least and the
    greatest), the rows whose first fault is to be blank (nothing but white space), duplicate (its role and text were
    there before) or truncated (its last character but for white space is none of ``.!?``), illegal (neighbours whose
    roles begin with other letters than su, ua or au), cost and audit. ``turns`` has (conv, part, seq, edits); in the
    order of part and seq these are the conversation's edits with the role and text that each leaves.

    Rows stand by turn, null first, of one turn by role, then text. A null role or text is one space, a null
    conversation is a conversation. A role without a letter s, u or a at its beginning can't be kept; an empty one is
    such. An empty table has no audits. Columns other than the four are not looked at.
    """
    parts = session.cut(chunks(ordered(rows, conv, turn, role, text), chunk_turns))
    audits = session.cut(_put_together(parts))
    turns = _carried_out(parts, audits)
    audits = audits.select(F.col("conv").alias(conv), "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("path.edits", "").alias("audit"))
    return Repaired(audits, turns.withColumnRenamed("conv", conv))


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, sha256): of the repaired ``role:text`` of each conversation, joined by line breaks; read in order, piece by piece."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        current, digest, started = None, None, False
        for owner, edits in rows:
            if digest is None or owner != current:
                if digest is not None:
                    yield (current, digest.hexdigest()), 80
                current, digest, started = owner, hashlib.sha256(), False
            for e in edits:
                if e["role"] is not None:
                    digest.update(f"{chr(10) if started else ''}{e['role']}:{e['text']}".encode())
                    started = True
        if digest is not None:
            yield (current, digest.hexdigest()), 80

    kind = turns.schema[conv].dataType.simpleString()
    rows = turns.select(F.col(conv).alias("conv"), "part", "seq", "edits").repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "edits")
    return _stream(rows, run, f"conv {kind}, sha256 string").withColumnRenamed("conv", conv)
