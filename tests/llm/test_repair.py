"""Repairs against a search over all edits."""

import hashlib
import random
import zlib

import pytest
from opslake.llm import repair
from opslake.llm.queries import damage_turns, repair_digest

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost string, path string, part string, sha256 string"


@pytest.fixture
def turns(spark, docs):
    docs([])  # workers are told where the package is

    def make(rows):
        return spark.createDataFrame([(*r, "x", "y", None, "z", "w") for r in rows], SCHEMA)

    return make


def legal(letters):
    rest = letters[1:] if letters[:1] == "s" else letters
    return letters == "" or (len(rest) > 0 and rest == "ua" * (len(rest) // 2))


def brute(codes):
    """The cheapest (cost, audit) of all edits with up to three insertions between turns."""
    best = None

    def go(i, letters, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(codes) and legal(letters) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserts < 3:
            for x in "ua":
                go(i, letters + x, cost + 5, audit + "I", inserts + 1)
        if i < len(codes):
            must, initial, truncated = codes[i]
            extra = 5 if truncated else 0
            if not must:
                if initial:
                    go(i + 1, letters + initial, cost + extra, audit + "K", 0)
                for x in "ua":
                    go(i + 1, letters + x, cost + 1 + extra, audit + "R", 0)
            go(i + 1, letters, cost + 2, audit + "D", 0)

    def fits(letters):
        rest = letters[1:] if letters[:1] == "s" else letters
        return all(x == "ua"[k % 2] for k, x in enumerate(rest))

    inner = go

    def go(i, letters, cost, audit, inserts):  # noqa: F811 - only what can still become legal
        if fits(letters):
            inner(i, letters, cost, audit, inserts)

    go(0, "", 0, "", 0)
    return best


def code(make):
    must = make.random() < 0.15
    return must, make.choice("suauax") if make.random() < 0.97 else "", not must and make.random() < 0.25


def plain(codes, start=repair.EMPTY):
    """The same table over states with audits written out."""
    def closed(table):
        for _ in range(4):
            for state, (cost, audit) in list(table.items()):
                new = (cost + 5, audit + "I")
                table[repair.MADE[state]] = min(table.get(repair.MADE[state], new), new)
        return table

    table = closed({start: (0, "")})
    for must, initial, truncated in codes:
        extra, after = 5 * truncated, []
        for state, (cost, audit) in table.items():
            after.append((state, cost + 2, audit + "D"))
            if not must:
                after.append((repair.MADE[state], cost + 1 + extra, audit + "R"))
                if (state, initial) in repair.FOLLOWS:
                    after.append((repair.FOLLOWS[state, initial], cost + extra, audit + "K"))
        table = {}
        for state, cost, audit in after:
            table[state] = min(table.get(state, (cost, audit)), (cost, audit))
        table = closed(table)
    return table


def test_cheapest_edits_of_all():
    make = random.Random(1)
    for _ in range(150):
        codes = [code(make) for _ in range(make.randrange(5))]
        got = repair.cheapest(codes)
        assert min(got[s] for s in (repair.EMPTY, repair.ASSISTANT) if s in got) == brute(codes), codes


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 1, 7])
def test_states_and_ties_with_any_hash(modulus):
    make = random.Random(modulus)
    for _ in range(120):
        codes = [code(make) for _ in range(make.randrange(60))]
        start = make.randrange(4)
        assert repair.cheapest(codes, start, modulus) == plain(codes, start)


def test_prefixes_compare_as_strings():
    make, edits = random.Random(4), repair.Edits()
    nodes = [0]
    for _ in range(400):
        nodes.append(edits.add(make.choice(nodes), make.choice("DK")))
    for _ in range(4000):
        a, b = make.choice(nodes), make.choice(nodes)
        assert edits.less(a, b) == (edits.spelled(a) < edits.spelled(b))


WS = "\t\n\x0b\x0c\r "


def replay(rows, damage=True):
    """What the query has to give, conversation by conversation, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if fate == 0:
                continue
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            role = "user" if fate == 4 else role
            mine += [(turn, role, text)] * (2 if fate == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        codes, seen, faults = [], set(), [0, 0, 0]
        for _, role, text in mine:
            said = text.rstrip(WS)
            kind = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
            codes.append((kind in (0, 1), role[:1], kind == 2))
        numbers = [r[0] for r in mine if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        table = plain(codes)
        cost, audit = min(table[s] for s in (repair.EMPTY, repair.ASSISTANT) if s in table)
        left, at = [], 0
        for e in audit:
            if e == "I":
                left.append([None, ""])
            else:
                if e != "D":
                    left.append([mine[at][1] if e == "K" else None, mine[at][2]])
                at += 1
        system = len(left) % 2
        for k, line in enumerate(left):
            if line[0] is None:
                line[0] = ("user", "assistant")[(k - system) % 2]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, *faults, illegal, cost, audit, digest)
    return out


def conversation(make, conv, n):
    rows = []
    for t in range(n):
        role = "system" if t == 0 and make.random() < 0.4 else make.choice(["user", "assistant"]) if make.random() < 0.2 else ("user", "assistant")[t % 2]
        role = make.choice(["", None, "tool", "stop", "usher"]) if make.random() < 0.05 else role
        text = make.choice(["Yes.", "No", "What?", "", None, " \n", "Go on! ", "é", f"line {make.randrange(50)}."])
        rows.append((conv, None if make.random() < 0.03 else t + (make.random() < 0.05), role, text))
    return rows


def got(found):
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def test_query_against_a_replay(turns):
    make = random.Random(9)
    rows = [r for conv in range(150) for r in conversation(make, conv, make.randrange(1, 12))]
    rows += conversation(make, None, 9) + make.sample(rows, 40)
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    make.shuffle(rows)
    found = repair_digest(turns(rows))
    assert found.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    result = got(found)
    assert result == replay(rows)
    assert result[dropped] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_in_many_chunks(turns):
    make = random.Random(2)
    rows = conversation(make, 7, 700) + conversation(make, 8, 3) + [(9, 0, "user", "Hi.")] * 90
    make.shuffle(rows)
    frame = turns(rows).repartition(8)
    assert repair.repair(frame, chunk_turns=16).turns.where("conv_id = 7").count() > 40
    assert got(repair_digest(frame, 16)) == replay(rows)


def test_repeated_turns_and_very_long_texts(turns):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 2_000_000)] + [(2, None, "user", "a.")] * 5000
    assert got(repair_digest(turns(rows))) == replay(rows)


def test_turns_after_the_edits(turns):
    found = repair.repair(turns([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", " ")]))
    assert found.audits.first().audit == "KRD" and found.audits.first().cost == 3
    assert [tuple(e) for r in found.turns.collect() for e in r.edits] == [("K", "user", "Hi."), ("R", "assistant", "There."), ("D", None, None)]


def test_empty_tables(turns):
    assert repair_digest(turns([])).collect() == [] and damage_turns(turns([])).collect() == []
