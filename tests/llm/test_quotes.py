"""Quotes linked against a replay of each conversation, message by message."""

import random
import re

from opslake.llm import quotes as Q


def norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip()


def runs(text):
    """(level, text) of quoted passages, and the own text."""
    found, own, last = [], [], 0
    lines = re.split(r"\r?\n", text)
    for i, line in enumerate(lines):
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        level = marks.count(">")
        if level:
            content = re.sub(r"^[ \t]", "", line[len(marks):])
            if level == last:
                found[-1][1].append(content)
            else:
                found.append((level, [content]))
        elif not (re.search(r"\bwrote\b.*:[ \t]*$", line) and i + 1 < len(lines) and re.match(r"[ \t]*>", lines[i + 1])):
            own.append(line)
        last = level
    return [(n, "\n".join(t)) for n, t in found], ("\n".join(own).strip() if found else text)


def units(text):
    return {norm(x) for x in [text, *text.split("\n")]} - {""}


def replay(messages):
    """(turn, own text, reply_to, thread, position) of one conversation with one message a turn."""
    known, out, threads = [], [], {}
    for turn, text in sorted(messages):
        found, own = runs(text)
        weight = {}
        for level, passage in found:
            for u in units(passage):
                source = next((t for t, have in reversed(known) if u in have), None)
                if source is not None:
                    weight[level, source] = weight.get((level, source), 0) + len(u)
        best = min(weight, key=lambda k: (k[0], -weight[k], -k[1]), default=None)
        previous = known[-1][0] if known else None
        reply = best[1] if best else previous
        threads[turn] = turn if reply is None else threads[reply]
        known.append((turn, units(own)))
        out.append((turn, own, reply, threads[turn]))
    order = {t: i for i, (_, t) in enumerate(sorted((r[3], r[0]) for r in out), 1)}
    return [(*r, order[r[0]]) for r in out]


def conversation(pick, n):
    said, messages = [], []
    for turn in range(n):
        lines = [" ".join(pick.choice("red Green blue sky sea Sun".split()) for _ in range(pick.randrange(1, 7))) for _ in range(pick.randrange(1, 3))]
        if said and pick.random() < 0.6:
            for _ in range(pick.randrange(1, 3)):
                source = pick.choice(said)
                level = pick.randrange(1, 3)
                lines = (["On Monday x wrote:"] if pick.random() < 0.3 else []) + [pick.choice(["> ", ">", " > "]) * level + x.upper() for x in source.split("\n")] + lines
        messages.append((turn * 2 + 1, "\n".join(lines)))
        said.append("\n".join(runs(messages[-1][1])[1].split("\n")))
    return messages


def test_against_replay(spark):
    pick = random.Random(11)
    all_of = {c: conversation(pick, n) for c, n in enumerate([1, 2, 5, 30, 3])}
    rows = [(c, t, "user", x, "extra") for c, m in all_of.items() for t, x in m]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mark string")
    for slice_turns in (3, Q.SLICE):
        got = {}
        for r in Q.reply_order(frame, slice_turns).collect():
            got.setdefault(r.conv_id, []).append((r.turn, r.text, r.reply_to, r.thread, r.position))
        for c, m in all_of.items():
            assert sorted(got[c]) == replay(m), c


def test_nested_and_odd_rows(spark):
    rows = [
        (1, 0, "a", "Hello there"), (1, 1, "b", "> hello  THERE\nGeneral"), (1, 2, "a", "x wrote:\n> > hello there\n> General\nBold\none"),
        (1, 3, "b", "> nobody said\nWell"), (1, 4, "c", None), (1, 5, "c", ""), (1, 6, "c", "> Hello there\nAgain"), (1, 6, "c", "> Hello there\nAgain"),
        (None, 0, "a", "> q\nlost"), (2, None, "a", "no turn"), (2, 7, None, "late"), (3, 1, "a", "> itself\nitself"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in Q.reply_order(frame).collect()]
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r[3:] for r in got}
    assert by[1, 0] == ("Hello there", None, 0, 1, 0, 0)
    assert by[1, 1] == ("General", 0, 0, 2, 1, 1)
    assert by[1, 2] == ("Bold\none", 1, 0, 3, 2, 2)
    assert by[1, 3] == ("Well", 2, 0, 4, 1, 0)
    assert by[1, 4][:3] == (None, 3, 0) and by[1, 5][:3] == ("", 4, 0)
    assert sorted(r[6] for r in got if r[:2] == (1, 6)) == [7, 8] and by[1, 6][:3] == ("Again", 0, 0)
    assert by[None, 0] == ("lost", None, None, None, 1, 0) and by[2, None] == ("no turn", None, None, None, 0, 0)
    assert by[2, 7] == ("late", None, 7, 1, 0, 0) and by[3, 1] == ("itself", None, 1, 1, 1, 0)
    assert Q.reply_order(frame.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "a", "\n".join(["> line"] * 3000 + ["word " * 20_000]))], frame.schema)
    assert len(Q.reply_order(long).first().text) == 99_999


def test_no_python(spark):
    frame = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    plan = Q.reply_order(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
