"""Conversations in reply order, without quotes: DataFrame functions only.

Lines that begin with ``>`` are quotes; their number of marks is the level. Lines of one level in a row make a
passage. A passage, and each line of it, is normalised (lower case, white space as one space) and hashed, as are the
own text of every message and each line of that. A quote stems from the latest earlier message of its conversation
that has the same hash. A message replies to the one that its outermost linked quotes quote most characters of; one
that quotes nothing known continues what stood before it.

Threads begin with the first message and wherever a message replies to another than the one before. A reply's thread
is that of what it quotes, found by doubling pointers between the messages that begin one. Conversations may be of any
length: running values are taken in slices of turns, and nothing gathers a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake import session
from opslake.operators import scan

#: Turns of a slice of a conversation that one task takes.
SLICE = 1 << 14
_QUOTE = r"(?m)^[ \t]*>"
_QUOTED_LINES = r"(?m)^[ \t]*>[^\n]*(?:\n|\z)"
# Words of the lines that introduce a quote.
_INTRODUCED = r"(?m)^[^\n]*\b(?:wrote|writes|said|schrieb|a écrit|escribió)\b[^\n]*:[ \t\r]*\n(?=[ \t]*>)"


def own_text(text: Column) -> Column:
    """A text without quoted lines and the lines that introduce them, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(text, _INTRODUCED, ""), _QUOTED_LINES, "")
    return F.when(text.rlike(_QUOTE), F.regexp_replace(bare, r"^\s+|\s+\z", "")).otherwise(text)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """(level, content) of each line; level 0 is own text."""
    marks = lambda x: F.regexp_extract(x, r"^(?:[ \t]*>)*", 0)
    return F.transform(
        F.split(text, r"\r?\n"),
        lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, r"^(?:[ \t]*>)*[ \t]?", "").alias("line")),
    )


def passages(text: Column) -> Column:
    """(level, text) of the runs of quoted lines of one level, in order."""
    lines = _lines(text)
    # the places where a run begins; a run ends where the next one begins
    numbered = F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), i.alias("i")))
    begins = F.filter(F.arrays_zip(numbered.alias("a"), F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x["level"])).alias("b")), lambda z: z["a"].isNotNull() & (z["a"]["level"] != z["b"]))
    starts = F.transform(begins, lambda z: F.struct(z["a"]["level"].alias("level"), z["a"]["i"].alias("i")))
    runs = F.transform(
        starts,
        lambda s, j: F.struct(
            s["level"].alias("level"),
            F.array_join(F.transform(F.slice(lines, s["i"] + 1, F.coalesce(F.get(starts, j + 1)["i"], F.size(lines)) - s["i"]), lambda x: x["line"]), "\n").alias("text"),
        ),
    )
    return F.filter(runs, lambda r: r["level"] > 0)


def _units(text: Column, level: Column) -> Column:
    """(level, hash, length) of a text as a whole and of each of its lines, normalised; empty ones are left out."""
    whole = normalised(text)
    every = F.array_distinct(F.concat(F.array(whole), F.transform(F.split(text, "\n"), normalised)))
    return F.transform(F.filter(every, lambda x: x != ""), lambda x: F.struct(level.alias("level"), F.sha2(x, 256).alias("unit"), F.length(x).cast("long").alias("size")))


def links(messages: DataFrame, slice_turns: int = SLICE) -> DataFrame:
    """conv_id, turn, mark, n_quotes, n_linked, quoted: for each message that quotes, the turn it replies to or null.

    ``mark`` tells messages of one turn apart.
    """
    quoting = messages.where(F.col("text").rlike(_QUOTE)).select("conv_id", "turn", "mark", passages(F.col("text")).alias("passages")).distinct()
    quoted = quoting.select("conv_id", "turn", "mark", F.posexplode("passages").alias("place", "p")).select(
        "conv_id", "turn", "mark", "place", F.explode(_units(F.col("p.text"), F.col("p.level"))).alias("u")
    ).select("conv_id", "turn", "mark", "place", "u.*")
    wanted = quoted.select("conv_id", "unit").distinct()
    own = messages.select("conv_id", "turn", F.explode(_units(own_text(F.col("text")), F.lit(0))).alias("u")).select("conv_id", "turn", "u.unit")
    own = own.join(wanted, ["conv_id", "unit"], "left_semi").distinct()
    nothing = lambda kind: F.lit(None).cast(kind)
    both = quoted.withColumn("origin", nothing("bigint")).unionByName(
        own.select("conv_id", "turn", "unit", F.col("turn").cast("bigint").alias("origin"), nothing("bigint").alias("mark"), nothing("int").alias("place"), nothing("int").alias("level"), nothing("bigint").alias("size"))
    ).withColumn("late", F.col("origin").isNotNull().cast("int"))
    # quotes come before the own text of their turn, so a message never quotes itself
    found = scan.running(both, ["conv_id", "unit"], ["turn", "late", "mark", "place", "level"], scan.id_chunk("turn", slice_turns), {"source": scan.last(F.col("origin"))}).where("late = 0")
    # a passage counts once as a whole, else by its lines
    by_source = found.where("source is not null").groupBy("conv_id", "turn", "mark", "level", "source").agg(F.sum("size").alias("size"), F.collect_set("place").alias("places"))
    chosen = by_source.groupBy("conv_id", "turn", "mark").agg(
        F.min_by("source", F.struct("level", -F.col("size"), -F.col("source"))).alias("quoted"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_linked"),
    )
    counted = quoting.select("conv_id", "turn", "mark", F.size("passages").cast("long").alias("n_quotes"))
    return counted.join(chosen, ["conv_id", "turn", "mark"], "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("bigint")))


def threads(steps: DataFrame, slice_turns: int = SLICE) -> DataFrame:
    """conv_id, turn, thread, reply_to from (conv_id, turn, quoted), one row a turn: thread is the turn that began it."""
    chunk = scan.id_chunk("turn", slice_turns)
    before = scan.running(steps, ["conv_id"], ["turn"], chunk, {"previous": scan.last(F.col("turn"))})
    # a turn begins a stretch if it is the first one or replies to another than the one before
    before = before.withColumn("head", F.when(F.col("previous").isNull() | (F.col("quoted") != F.col("previous")), F.col("turn")))
    steps = session.cut(scan.running(before, ["conv_id"], ["turn"], chunk, {"stretch": scan.last(F.col("head"))}, inclusive=True))
    jumps = steps.where("head is not null and quoted is not null").select("conv_id", F.col("turn").alias("stretch"), F.col("quoted"))
    at = steps.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("stretch").alias("up"))
    jumps = session.cut(jumps.join(at, (F.col("conv_id") == F.col("c")) & (F.col("quoted") == F.col("t"))).select("conv_id", "stretch", "up"))
    while True:
        further = jumps.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.col("up").alias("further"))
        doubled = jumps.join(further, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("s")), "left")
        doubled = session.cut(doubled.select("conv_id", "stretch", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        jumps = doubled.drop("moved")
        if doubled.where("moved").isEmpty():
            break
    roots = jumps.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.col("up").alias("root"))
    joined = steps.join(roots, (F.col("conv_id") == F.col("c")) & (F.col("stretch") == F.col("s")), "left")
    return joined.select("conv_id", "turn", F.coalesce("root", "stretch").alias("thread"), F.coalesce("quoted", "previous").alias("reply_to"))


def reply_order(conversations: DataFrame, slice_turns: int = SLICE) -> DataFrame:
    """Per message: conv_id, turn, role, text without quotes, reply_to, thread, position (from 1, by thread and turn), n_quotes, n_linked.

    Messages of one turn are one step of the conversation; the one of them that quotes the latest turn decides.
    Null texts quote nothing and stay null. Messages whose conv_id or turn is null keep their text, without quotes, and
    have no reply_to, thread and position. Rows may repeat; each gives a row. Other columns are not looked at.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").withColumn("mark", F.xxhash64("role", "text"))
    placed = rows.where("conv_id is not null and turn is not null")
    told = session.cut(links(placed, slice_turns))
    steps = placed.select("conv_id", "turn").distinct().join(told.groupBy("conv_id", "turn").agg(F.max("quoted").alias("quoted")), ["conv_id", "turn"], "left")
    found = threads(steps, slice_turns)
    joined = placed.join(found, ["conv_id", "turn"]).join(told.select("conv_id", "turn", "mark", "n_quotes", "n_linked"), ["conv_id", "turn", "mark"], "left")
    # repeated rows are told apart only so that they have an order
    joined = joined.withColumn("n", F.monotonically_increasing_id())
    chunk = F.struct("thread", scan.id_chunk("turn", slice_turns).alias("part"))
    ordered = scan.ranked(joined, ["conv_id"], ["thread", "turn", "mark", "n"], chunk, "position")
    none = F.lit(None).cast("bigint")
    lost = rows.where("conv_id is null or turn is null").select("*", none.alias("thread"), none.alias("reply_to"), none.alias("position"), *[F.when(F.col("text").rlike(_QUOTE), F.size(passages(F.col("text"))) if c == "n_quotes" else 0).cast("bigint").alias(c) for c in ("n_quotes", "n_linked")])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return ordered.unionByName(lost, allowMissingColumns=True).select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"), "reply_to", "thread", F.col("position").cast("bigint").alias("position"), zero("n_quotes"), zero("n_linked"))
