"""Owners harvested from free text, declared fields and tags."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions.fingerprint import is_ascii
from opslake.functions.states import is_blank

# Fixed values. Flags: ignore case, "$" stops at \n only, Unicode classes.
_VALUE = r"([^;,\r\n#@]+?)\s*(?:(?=[;,#@\r\n])|(?=\.\s)|\.?$)"
OWNER = r"(?idU)\b(?:owner|team)\s*[:=]\s*" + _VALUE
TICKET = r"(?idU)\bticket\s*[:=]\s*" + _VALUE
MENTION = r"(?U)(?<!\w)[#@]([A-Za-z][\w-]*)"


def _clean(value: Column) -> Column:
    """Outer blanks off, trailing periods and commas off, blanks off again."""
    return F.regexp_replace(value, r"(?U)\A\s+|\s*[.,]*\s*\z", "")


def _found(owner: Column, is_ticket: bool) -> Column:
    return F.struct(owner.alias("owner"), F.lit(is_ticket).alias("is_ticket"))


def parse_owner(text: Column) -> Column:
    """``struct<owner, is_ticket>``: a declaration, else a ticket, else a tag or mention, else null.

    The guards are ``rlike`` because a declaration may hold an empty owner, which still counts. Words
    and marks are looked for first: most long texts hold none of them.
    """
    low = F.lower(text)
    says = lambda *words: reduce(or_, [low.contains(w) for w in words], ~is_ascii(text))
    return (
        F.when(says("owner", "team") & text.rlike(OWNER), _found(_clean(F.regexp_extract(text, OWNER, 1)), False))
        .when(says("ticket") & text.rlike(TICKET), _found(_clean(F.regexp_extract(text, TICKET, 1)), True))
        .when((text.contains("#") | text.contains("@")) & text.rlike(MENTION), _found(F.regexp_extract(text, MENTION, 1), False))
    )


def evidence_text(description: Column) -> Column:
    """The description, or empty text where it is missing or a scheduler's placeholder."""
    bare = F.lower(F.regexp_replace(description, r"(?U)\A\s+|\s+\z", ""))
    empty = description.isNull() | (bare == vocab.PLACEHOLDER_DESCRIPTION.lower())
    return F.when(empty, F.lit("")).otherwise(description)


def first_tag_owner(tags: Column) -> Column:
    """``struct<hit, tag>`` of the first tag that parses, else null."""
    parsed = F.transform(tags, lambda tag: F.struct(parse_owner(tag).alias("hit"), tag.alias("tag")))
    return F.get(F.filter(parsed, lambda t: t["hit"].isNotNull()), F.lit(0))


def decide_ownership(declared: Column, text: Column, from_text: Column, from_tags: Column) -> Column:
    """``struct<team_id, parsed_from, raw_evidence>``: declared owner, description, first tag that parses."""
    def found(team: Column, source: Column, evidence: Column) -> Column:
        return F.struct(team.alias("team_id"), source.alias("parsed_from"), evidence.alias("raw_evidence"))

    trimmed = F.regexp_replace(declared, r"(?U)\A\s+|\s+\z", "")
    kind = F.when(from_text["is_ticket"], vocab.FROM_TICKET).otherwise(vocab.FROM_DESCRIPTION)
    return (
        F.when(~is_blank(declared), found(trimmed, F.lit(vocab.FROM_OWNER), declared))
        .when(from_text.isNotNull(), found(from_text["owner"], kind, text))
        .when(from_tags.isNotNull(), found(from_tags["hit"]["owner"], F.lit(vocab.FROM_TAGS), from_tags["tag"]))
        .otherwise(found(F.lit(None).cast("string"), F.lit(vocab.FROM_NONE), text))
    )


def declared_dag_owner(owners: Column) -> Column:
    """Declared owners of a DAG joined by comma; blanks and the scheduler's default are not owners."""
    real = F.filter(
        owners, lambda o: o.isNotNull() & ~is_blank(o) & (F.lower(o) != vocab.DEFAULT_DAG_OWNER)
    )
    names = F.transform(real, lambda o: F.regexp_replace(o, r"(?U)\A\s+|\s+\z", ""))
    return F.when(F.size(names) > 0, F.array_join(names, ", "))
