"""Error fingerprints: strip what varies from run to run, hash what is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions.states import is_blank

# Fixed value: dates, times, hex, numbers with a unit of at most two letters, quoted text.
VOLATILE = (
    r"\d{4}-\d{2}-\d{2}|\d{2}:\d{2}:\d{2}|0x[0-9a-fA-F]+"
    r"""|\b\d+(?:\.\d+)?[a-zA-Z]{0,2}\b|'[^']*'|"[^"]*\""""
)
# All alternatives begin with a digit or a quote, which is cheaper to look for than a word border.
_STRIP = r"""(?=[\d'"])(?:""" + VOLATILE + ")"
_BLANKS = r"\s+"
FINGERPRINT_LENGTH = 32

# upper() may turn one character into several (sharp s, ligatures, ...). Fingerprints need the
# one-to-one mapping, so these characters are set aside in the private-use area while upper() runs.
_MANY = [chr(c) for c in range(0x80, 0xFB18) if len(chr(c).upper()) > 1]
_ONE = [c.title() if len(c.title()) == 1 else c for c in _MANY]
# Where those characters lie, sharp s apart, in a few ranges that are quick to look for
_RARE = "[\u0149\u01f0\u0390\u03b0\u0587\u1e96-\u1e9a\u1f50-\u1ffc\ufb00-\ufb17]"
_ASIDE = "".join(chr(0xE000 + i) for i in range(len(_MANY)))


def simple_upper(text: Column) -> Column:
    """Upper case, character by character."""
    mark = _ASIDE[0]
    only_sharp_s = F.replace(F.upper(F.replace(text, F.lit("ß"), F.lit(mark))), F.lit(mark), F.lit("ß"))
    kept = F.translate(text, "".join(_MANY), _ASIDE)
    careful = F.translate(F.upper(kept), _ASIDE, "".join(_ONE))
    return F.when(text.rlike(_RARE), careful).when(text.contains("ß"), only_sharp_s).otherwise(F.upper(text))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def shape(error: Column) -> Column:
    """The part of an error text that repeats.

    Digits, blanks, word borders and case are Unicode's (``(?U)``); in ASCII text the plain classes
    mean the same and are faster.
    """
    strip = lambda flags: F.trim(
        F.regexp_replace(F.regexp_replace(error, flags + _STRIP, ""), flags + _BLANKS, " ")
    )
    return F.when(is_ascii(error), F.upper(strip(""))).otherwise(simple_upper(strip("(?U)")))


def fingerprint(error: Column) -> Column:
    return F.upper(F.substring(F.sha2(shape(error), 256), 1, FINGERPRINT_LENGTH))


def failure_fingerprint(status: Column, error: Column) -> Column:
    """Fingerprint of a failed run that has a text, else null."""
    return F.when((status == vocab.FAILED) & ~is_blank(error), fingerprint(error))


def dedup_key(*parts: Column) -> Column:
    """Alert identity. A missing part counts as empty text, it does not shift the others."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.upper(F.sha2(F.concat_ws("|", *texts), 256))
