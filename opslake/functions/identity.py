"""Canonical job ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE32 = "0123456789abcdefghijklmnopqrstuv"
# Fixed value: Crockford's alphabet
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def canonical_job_id(source_id: Column, native_id: Column, first_seen: Column) -> Column:
    """26 characters shaped like a ULID: 10 for the first-seen millisecond, 16 for the native id.

    Derived from its inputs, so a task that runs twice mints the same id.
    """
    digest = F.sha2(F.concat_ws("|", source_id.cast("string"), F.lower(native_id)), 256)

    def piece(hexadecimal: Column, width: int) -> Column:
        return F.lpad(F.lower(F.conv(hexadecimal, 16, 32)), width, "0")

    stamp = F.lpad(F.lower(F.conv(F.unix_millis(first_seen).cast("string"), 10, 32)), 10, "0")
    text = F.concat(stamp, piece(F.substring(digest, 1, 10), 8), piece(F.substring(digest, 11, 10), 8))
    return F.translate(text, _BASE32, _CROCKFORD)
