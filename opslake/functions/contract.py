"""Contract documents as columns: canonical text, hash, rules, file masks, widths.

A spec is a struct or a set of columns: feed_id, owner, landing_prefix, file_mask, window_start and
window_end (seconds since midnight), schema_name, columns array<struct<name,type,nullable,max_length>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions.states import is_blank


def clock_text(seconds: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600).cast("int"),
        (F.floor(seconds / 60) % 60).cast("int"),
        (seconds % 60).cast("int"),
    )


def clock_seconds(text: Column) -> Column:
    """``HH:mm`` or ``HH:mm:ss`` to seconds since midnight, else null."""
    pattern = r"\A([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?\z"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("int"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def canonical_json(spec: dict[str, Column]) -> Column:
    """One fixed text per contract: property order fixed, missing values written as null."""
    columns = F.transform(
        spec["columns"],
        lambda c: F.struct(
            c["name"].alias("Name"), c["type"].alias("Type"), c["nullable"].alias("Nullable"),
            c["max_length"].alias("MaxLength"),
        ),
    )
    body = F.struct(
        spec["feed_id"].alias("FeedId"),
        spec["owner"].alias("Owner"),
        spec["landing_prefix"].alias("LandingPrefix"),
        spec["file_mask"].alias("FileMask"),
        F.struct(
            clock_text(spec["window_start"]).alias("Start"), clock_text(spec["window_end"]).alias("End")
        ).alias("ArrivalWindow"),
        F.struct(spec["schema_name"].alias("Name"), columns.alias("Columns")).alias("Schema"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def spec_hash(json: Column) -> Column:
    return F.upper(F.sha2(json, 256))


def rule_error(spec: dict[str, Column]) -> Column:
    """Message of the first rule a contract breaks, null for a good contract. The texts are fixed values."""
    feed = F.concat(F.lit("feed '"), spec["feed_id"], F.lit("': "))

    def message(text: str) -> Column:
        return F.concat(feed, F.lit(text))

    bad = F.get(F.filter(spec["columns"], lambda c: is_blank(c["name"]) | is_blank(c["type"])), F.lit(0))
    column_error = F.when(is_blank(bad["name"]), message("a column is missing a name")).otherwise(
        F.concat(feed, F.lit("column '"), bad["name"], F.lit("' is missing a type"))
    )
    start = F.coalesce(spec["window_start"], F.lit(0))
    end = F.coalesce(spec["window_end"], F.lit(0))
    return (
        F.when(is_blank(spec["feed_id"]), F.lit("feedId is required"))
        .when(is_blank(spec["owner"]), message("owner is required"))
        .when(is_blank(spec["landing_prefix"]), message("landingPrefix is required"))
        .when(is_blank(spec["file_mask"]), message("fileMask is required"))
        .when(start >= end, message("arrival window start must be before end"))
        .when(is_blank(spec["schema_name"]), message("schema name is required"))
        .when(F.coalesce(F.size(spec["columns"]), F.lit(0)) <= 0, message("schema must declare at least one column"))
        .when(bad.isNotNull(), column_error)
    )


def expected_name(mask: Column, day: Column) -> Column:
    """File name a mask asks for on a day."""
    return F.replace(mask, F.lit(vocab.DATE_TOKEN), F.date_format(day, "yyyyMMdd"))


def window_close(day: Column, window_end: Column) -> Column:
    """Instant from which a feed's file for ``day`` is late."""
    return day.cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), window_end.cast("decimal(18,6)")
    )


def is_fixed_width(mask: Column) -> Column:
    return F.lower(mask).endswith(".txt")


def is_json(mask: Column) -> Column:
    return F.lower(mask).endswith(".json")


def field_width(kind: Column, max_length: Column) -> Column:
    width = F.coalesce(max_length, F.lit(vocab.DEFAULT_WIDTH))
    for name, fixed in vocab.TYPE_WIDTH.items():
        width = F.when(kind == name, F.lit(fixed)).otherwise(width)
    return width


def fit(value: Column, width: Column | int) -> Column:
    """Pad with blanks or cut to the width; missing is all blanks."""
    return F.rpad(F.coalesce(value, F.lit("")), width, F.lit(" ") if isinstance(width, Column) else " ")


def wrong_type(value: Column, kind: Column) -> Column:
    """True where a present value does not read as its declared type. Unknown types never fail here."""
    as_date = value.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & value.try_cast("date").isNotNull()
    as_decimal = value.try_cast("decimal(38,10)").isNotNull()
    as_int = value.rlike(r"\A\s*[+-]?\d+\s*\z") & value.try_cast("bigint").isNotNull()
    bad = (
        F.when(kind == "date", ~as_date).when(kind == "decimal", ~as_decimal).when(kind == "int", ~as_int)
        .otherwise(F.lit(False))
    )
    return value.isNotNull() & bad


def drift_form(name: Column) -> Column:
    """What stays of a column name under the drifts carriers make: case, underscores, a New suffix."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "_", ""), r"new\z", "")
