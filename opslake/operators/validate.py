"""Checks of landed files against their contracts. Findings are metadata only, never row contents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions import contract as fn

FINDING = ["arrival_id", "check", "column_name", "occurrences"]


# ---- which feed a file belongs to ------------------------------------------------------------


def _prefix_lengths(feeds: DataFrame) -> Column:
    """The lengths that landing prefixes have; a prefix holds at most 500 characters."""
    return feeds.agg(F.collect_set(F.length("landing_prefix")).alias("lengths")).scalar()


def name_parts(mask: Column) -> tuple[Column, Column]:
    """What a mask has before and after its date token."""
    at = F.locate(vocab.DATE_TOKEN, mask)
    head = F.when(at > 0, F.substring(mask, F.lit(1), at - 1)).otherwise(mask)
    tail = F.when(at > 0, F.substring(mask, at + len(vocab.DATE_TOKEN), F.length(mask))).otherwise(F.lit(""))
    return head, tail


# How a name may meet a mask: around a date, as a whole, or only by its prefix; ~ is without case.
_DATE, _DATE_LOOSE, _NAME, _NAME_LOOSE, _PREFIX = "date", "date~", "name", "name~", "prefix"
_FITS = {
    (_DATE, "d8"): "exact", (_DATE, "d10"): "date_format", (_DATE_LOOSE, "d8"): "case", (_DATE_LOOSE, "d10"): "case_and_date",
    (_NAME, ""): "exact", (_NAME_LOOSE, ""): "case",
}


def _key(how: str, head: Column, tail: Column, date: str = "") -> Column:
    if how.endswith("~"):
        head, tail = F.lower(head), F.lower(tail)
    return F.struct(F.lit(how).alias("how"), head.alias("head"), tail.alias("tail"), F.lit(date).alias("date"))


_WINDOWS = "array<struct<head:string,tail:string,date:string>>"


def _windows(name: Column, parts: Column, count: Column, width: int, pattern: str, date: str) -> Column:
    """What stands around each place of a name where a date of the pattern may stand.

    ``parts`` is the name split at dates that touch no other digit, ``count`` the number of all its
    dates. Nearly every name has one, and it touches none; only other names are searched place by place.
    """
    window = lambda h, t: F.struct(h.alias("head"), t.alias("tail"), F.lit(date).alias("date"))
    places = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(name) - width + 1, F.lit(1))),
        lambda i: F.substring(name, i, F.lit(width)).rlike(rf"\A{pattern}\z"),
    )
    every = F.transform(
        places, lambda i: window(F.substring(name, F.lit(1), i - 1), F.substring(name, i + width, F.length(name)))
    )
    one = F.array(window(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    return F.when(count == 0, F.array().cast(_WINDOWS)).when((count == 1) & (F.size(parts) == 2), one).otherwise(every)


def _with_name_keys(placed: DataFrame) -> DataFrame:
    """One row per arrival, prefix and lookup key ``__k``; a row without prefix has the prefix key only."""
    dates = {"d8": (8, "[0-9]{8}"), "d10": (10, "[0-9]{4}-[0-9]{2}-[0-9]{2}")}
    name, none = F.col("__name"), F.lit("")
    rows = placed.withColumn("__name", F.when(F.col("__known").isNotNull(), file_name(F.col("key"))).otherwise(none))
    found = []
    for date, (width, pattern) in dates.items():
        rows = rows.withColumns({
            f"__parts_{date}": F.split(name, rf"(?<![0-9]){pattern}(?![0-9])", -1),
            f"__count_{date}": F.regexp_count(name, F.lit(pattern)),
        })
        found.append(_windows(name, F.col(f"__parts_{date}"), F.col(f"__count_{date}"), width, pattern, date))
    whole = F.struct(name.alias("head"), none.alias("tail"), none.alias("date"))
    rows = rows.withColumn("__w", F.explode_outer(F.concat(*found, F.array(whole))))
    dated = F.col("__w.date") != ""
    head, tail, date = F.col("__w.head"), F.col("__w.tail"), F.col("__w.date")
    key = lambda how, h, t: F.struct(how.alias("how"), h.alias("head"), t.alias("tail"), date.alias("date"))
    exact = key(F.when(dated, _DATE).otherwise(_NAME), head, tail)
    loose = key(F.when(dated, _DATE_LOOSE).otherwise(_NAME_LOOSE), F.lower(head), F.lower(tail))
    prefix = key(F.lit(_PREFIX), none, none)
    keys = F.when(name == "", F.array(prefix)).when(dated, F.array(exact, loose)).otherwise(F.array(exact, loose, prefix))
    drop = ["__name", "__w", *[f"__{what}_{d}" for what in ("parts", "count") for d in dates]]
    return rows.withColumn("__k", F.explode_outer(keys)).drop(*drop)


def mask_keys(feeds: DataFrame) -> DataFrame:
    """One feed per prefix and key: the last by name where several say the same."""
    head, tail = name_parts(F.col("file_mask"))
    dated = F.locate(vocab.DATE_TOKEN, F.col("file_mask")) > 0
    none = F.lit("")
    keys = F.concat(
        F.when(dated, F.array(_key(_DATE, head, tail), _key(_DATE_LOOSE, head, tail))).otherwise(
            F.array(_key(_NAME, head, none), _key(_NAME_LOOSE, head, none))
        ),
        F.array(_key(_PREFIX, none, none)),
    )
    return (
        feeds.select("landing_prefix", "feed_name", "file_mask", F.explode(keys).alias("k"))
        .groupBy("landing_prefix", "k.how", "k.head", "k.tail")
        .agg(F.max_by(F.struct("feed_name", "file_mask"), "feed_name").alias("f"))
        .select("landing_prefix", "how", "head", "tail", "f.*")
    )


def ambiguous_masks(feeds: DataFrame) -> DataFrame:
    """landing_prefix, mask and feeds (by name) that no file name can tell apart: same prefix, same mask but for case.

    ``attribute`` gives a file of these to the last of them by name, and the others are missing theirs.
    """
    same = feeds.groupBy("landing_prefix", F.lower("file_mask").alias("mask"))
    return same.agg(F.array_sort(F.collect_set("feed_name")).alias("feeds")).filter(F.size("feeds") > 1)


def file_name(key: Column) -> Column:
    return F.regexp_extract(key, r"([^/]*)\z", 1)


def file_day(name: Column, mask: Column) -> Column:
    """Day in a file name, in either date form."""
    head, tail = name_parts(mask)
    middle = F.substring(name, F.length(head) + 1, F.length(name) - F.length(head) - F.length(tail))
    return F.coalesce(
        F.try_to_date(middle, "yyyyMMdd"), F.try_to_date(middle, "yyyy-MM-dd")
    )


def landed(arrivals: DataFrame) -> DataFrame:
    """Without files whose name says they are still to come."""
    return arrivals.filter(~F.col("key").endswith(vocab.LATE_SUFFIX))


def attribute(arrivals: DataFrame, feeds: DataFrame) -> DataFrame:
    """Attach to each arrival its feed and how its name fits the mask.

    A feed qualifies if its landing prefix starts the key. Among those a fitting mask wins, then the
    longer prefix, then the feed name; ``feed_name`` is null where no feed qualifies. ``name_fit`` is
    exact, date_format, case, case_and_date, or null. Prefixes are found by cutting the key at every
    length a prefix can have, masks by what stands around the date in the name; both are lookups of
    unique keys, so the number of feeds that share a prefix does not matter.
    """
    pieces = F.transform(
        F.array_union(F.filter(F.col("__lengths"), lambda n: n <= F.length("key")), F.array(F.lit(0))),
        lambda n: F.substring(F.col("key"), F.lit(1), n),
    )
    prefixes = feeds.select(F.col("landing_prefix").alias("__known")).distinct()
    # Outer, as Spark tests the arrays of a plain explode for emptiness, which these never are. The
    # empty piece is kept without a match, and with it every arrival.
    placed = (
        arrivals.withColumn("__lengths", _prefix_lengths(feeds))
        .withColumn("__piece", F.explode_outer(pieces)).drop("__lengths")
        .join(prefixes, F.col("__piece") == F.col("__known"), "left")
        .filter(F.col("__known").isNotNull() | (F.col("__piece") == ""))
    )
    known = mask_keys(feeds)
    candidates = (
        _with_name_keys(placed).join(
            known,
            (F.col("__known") == known["landing_prefix"]) & (F.col("__k.how") == known["how"])
            & (F.col("__k.head") == known["head"]) & (F.col("__k.tail") == known["tail"]),
            "left",
        )
        .filter(F.col("feed_name").isNotNull() | (F.col("__k.how") == _PREFIX))
    )
    fit = F.lit(None).cast("string")
    for (how, date), name in _FITS.items():
        fit = F.when((F.col("__k.how") == how) & (F.col("__k.date") == date), name).otherwise(fit)
    candidates = candidates.withColumn("name_fit", fit)
    strength = F.when(F.col("name_fit") == "exact", 3).when(F.col("name_fit").isNotNull(), 2).otherwise(1)
    order = F.struct(
        strength.alias("s"), F.length("__piece").alias("l"), F.col("feed_name").alias("f"),
        (~F.col("__k.how").endswith("~")).alias("same_case"),
    )
    # The rows of one arrival lie side by side, so this adds up before the shuffle.
    best = candidates.groupBy("arrival_id").agg(
        F.any_value(F.struct(*arrivals.columns)).alias("a"),
        F.max_by(F.struct("feed_name", "file_mask", "name_fit"), F.when(F.col("feed_name").isNotNull(), order)).alias("b"),
    )
    return best.select("a.*", "b.*")


def mask_findings(attributed: DataFrame) -> DataFrame:
    """Mask drift: the file is the feed's, its name is not quite."""
    return attributed.filter(F.col("feed_name").isNotNull() & (F.coalesce("name_fit", F.lit("none")) != "exact")).select(
        "arrival_id", F.lit(vocab.V_MASK).alias("check"), F.coalesce("name_fit", F.lit("none")).alias("column_name"),
        F.lit(1).cast("bigint").alias("occurrences"),
    )


def without_number(key: Column) -> Column:
    """A key without the number that tells several files of one day apart: it follows the date in the name."""
    return F.regexp_replace(key, r"(\d{8}|\d{4}-\d{2}-\d{2})_\d{1,3}(\.[^./]*)?\z", "$1$2")


def extra_files(came: DataFrame) -> DataFrame:
    """Files of a feed and day beyond the first one that came. Needs arrival_id, feed_name, day, arrived_at."""
    place = F.struct("arrived_at", "arrival_id")
    mine = came.filter(F.col("feed_name").isNotNull())
    first = mine.groupBy("feed_name", "day").agg(F.min(place).alias("f")).select("f.arrival_id")
    return mine.join(first, "arrival_id", "left_anti").select(
        "arrival_id", F.lit(vocab.V_EXTRA).alias("check"), F.lit("").alias("column_name"),
        F.lit(1).cast("bigint").alias("occurrences"),
    )


def ragged_rows(fields: DataFrame) -> DataFrame:
    """Lines with more or fewer fields than their file's header, by file. Needs arrival_id, n_fields, columns."""
    counted = fields.filter(F.col("n_fields") != F.size("columns")).groupBy("arrival_id").agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.select("arrival_id", F.lit(vocab.V_RAGGED).alias("check"), F.lit("").alias("column_name"), "occurrences")


# ---- when files come ---------------------------------------------------------------------------


def late(arrivals: DataFrame) -> DataFrame:
    """Arrivals after their window closed. Needs day, window_end, arrived_at."""
    closes = fn.window_close(F.col("day"), F.col("window_end"))
    return arrivals.withColumn("closes_at", closes).filter(F.col("arrived_at") > F.col("closes_at"))


def expected_days(feeds: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Feeds by days: what should arrive. Only active feeds expect files."""
    days = F.explode(F.sequence(first_day, last_day, F.expr("INTERVAL 1 DAY")))
    return feeds.filter(F.col("is_active")).withColumn("day", days)


def missing(expected: DataFrame, arrivals: DataFrame, as_of: Column) -> DataFrame:
    """Expected files that are not there although their window has closed by ``as_of``."""
    came = arrivals.select("feed_name", "day").distinct()
    closes = fn.window_close(F.col("day"), F.col("window_end"))
    return expected.withColumn("closes_at", closes).filter(F.col("closes_at") <= as_of).join(
        came, ["feed_name", "day"], "left_anti"
    )


# ---- what columns they have --------------------------------------------------------------------


def schema_diff(headers: DataFrame) -> DataFrame:
    """Columns added to, removed from or renamed in files.

    ``headers``: arrival_id, header array<string>, declared array<string>. A removed and an added
    column at the same position, or with the same drift form, are one rename. Everything happens
    inside a row: a header is as long as its contract.
    """
    positions = lambda names: F.transform(
        names, lambda n, i: F.struct(n.alias("name"), i.alias("at"), fn.drift_form(n).alias("form"))
    )
    removed = F.filter(positions(F.col("declared")), lambda c: ~F.array_contains(F.col("header"), c["name"]))
    added = F.filter(positions(F.col("header")), lambda c: ~F.array_contains(F.col("declared"), c["name"]))

    def partner(c: Column) -> Column:
        by_form = F.filter(F.col("__added"), lambda a: a["form"] == c["form"])
        unclaimed = lambda a: ~F.exists(F.col("__removed"), lambda r: r["form"] == a["form"])
        by_place = F.filter(F.col("__added"), lambda a: (a["at"] == c["at"]) & unclaimed(a))
        # Same place counts only where the header kept its length: else later columns have moved.
        by_place = F.when(F.size("header") == F.size("declared"), by_place)
        return F.coalesce(F.get(by_form, F.lit(0)), F.get(by_place, F.lit(0)))

    paired = F.transform(
        F.col("__removed"), lambda c: F.struct(c["name"].alias("name"), partner(c)["name"].alias("became"))
    )
    renamed_to = F.transform(F.filter(F.col("__pairs"), lambda p: p["became"].isNotNull()), lambda p: p["became"])
    kind = lambda k, c, d: F.struct(F.lit(k).alias("check"), c.alias("column_name"), d.alias("detail"))
    nothing = F.lit(None).cast("string")
    findings = F.concat(
        F.transform(
            F.col("__pairs"),
            lambda p: F.when(p["became"].isNotNull(), kind(vocab.V_RENAMED, p["name"], p["became"])).otherwise(
                kind(vocab.V_REMOVED, p["name"], nothing)
            ),
        ),
        F.transform(
            F.filter(F.col("__added"), lambda a: ~F.array_contains(F.col("__renamed"), a["name"])),
            lambda a: kind(vocab.V_ADDED, a["name"], nothing),
        ),
    )
    return (
        headers.withColumn("__removed", removed).withColumn("__added", added)
        .withColumn("__pairs", paired).withColumn("__renamed", renamed_to)
        .select("arrival_id", F.explode(findings).alias("f")).select("arrival_id", "f.*")
    )


# ---- what values they hold ---------------------------------------------------------------------


def value_findings(rows: DataFrame, spec: list[dict], by: str = "arrival_id") -> DataFrame:
    """NULLs in NOT NULL columns, values of the wrong type, over-long values: counts per file.

    ``spec``: name, type, nullable, max_length of each column of ``rows``. One aggregation over all
    columns at once; the counts are then turned into rows, one per file and broken rule.
    """
    counts, labels = [], []
    for i, c in enumerate(spec):
        value = F.col(f"`{c['name']}`")
        checks = []
        if not c.get("nullable", True):
            checks.append((vocab.V_NULL, value.isNull()))
        if c["type"] in vocab.TYPE_WIDTH:
            checks.append((vocab.V_TYPE, fn.wrong_type(value, F.lit(c["type"]))))
        if c.get("max_length"):
            checks.append((vocab.V_LENGTH, F.coalesce(F.length(value) > c["max_length"], F.lit(False))))
        for check, bad in checks:
            alias = f"__{len(labels)}"
            counts.append(F.count_if(bad).alias(alias))
            labels.append(
                F.struct(F.lit(check).alias("check"), F.lit(c["name"]).alias("column_name"), F.col(alias).alias("occurrences"))
            )
    counted = rows.groupBy(by).agg(*counts)
    return (
        counted.select(by, F.explode(F.array(*labels)).alias("f")).select(by, "f.*").filter(F.col("occurrences") > 0)
    )


def field_findings(fields: DataFrame, contracts: DataFrame) -> DataFrame:
    """The same counts for files of many schemas at once.

    ``fields``: arrival_id, schema_key, values array<string>; ``contracts``: schema_key, columns.
    """
    return judged_fields(fields.join(contracts.select("schema_key", "columns"), "schema_key"))


def judged_fields(fields: DataFrame) -> DataFrame:
    """Judge rows (arrival_id, values, columns) cell by cell.

    Only cells that break a rule go on, and their counts add up before the shuffle.
    """
    c, v = F.col("c"), F.col("v")
    rules = {
        vocab.V_NULL: ~F.coalesce(c["nullable"], F.lit(False)) & v.isNull(),
        vocab.V_TYPE: fn.wrong_type(v, c["type"]),
        vocab.V_LENGTH: F.coalesce(F.length(v) > F.nullif(c["max_length"], F.lit(0)), F.lit(False)),
    }
    cells = fields.select("arrival_id", "values", F.posexplode("columns").alias("at", "c")).select(
        "arrival_id", "c", F.get("values", F.col("at")).alias("v")
    )
    counted = (
        cells.filter(reduce(or_, rules.values()))
        .groupBy("arrival_id", c["name"].alias("column_name"))
        .agg(*[F.count_if(bad).alias(check) for check, bad in rules.items()])
    )
    each = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("occurrences")) for k in rules])
    return (
        counted.select("arrival_id", "column_name", F.explode(each).alias("f"))
        .select("arrival_id", "f.check", "column_name", "f.occurrences").filter(F.col("occurrences") > 0)
    )


def duplicate_rows(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Rows of a file that repeat an earlier one in every column: how many, and of how many kinds.

    Rows are told apart by the SHA-256 of their values, nulls and column borders included, so 32
    bytes a row are shuffled whatever its width, and a hot file spreads over all tasks.
    """
    identity = F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    counted = rows.select(by, identity.alias("__row")).groupBy(by, "__row").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.filter(F.col("n") > 1)
        .groupBy(by)
        .agg(F.sum(F.col("n") - 1).cast("bigint").alias("extra_rows"), F.count(F.lit(1)).alias("repeated_kinds"))
    )


# ---- the verdict -------------------------------------------------------------------------------


def verdicts(arrivals: DataFrame, findings: DataFrame) -> DataFrame:
    """Result, disposition and findings document of each arrival, pinned to its contract version.

    ``arrivals``: arrival_id, feed_name, version, is_late. No version in force is an Error. One
    finding per check and column, so a document is as long as the contract, not as the file.
    """
    document = findings.groupBy("arrival_id").agg(
        F.sort_array(F.collect_list(F.struct("check", "column_name", "occurrences"))).alias("findings")
    )
    judged = arrivals.join(document, "arrival_id", "left")
    result = (
        F.when(F.col("version").isNull(), vocab.ERROR)
        .when(F.col("findings").isNotNull(), vocab.FAILED)
        .otherwise(vocab.PASSED)
    )
    disposition = (
        F.when(result == vocab.ERROR, vocab.PENDING)
        .when(result == vocab.FAILED, vocab.QUARANTINED)
        .when(F.coalesce("is_late", F.lit(False)), vocab.LATE)
        .otherwise(vocab.VALIDATED)
    )
    return judged.withColumn("result", result).withColumn("disposition", disposition)


def quarantine(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arrivals that may go on, arrivals set aside)."""
    aside = F.col("disposition") == vocab.QUARANTINED
    return judged.filter(~aside), judged.filter(aside)


def violation_report(findings: DataFrame, arrivals: DataFrame) -> DataFrame:
    """What to send to a carrier: violations by feed, day and check."""
    return (
        findings.join(arrivals.select("arrival_id", "feed_name", "day"), "arrival_id")
        .groupBy("feed_name", "day", "check")
        .agg(
            F.sum("occurrences").cast("bigint").alias("occurrences"),
            F.count_distinct("arrival_id").alias("files"),
        )
    )
