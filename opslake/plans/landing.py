"""Landing validation: every landed file against the contract in force, before anything uses it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake import session, vocab
from opslake.functions import contract as fn
from opslake.functions.fingerprint import dedup_key
from opslake.operators import alerts, signals, validate
from opslake.operators import contracts as rules
from opslake.plans import quarantine
from opslake.sources import landing
from opslake.store import Store

_SHAPE = ["arrival_id", "check", "column_name", "occurrences"]


@dataclass
class Verdict:
    arrivals: DataFrame
    findings: DataFrame
    missing: DataFrame


def run(
    spark: SparkSession, root: str, contracts: DataFrame, day: str, as_of: str,
    judged: DataFrame | None = None, since: str | None = None, moved: DataFrame | None = None,
) -> Verdict:
    """Judge the files below ``root`` that nobody has judged yet.

    ``contracts``: SPEC columns and ``version``, and with several versions of a feed
    ``effective_from``. A file is judged by the version that was in force when it came; its feed is
    found by the latest one. ``judged``: arrival_id and arrived_at of the files that were judged
    before; their contents are not read again. A file without a day in its name counts for ``day``.
    Files of ``day`` are missing once their window has closed. With ``since``, the time of the last run,
    those of all days are whose window has closed after it. ``moved``: arrival_id, key, size_bytes and
    arrived_at of judged files that have been set aside; they came, so they are neither missing nor new.
    Order of checks: name, window, columns, then values. Where the columns drifted, a fixed-width
    file's offsets mean nothing, so its values are not judged; delimited values are matched by name.
    """
    specs = contracts.withColumnRenamed("feed_id", "feed_name")
    feeds = _latest(specs).withColumn("is_active", F.lit(True))
    listed = landing.relative_key(landing.arrivals(spark, root), root)
    if moved is not None:
        here = ["arrival_id", "arrived_at"]
        listed = listed.unionByName(moved.join(listed.select(*here), here, "left_anti").select(*listed.columns))
    listed = listed.withColumn("listed", F.col("key"))
    listed = listed.withColumn("key", validate.without_number("key"))
    every = validate.attribute(validate.landed(listed), feeds)
    mask = feeds.select("feed_name", F.col("file_mask").alias("mask"))
    every = session.cut(
        every.join(mask, "feed_name", "left").withColumn(
            "day", F.coalesce(validate.file_day(validate.file_name(F.col("key")), F.col("mask")), F.lit(day).cast("date"))
        ).withColumn("key", F.col("listed")).drop("listed")
    )
    came = every if judged is None else every.join(judged.select("arrival_id", "arrived_at"), ["arrival_id", "arrived_at"], "left_anti")
    came = session.cut(_in_force(came, specs))
    too_late = validate.late(came).select("arrival_id", F.lit(True).alias("is_late"))
    headers = session.cut(_headers(spark, root, came))
    delimited, fixed = _fields(spark, root, _judgeable(came, headers), _width(headers))
    fields = delimited.select("arrival_id", "values", "columns").unionByName(fixed)
    # Lines of another length than their header are findings of their own and repeat nothing
    whole = delimited.filter(F.col("n_fields") == F.size("columns")).select("arrival_id", "values", "columns").unionByName(fixed)
    findings = session.cut(
        validate.mask_findings(came).unionByName(_column_findings(headers))
        .unionByName(validate.extra_files(every).join(came.select("arrival_id"), "arrival_id", "left_semi"))
        .unionByName(_json_findings(spark, root, came))
        # A cut fixed-width value cannot be too long, so the length rule is silent there by itself.
        .unionByName(validate.judged_fields(fields).select(*_SHAPE))
        .unionByName(validate.ragged_rows(delimited))
        .unionByName(_duplicates(whole))
    )
    verdicts = validate.verdicts(came.join(too_late, "arrival_id", "left"), findings)
    own, until = F.lit(day).cast("date"), F.lit(as_of).cast("date")
    before = F.lit(since).cast("date")
    expected = validate.expected_days(feeds, F.least(own, before), F.greatest(own, F.when(before.isNotNull(), until)))
    gone = validate.missing(expected, every.filter(F.col("feed_name").isNotNull()), F.lit(as_of).cast("timestamp"))
    if since is not None:
        gone = gone.filter(F.col("closes_at") > F.lit(since).cast("timestamp"))
    return Verdict(verdicts, findings, gone.select("feed_name", "day", "closes_at"))


def judge(store: Store, root: str, contracts: DataFrame, day: str, as_of: str, batch: int) -> Verdict:
    """Judge what the store does not know yet, and store the verdict: each file is judged, and raised for, once.

    The time of each run is stored, so the files of all windows that closed since the last run are
    looked for, whatever their day, and each missing one is said once.
    """
    held = {}

    def build(past: Store) -> dict[str, DataFrame]:
        last = past.current("landing_state").filter(F.col("root") == root).agg(F.max("judged_to").cast("string")).first()[0]
        held["verdict"] = run(store.spark, root, contracts, day, as_of, past.log("arrival"), last, quarantine.set_aside(past))
        done = store.spark.range(1).select(F.lit(root).alias("root"), F.greatest(F.lit(as_of).cast("timestamp"), F.lit(last).cast("timestamp")).alias("judged_to"))
        return {**rows_of(past, batch, as_of, held["verdict"]), "landing_state": done}

    store.transact("landing", batch, build)
    return held["verdict"]


def _latest(specs: DataFrame) -> DataFrame:
    values = [c for c in specs.columns if c != "feed_name"]
    last = specs.groupBy("feed_name").agg(F.max_by(F.struct(*values), "version").alias("s"))
    return last.select("feed_name", "s.*").select(*specs.columns)


def _in_force(came: DataFrame, specs: DataFrame) -> DataFrame:
    """Arrivals with version, window_end and columns of the contract that was in force when they came."""
    spec = specs.select("feed_name", "version", "window_end", "columns")
    if "effective_from" not in specs.columns:
        return came.join(spec, "feed_name", "left")
    mine = came.filter(F.col("feed_name").isNotNull()).select(F.col("feed_name").alias("feed_id"), "arrival_id", "arrived_at")
    versions = specs.select(F.col("feed_name").alias("feed_id"), "version", "effective_from")
    found = rules.version_in_force(mine, versions).select("arrival_id", "version")
    return came.join(found, "arrival_id", "left").join(spec, ["feed_name", "version"], "left")


def _json_findings(spark: SparkSession, root: str, came: DataFrame) -> DataFrame:
    mine = session.cut(
        came.filter(F.col("feed_name").isNotNull() & fn.is_json(F.col("key")) & F.col("columns").isNotNull())
        .select("arrival_id", F.transform("columns", lambda c: c["name"]).alias("declared"))
    )
    lines = session.lookup(landing.json_lines(spark, root), mine, "arrival_id", 2 * F.length("arrival_id") + 64 * F.size("declared"))
    return landing.json_structure(lines, F.col("declared")).select(*_SHAPE)


def rows_of(past: Store, batch: int, now: str, verdict: Verdict) -> dict[str, DataFrame]:
    """Arrivals, validations and alerts of a verdict, to be one batch on top of ``past``.

    Late and missing files raise one alert per feed, drifted columns another; the disposition says
    which files may go on and which are set aside.
    """
    at, seq = F.lit(now).cast("timestamp"), F.lit(batch).cast("bigint")
    came = session.cut(verdict.arrivals)
    drift = verdict.findings.filter(F.col("check").isin(vocab.V_RENAMED, vocab.V_ADDED, vocab.V_REMOVED))
    drifted = drift.select("arrival_id").distinct().join(came, "arrival_id")
    late = came.filter(F.coalesce("is_late", F.lit(False)))
    events = (
        signals.feed_events(verdict.missing, vocab.FEED_LATE, at, seq)
        .unionByName(signals.feed_events(late, vocab.FEED_LATE, at, seq))
        .unionByName(signals.feed_events(drifted, vocab.SCHEMA_DRIFT, at, seq))
    )
    judged = came.filter(F.col("version").isNotNull()).withColumn("ran_at", at)
    merged = alerts.merge(past.touched("alert", events), events)
    return {"arrival": came, "validation": judged, "alert": _routed(past, merged)}


def _routed(past: Store, merged: DataFrame) -> DataFrame:
    """Alerts of a feed go to the team that owns it; one that has a team keeps it."""
    kinds = F.explode(F.array(F.lit(vocab.FEED_LATE), F.lit(vocab.SCHEMA_DRIFT)))
    owners = past.current("feed").filter(F.col("team_id").isNotNull()).select("team_id", "feed_name", kinds.alias("of"))
    owners = owners.select("team_id", dedup_key(F.col("of"), F.col("feed_name")).alias("__key"))
    routed = merged.join(owners, F.col("dedup_key") == F.col("__key"), "left")
    return routed.withColumn("routed_to", F.coalesce("routed_to", "team_id")).select(*merged.columns)


def keep(store: Store, batch: int, now: str, verdict: Verdict) -> None:
    """Store a verdict as one batch."""
    store.transact("landing", batch, lambda past: rows_of(past, batch, now, verdict))


def _headers(spark: SparkSession, root: str, came: DataFrame) -> DataFrame:
    """arrival_id, header, declared. A file without a line has an empty header.

    Fixed-width names are cut to their width, so both sides are.
    """
    mine = came.filter(F.col("columns").isNotNull() & ~fn.is_json(F.col("key"))).select("arrival_id", "key", "columns")
    none = F.array().cast("array<string>")
    fixed = fn.is_fixed_width(F.col("key"))
    delimited = mine.filter(~fixed).join(landing.delimited_headers(spark, root), "arrival_id", "left").select(
        "arrival_id", F.coalesce("header", none).alias("header"), F.transform("columns", lambda c: c["name"]).alias("declared")
    )
    lines = (
        mine.filter(fixed).join(landing.fixed_width_headers(spark, root), "arrival_id", "left")
        .withColumn("sized", landing.with_offsets(F.col("columns")))
        .withColumn("declared", F.transform("sized", lambda c: landing.fit_name(c["name"], c["width"])))
        .withColumn("expected", F.array_join(F.transform("sized", lambda c: fn.fit(c["name"], c["width"])), ""))
        .withColumn("same", F.rtrim("header_line") == F.rtrim("expected"))
    )
    return delimited.unionByName(
        lines.select(
            "arrival_id",
            F.when(F.col("header_line").isNull(), none).when(F.col("same"), F.col("declared"))
            .otherwise(_walk_header()).alias("header"),
            "declared",
        )
    )


def _walk_header():
    """Names in a drifted fixed-width header.

    Field by field: where the next declared name stands, it is taken; else, if the one after it
    stands there, the declared one is gone; else the field is read at the declared width.
    """
    line, sized = F.col("header_line"), F.col("sized")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("i"))

    def step(acc, c):
        here = F.substring(line, acc["at"], c["width"])
        after = F.get(sized, acc["i"] + 1)
        next_here = F.substring(line, acc["at"], after["width"]) == fn.fit(after["name"], after["width"])
        gone = (here != fn.fit(c["name"], c["width"])) & F.coalesce(next_here, F.rtrim(here) == "")
        return F.struct(
            F.when(gone, acc["at"]).otherwise(acc["at"] + c["width"]).alias("at"),
            F.when(gone, acc["names"]).otherwise(F.array_append(acc["names"], F.rtrim(here))).alias("names"),
            (acc["i"] + 1).alias("i"),
        )

    walked = F.aggregate(sized, start, step)
    rest = F.rtrim(F.substring(line, walked["at"], F.length(line)))
    return F.when(rest != "", F.array_append(walked["names"], rest)).otherwise(walked["names"])


def _width(headers: DataFrame) -> int:
    """Fields of the widest file: the CSV reader wants its columns up front."""
    return headers.agg(F.coalesce(F.max(F.size("header")), F.lit(1))).first()[0]


def _column_findings(headers: DataFrame) -> DataFrame:
    return validate.schema_diff(headers).select(
        "arrival_id", "check", "column_name", F.lit(1).cast("bigint").alias("occurrences")
    )


def _judgeable(came: DataFrame, headers: DataFrame) -> DataFrame:
    """Files with the contract columns their values are judged by, in the order of the file."""
    kind = "struct<name:string,type:string,nullable:boolean,max_length:int>"
    by_name = lambda h: F.get(F.filter(F.col("columns"), lambda c: c["name"] == h), F.lit(0))
    unknown = lambda h: F.struct(
        h.alias("name"), F.lit("string").alias("type"), F.lit(True).alias("nullable"), F.lit(None).cast("int").alias("max_length")
    ).cast(kind)
    ordered = F.transform("header", lambda h: F.coalesce(by_name(h).cast(kind), unknown(h)))
    fixed = fn.is_fixed_width(F.col("key"))
    return (
        came.filter(F.col("columns").isNotNull()).select("arrival_id", "key", "columns")
        .join(headers, "arrival_id")
        .filter(~fixed | (F.col("header") == F.col("declared")))
        .select("arrival_id", F.when(fixed, F.col("columns").cast(f"array<{kind}>")).otherwise(ordered).alias("columns"))
    )


def _fields(spark: SparkSession, root: str, judgeable: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """arrival_id, values, columns of every data line of delimited (with n_fields) and of fixed-width files."""
    judgeable = session.cut(judgeable)
    row_bytes = 2 * F.length("arrival_id") + 128 * F.size("columns")
    delimited = session.lookup(
        landing.delimited_rows(spark, root, width), judgeable, "arrival_id", row_bytes
    ).withColumn("values", F.slice("values", F.lit(1), F.size("columns")))
    fixed = session.lookup(
        landing.fixed_width_lines(spark, root), judgeable, "arrival_id", row_bytes
    ).withColumn("values", landing.cut_fields(F.col("line"), landing.with_offsets(F.col("columns"))))
    return delimited, fixed.select("arrival_id", "values", "columns")


def _duplicates(fields: DataFrame) -> DataFrame:
    found = validate.duplicate_rows(fields, "arrival_id", ["arrival_id", "values"])
    return found.select(
        "arrival_id", F.lit(vocab.V_DUPLICATE).alias("check"), F.lit("").alias("column_name"),
        F.col("extra_rows").alias("occurrences"),
    )
