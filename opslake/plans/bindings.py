"""Bindings with two times: since when a native id means a job, and since when we know.

The store keeps change points and never rewrites one: from ``valid_from`` on a native id of a source is
bound to a job (or to none), as recorded at ``recorded_at``. What was believed at some time is the points
recorded by then; among points of one moment the last recorded counts. A point holds until the next one
of its native id, so a command that comes late changes the past up to the next change and no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake import session
from opslake.operators import catalog
from opslake.store import Store

NATIVE = ["source_id", "native_key"]
POINT = [*NATIVE, "valid_from", "recorded_at", "native_id", "job_id", "command_id"]
DONE, REFUSED = "Done", "Refused"


def points(jobs: DataFrame, at: Column) -> DataFrame:
    """Change points of jobs (source_id, native_id, job_id, bound_at), recorded at ``at``."""
    return jobs.select(
        "source_id", F.lower("native_id").alias("native_key"), F.col("bound_at").alias("valid_from"), at.alias("recorded_at"),
        "native_id", "job_id", F.lit(None).cast("string").alias("command_id"),
    )


def believed(facts: DataFrame, recorded: Column | None = None) -> DataFrame:
    """source_id, native_id, job_id, bound_at, unbound_at: the bindings as they were known at a time, or are now."""
    known = facts if recorded is None else facts.filter(F.col("recorded_at") <= recorded)
    rest = F.struct("recorded_at", "native_id", "job_id")
    last = known.groupBy(*NATIVE, "valid_from").agg(F.max_by(rest, F.col("recorded_at")).alias("p"))
    until = F.lead("valid_from").over(Window.partitionBy(*NATIVE).orderBy("valid_from"))
    spans = last.select("source_id", "p.native_id", "p.job_id", F.col("valid_from").alias("bound_at"), until.alias("unbound_at"))
    return spans.filter(F.col("job_id").isNotNull())


def bound_runs(store: Store, runs: DataFrame, recorded: Column | None = None) -> DataFrame:
    """Runs with the job that their native id meant when they started, as known at ``recorded`` or now."""
    return catalog.bound_at_start(runs, believed(store.current("binding"), recorded))


def rebind(store: Store, commands: DataFrame, batch: int, now: str, writer: str = "commands") -> DataFrame:
    """Carry out deliberate rebinds; returns the log rows of these commands.

    ``commands``: command_id, job_id, source_id, native_id, native_name, at, who. A command is carried out
    once, whenever and how often it is sent. It unbinds the native ids that mean the job at its time and
    binds the one that it names. It is refused if its time is to come, or if the native id then means a
    job that no command of this batch moves. Of several commands for a job or a native id the first by
    id counts, the others are refused. Every command is logged with who gave it, and what became of it.
    """
    at = F.lit(now).cast("timestamp")
    given = session.cut(commands.dropDuplicates(["command_id"]).withColumn("native_key", F.lower("native_id")))

    def build(past: Store) -> dict[str, DataFrame]:
        known = past.touched("command", given).select("command_id")
        fresh = session.cut(given.join(known, "command_id", "left_anti"))
        if fresh.isEmpty():  # all have been carried out or refused before
            return {}
        facts_now = session.cut(past.current("binding"))
        first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("command_id")) == 1
        ranked = fresh.withColumn("alone", first("job_id")).withColumn("alone", F.col("alone") & first("source_id", "native_key"))
        held = session.cut(believed(facts_now).withColumn("native_key", F.lower("native_id")))
        open_ = F.col("bound_at").isNotNull() & (F.col("at") >= F.col("bound_at")) & (F.col("unbound_at").isNull() | (F.col("at") < F.col("unbound_at")))
        holders = ranked.join(held.select(*NATIVE, F.col("job_id").alias("holder"), "bound_at", "unbound_at"), NATIVE).filter(open_)
        vacates = ranked.filter("alone").select(F.col("job_id").alias("mover"), F.col("at").alias("moved_at"))
        goes = (F.col("holder") == F.col("mover")) & (F.col("moved_at") >= F.col("bound_at")) & (F.col("moved_at") <= F.col("at"))
        stays = holders.filter(F.col("holder") != F.col("job_id")).join(vacates, goes, "left_anti")
        stays = stays.select("command_id", F.lit(True).alias("taken")).distinct()
        judged = ranked.join(stays, "command_id", "left").withColumn(
            "outcome", F.when(F.col("alone") & F.col("taken").isNull() & (F.col("at") <= at), DONE).otherwise(REFUSED)
        )
        judged = session.cut(judged)
        done = judged.filter(F.col("outcome") == DONE)
        target = done.select(
            *NATIVE, F.col("at").alias("valid_from"), at.alias("recorded_at"), "native_id", "job_id", "command_id"
        )
        moves = done.select("job_id", "at", "command_id", F.col("source_id").alias("to_source"), F.col("native_key").alias("to_key"))
        left = held.join(moves, "job_id").filter(open_ & ~((F.col("source_id") == F.col("to_source")) & (F.col("native_key") == F.col("to_key"))))
        closed = left.select(
            *NATIVE, F.col("at").alias("valid_from"), at.alias("recorded_at"), "native_id", F.lit(None).cast("string").alias("job_id"), "command_id"
        )
        # a native id that one command leaves and another one takes at the same moment is taken
        closed = closed.join(target.select(*NATIVE, "valid_from"), [*NATIVE, "valid_from"], "left_anti")
        # where the job has a later binding, the new one ends with it, if it lasts that long
        ends = held.join(done.select("job_id", "at"), "job_id").filter(F.col("bound_at") > F.col("at")).groupBy("job_id").agg(F.min("bound_at").alias("end"))
        changes = facts_now.select(*NATIVE, F.col("valid_from").alias("then"))
        until = target.join(ends, "job_id").join(changes, NATIVE, "left").groupBy(*target.columns, "end").agg(
            F.min(F.when(F.col("then") > F.col("valid_from"), F.col("then"))).alias("next")
        )
        ended = until.filter(F.col("next").isNull() | (F.col("next") > F.col("end"))).withColumns({"valid_from": F.col("end"), "job_id": F.lit(None).cast("string")})
        facts = session.cut(target.select(*POINT).unionByName(closed.select(*POINT)).unionByName(ended.select(*POINT)))
        log = judged.select("command_id", "job_id", "source_id", "native_id", "native_name", "at", "who", at.alias("recorded_at"), "outcome")
        return {"command": log, "binding": facts, "job": _jobs(past, facts_now, facts, done, at)}

    store.transact(writer, batch, build, reads=("binding",))
    return store.touched("command", given)


def _jobs(past: Store, facts_now: DataFrame, facts: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """Catalogue rows that follow from change points, where these are the last ones of their native id."""
    last = facts.groupBy(*NATIVE).agg(F.max_by(F.struct("valid_from", "native_id", "job_id"), F.col("valid_from")).alias("p")).select(*NATIVE, "p.*")
    later = facts_now.select(*NATIVE, F.col("valid_from").alias("then"))
    overtaken = last.join(later, NATIVE).filter(F.col("then") > F.col("valid_from")).select(*NATIVE).distinct()
    names = done.select(*NATIVE, "native_name")
    had = past.touched("job", facts.select("source_id", "native_id")).select(
        "source_id", F.lower("native_id").alias("native_key"), F.col("job_id").alias("old_id"), "name", "first_seen", "last_seen"
    )
    rows = last.join(overtaken, NATIVE, "left_anti").join(names, NATIVE, "left").join(had, NATIVE, "left")
    return rows.select(
        "source_id", "native_id", F.coalesce("job_id", "old_id").alias("job_id"), F.coalesce("native_name", "name").alias("name"),
        F.col("job_id").isNotNull().alias("is_active"), F.coalesce("first_seen", at).alias("first_seen"), F.coalesce("last_seen", at).alias("last_seen"),
        F.col("valid_from").alias("bound_at"),
    )
