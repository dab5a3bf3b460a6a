"""Runs: normalise scheduler rows, fold step rows into executions, merge run lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions import fingerprint as fp
from opslake.functions import states, time
from opslake.operators import scan

RUN_COLUMNS = ["native_job_id", "native_run_id", "started_at", "ended_at", "status", "error_text"]


def fold_history(
    history: DataFrame, zone: str = "UTC", since: Column | None = None, chunk_rows: int = scan.CHUNK_ROWS
) -> DataFrame:
    """Agent history rows to one row per execution.

    A job's step rows belong to its next outcome row with a usable start. A failed execution takes
    the message of the last failed step before it, or its own when there is none or it is null.
    The last row that matters before an outcome is thus either a failed step or the previous usable
    outcome, which a single running "last marker" answers. ``since`` drops rows at or below a
    watermark. Rows: history plus the run columns and ``instance_id``.
    """
    if since is not None:
        history = history.filter(F.col("instance_id") > since)
    is_step = F.col("step_id") != 0
    usable = ~is_step & (F.col("run_date") > 0)
    failed_step = is_step & (F.col("run_status") == 0)
    marker = F.when(
        usable | failed_step,
        F.struct(F.when(failed_step, F.col("message")).alias("text")),
    )
    # Only failed steps and outcomes take part: other steps neither set nor clear the marker.
    rows = scan.running(
        history.filter(~is_step | failed_step).select(
            "instance_id", "job_id", "step_id", "run_status", "run_date", "run_time", "run_duration", "message"
        ),
        ["job_id"], ["instance_id"], scan.id_chunk("instance_id", chunk_rows),
        {"marker": scan.last(marker)},
    )
    started = time.packed_to_utc(F.col("run_date"), F.col("run_time"), zone)
    return (
        rows.filter((F.col("step_id") == 0) & (F.col("run_date") > 0))
        .withColumn("started_at", started)
        .withColumn("status", states.agent_status(F.col("run_status")))
        .select(
            F.lower("job_id").alias("native_job_id"),
            time.execution_key(F.col("job_id"), F.col("started_at")).alias("native_run_id"),
            "started_at",
            (F.col("started_at") + time.packed_interval(F.col("run_duration"))).alias("ended_at"),
            "status",
            F.when(
                F.col("status") == vocab.FAILED, F.coalesce(F.col("marker.text"), F.col("message"))
            ).alias("error_text"),
            "instance_id",
        )
        .filter(F.col("started_at").isNotNull())
    )


def history_watermark(history: DataFrame, watermark: Column) -> DataFrame:
    """New watermark: the last outcome row above the old one, usable start or not; else the old text."""
    since = time.history_position(watermark)
    seen = F.max(F.when(F.col("step_id") == 0, F.col("instance_id")))
    return history.agg(
        F.when(seen > since, seen.cast("string")).otherwise(watermark).alias("watermark")
    )


def read_position(history: DataFrame, since: int) -> DataFrame:
    """Where the next read has to start so that no pending step is lost.

    One watermark serves all jobs, so another job's outcome can overtake steps whose own outcome is
    still to come. As of the watermark, a job's steps after its last usable outcome are pending; the
    read starts before the lowest of them.
    """
    read = history.filter(F.col("instance_id") <= since)
    consumed = F.max(F.when((F.col("step_id") == 0) & (F.col("run_date") > 0), F.col("instance_id")))
    per_job = read.groupBy("job_id").agg(consumed.alias("consumed"))
    pending = read.filter(F.col("step_id") != 0).join(per_job, "job_id").filter(
        F.col("consumed").isNull() | (F.col("instance_id") > F.col("consumed"))
    )
    return pending.agg(F.coalesce(F.min("instance_id") - 1, F.lit(since)).cast("bigint").alias("read_from"))


def latest_session(activity: DataFrame, sessions: DataFrame) -> DataFrame:
    """Activity rows of the newest agent session only."""
    newest = sessions.agg(F.max("session_id").alias("newest"))
    return activity.filter(F.col("session_id") == newest.scalar())


def in_flight(activity: DataFrame, sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """Runs the newest session has started and not stopped."""
    started = time.local_to_utc(F.col("start_execution_date"), zone)
    return (
        latest_session(activity, sessions)
        .filter(F.col("start_execution_date").isNotNull() & F.col("stop_execution_date").isNull())
        .withColumn("started_at", started)
        .select(
            F.lower("job_id").alias("native_job_id"),
            time.execution_key(F.col("job_id"), F.col("started_at")).alias("native_run_id"),
            "started_at",
            F.lit(None).cast("timestamp").alias("ended_at"),
            F.lit(vocab.RUNNING).alias("status"),
            F.lit(None).cast("string").alias("error_text"),
        )
    )


def dag_runs_to_runs(dag_runs: DataFrame, poll_started: Column, keep: list[str] | None = None) -> DataFrame:
    """DAG runs to runs. Run ids are unique per DAG only, so the key carries the DAG id.

    ``keep`` names columns to pass on.
    """
    status = states.dag_state(F.col("state"))
    return dag_runs.select(
        F.col("dag_id").alias("native_job_id"),
        F.concat_ws(":", "dag_id", "dag_run_id").alias("native_run_id"),
        F.coalesce("start_date", "logical_date", "execution_date", poll_started).alias("started_at"),
        F.col("end_date").alias("ended_at"),
        status.alias("status"),
        F.when(
            status == vocab.FAILED,
            states.describe_dag_failure(F.col("dag_id"), F.col("run_type"), F.col("note")),
        ).alias("error_text"),
        *(keep or []),
    )


def resolve_jobs(runs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Attach the canonical job of the active binding; native ids compare without case.

    Should several bindings differ by case only, the smallest job counts, so that no run multiplies.
    """
    known = bindings.groupBy(F.lower("native_id").alias("__native")).agg(F.min("job_id").alias("job_id"))
    return runs.join(known, F.lower("native_job_id") == F.col("__native")).drop("__native")


def orphans(runs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Runs whose native job has no active binding."""
    known = bindings.select(F.lower("native_id").alias("__native"))
    return runs.join(known, F.lower("native_job_id") == F.col("__native"), "left_anti")


def orphan_report(orphan_runs: DataFrame, top: int = 10) -> DataFrame:
    """Orphan native ids with their run counts, lowest ids first, ``top`` of them as in the log line."""
    return (
        orphan_runs.groupBy(F.lower("native_job_id").alias("native_job_id"))
        .agg(F.count(F.lit(1)).alias("runs"))
        .orderBy("native_job_id")
        .limit(top)
    )


_REPORT = ["started_at", "ended_at", "status", "error_text"]


def with_fingerprint(runs: DataFrame) -> DataFrame:
    return runs.withColumn("fingerprint", fp.failure_fingerprint(F.col("status"), F.col("error_text")))


def merge_lifecycle(events: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """One row per run from its reports, in closed form.

    The first report opens the run. While the run has no end, a later terminal report replaces
    start, end, status and error; nothing touches a run that has ended. So, if the first report has
    no end, the first terminal report with an end decides; without one, the last terminal report;
    without one, the first report. ``seq`` orders the reports; a stored run takes part as the report
    with the lowest ``seq``. ``carry`` columns (job id) always come from the first report.

    One grouped aggregation, so it pre-aggregates before the shuffle.
    """
    return lifecycle_of(lifecycle_parts(events, keys, carry), keys, carry)


def lifecycle_parts(events: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """The reports that decide about each run; ``combine_parts`` adds up those of disjoint sets of reports."""
    report = F.struct("seq", *_REPORT)
    terminal = states.is_terminal(F.col("status"))
    ended = F.col("ended_at").isNotNull()
    return events.groupBy(*keys).agg(
        F.min_by(F.struct("seq", *(carry or []), *_REPORT), F.col("seq")).alias("first"),
        F.min_by(report, F.when(terminal & ended, F.col("seq"))).alias("closing"),
        F.max_by(report, F.when(terminal, F.col("seq"))).alias("last_terminal"),
        F.max("seq").alias("last_seq"),
        F.count(F.lit(1)).alias("reports"),
    )


def combine_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.min_by("first", "first.seq").alias("first"), F.min_by("closing", "closing.seq").alias("closing"),
        F.max_by("last_terminal", "last_terminal.seq").alias("last_terminal"),
        F.max("last_seq").alias("last_seq"), F.sum("reports").alias("reports"),
    )


def lifecycle_of(parts: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """The run rows that ``lifecycle_parts`` lead to."""
    chosen = lambda name: F.struct(*[F.col(f"{name}.{c}").alias(c) for c in _REPORT])
    known = lambda name: F.when(F.col(name).isNotNull(), chosen(name))
    state = F.when(F.col("first.ended_at").isNotNull(), chosen("first")).otherwise(
        F.coalesce(known("closing"), known("last_terminal"), chosen("first"))
    )
    return with_fingerprint(
        parts.withColumn("state", state).select(
            *keys, *[F.col(f"first.{c}").alias(c) for c in carry or []],
            *[F.col(f"state.{c}").alias(c) for c in _REPORT], "reports", "last_seq",
        )
    )


INSERTED, CLOSED, UNCHANGED = "Inserted", "Closed", "Unchanged"


def write_outcomes(events: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """What each report did: Inserted, Closed or Unchanged.

    A run is shut by its first report if that has an end, and by any terminal report with an end.
    A later report without terminal status never shuts it, so "shut before" is a running flag.
    """
    terminal = states.is_terminal(F.col("status"))
    ended = F.col("ended_at").isNotNull()
    # The first report and whether it had an end, as one number that orders by report.
    birth = F.col("seq") * 2 + ended.cast("int")
    step = scan.running(events, keys, ["seq"], chunk, {
        "earlier": scan.total(F.lit(1)),
        "shut": scan.high((terminal & ended).cast("int")),
        "birth": scan.low(birth),
    })
    is_open = (F.coalesce(F.col("shut"), F.lit(0)) == 0) & (F.pmod("birth", F.lit(2)) == 0)
    return (
        step.withColumn(
            "outcome",
            F.when(F.col("earlier") == 0, F.lit(INSERTED))
            .when(states.is_terminal(F.col("status")) & is_open, F.lit(CLOSED))
            .otherwise(F.lit(UNCHANGED)),
        )
        .select(*events.columns, "outcome")
    )


def timeline(runs: DataFrame, jobs: DataFrame, newest: int | None = None) -> DataFrame:
    """Runs with job names and durations, newest first."""
    named = runs.join(jobs.select("job_id", F.col("name").alias("job_name")), "job_id").withColumn(
        "duration_seconds", F.unix_seconds("ended_at") - F.unix_seconds("started_at")
    )
    if newest is None:
        return named
    return named.orderBy(F.col("started_at").desc(), F.col("native_run_id")).limit(newest)


def current_state(runs: DataFrame) -> DataFrame:
    """The latest run of every job."""
    place = F.struct("started_at", "native_run_id")
    row = F.struct("native_run_id", "started_at", "ended_at", "status")
    return (
        runs.groupBy("job_id")
        .agg(F.max_by(row, place).alias("latest"), F.count(F.lit(1)).alias("runs"))
        .select("job_id", "latest.*", "runs")
    )


def collisions(runs: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Runs that start while an earlier run of the same group is still going.

    Only the latest end among earlier starts matters, so no pairs are built. Runs without an end
    are taken as going on.
    """
    end = F.coalesce(F.col("ended_at"), F.lit("9999-12-31 00:00:00").cast("timestamp"))
    seen = scan.running(
        runs, keys, ["started_at", "native_run_id"], chunk, {"busy_until": scan.high(end)}
    )
    return seen.filter(F.col("busy_until") > F.col("started_at"))
