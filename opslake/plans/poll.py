"""One poll cycle of one source: what was collected goes into the store, in one commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake import session, vocab
from opslake.functions.fingerprint import dedup_key
from opslake.operators import alerts, catalog, health, runs, scan, signals
from opslake.plans import bindings as bindings_plan
from opslake.store import Store

RUN_KEY = ["source_id", "native_run_id"]
#: Versions that readers may still look at when old files are deleted, and how often that is looked for.
KEEP_VERSIONS = 64


@dataclass
class Collected:
    """What one poll brought: jobs, runs with ``seq`` (from 0, the order of reports), the new watermark.

    ``purged`` holds the purge gaps found in the source's history, if that was checked.
    """

    jobs: DataFrame
    runs: DataFrame
    watermark: str | None
    purged: DataFrame | None = None


@dataclass
class Result:
    ok: bool
    jobs: int = 0
    unowned: int = 0
    runs: int = 0
    inserted: int = 0
    closed: int = 0
    orphans: int = 0
    orphan_ids: tuple[str, ...] = ()
    error: str | None = None


def watermark(store: Store, source_id: int) -> str | None:
    row = store.current("source_state").filter(F.col("source_id") == source_id).select("watermark").first()
    return row.watermark if row else None


def writer(source_id: int) -> str:
    """By this name the store tells the batches of sources apart."""
    return f"source-{source_id}"


def register(store: Store, wanted: DataFrame, batch: int, writer: str = "registry") -> DataFrame:
    """Find or create sources (type, name, config) and store them; returns all sources with their ids.

    Workers that register at once agree: the one that comes second takes the ids from what the first left.
    """
    store.transact(writer, batch, lambda past: {"source": catalog.register_sources(past.current("source"), wanted)}, reads=("source",))
    return store.current("source")


def cycle(store: Store, source_id: int, source_name: str, batch: int, now: str, collect) -> Result:
    """Collect and persist.

    ``collect(watermark)`` gives a ``Collected``. If anything fails, the sync is stored as Failed and
    the watermark stays; alerts that the health checks raised before are kept. ``batch`` names the
    commit among those of the source: running a batch again replaces it. Other writers may commit in
    the meantime; where they changed a row that the poll writes, the poll merges again.
    """
    at = F.lit(now).cast("timestamp")
    held: dict = {}

    def collected(past: Store) -> tuple[Collected, DataFrame, DataFrame]:
        mark = watermark(past, source_id)
        if "got" not in held or held["mark"] != mark:
            got = collect(mark)
            held.update(mark=mark, got=(got, session.cut(got.jobs), session.cut(got.runs)))
        return held["got"]

    def build(past: Store) -> dict[str, DataFrame]:
        kept: dict[str, DataFrame] = {}
        try:
            got, jobs, reports = collected(past)
            job_count = jobs.count()
            raised = _health_events(past, source_id, source_name, job_count, batch, at, got.purged)
            if raised is not None:
                kept["alert"] = alerts.merge(past.touched("alert", raised), raised)
            tables, result = _merge(past, source_id, batch, at, jobs, reports, raised)
            result.jobs = job_count
            held["result"] = result
            return {**kept, **tables, **_sync(past, source_id, batch, at, vocab.COMPLETED, result, got.watermark)}
        except Exception as problem:  # noqa: BLE001 - whatever goes wrong is the result of the sync
            return failed(past, problem, kept)

    def failed(past: Store, problem: Exception, kept: dict[str, DataFrame]) -> dict[str, DataFrame]:
        held["result"] = Result(False, error=str(problem))
        return {**kept, **_sync(past, source_id, batch, at, vocab.FAILED, held["result"], None)}

    try:
        store.transact(writer(source_id), batch, build)
    except Exception as problem:  # noqa: BLE001 - rows that can't be written fail the sync too
        error = problem
        store.transact(writer(source_id), batch, lambda past: failed(past, error, {}))
    store.settle()
    if batch % KEEP_VERSIONS == 0:
        store.expire(KEEP_VERSIONS)
    return held["result"]


def _health_events(
    store: Store, source_id: int, name: str, job_count: int, batch: int, at: Column, purged: DataFrame | None
) -> DataFrame | None:
    """Alerts about this one sync; ``health`` has the same rules over a whole log of syncs."""
    raised = []
    if job_count == 0:
        raised.append((vocab.ZERO_ROWS, f"{name} returned 0 jobs: check permissions and configuration"))
    else:
        filled = (F.col("source_id") == source_id) & (F.col("status") == vocab.COMPLETED) & (F.col("job_count") > 0)
        latest = store.current("sync").filter(filled).orderBy(F.col("started_at").desc(), F.col("sync_id").desc())
        base = latest.limit(vocab.BASELINE_SYNCS).agg(
            F.count("job_count").alias("samples"), F.avg("job_count").alias("mean")
        ).first()
        if base.samples >= vocab.BASELINE_MIN_SAMPLES and job_count < base.mean * vocab.SHARP_DROP_FRACTION:
            raised.append((vocab.SHARP_DROP, f"{name} job count dropped from a baseline of {base.mean:.0f} to {job_count}"))
    if not raised and purged is None:
        return None
    seq = F.lit(batch).cast("bigint")
    events = store.spark.createDataFrame(raised, "type string, message string").select(
        dedup_key(F.col("type"), F.lit(source_id)).alias("dedup_key"), "type", F.lit(alerts.RAISE).alias("kind"),
        at.alias("at"), seq.alias("seq"), "message",
    )
    if purged is not None:
        lost = F.concat(F.lit(f"{name}: history purged past the watermark; up to "), F.col("missed"), F.lit(" rows missed"))
        events = events.unionByName(health.source_events(purged, vocab.PURGE_GAP, lost, at, seq))
    return events


def _merge(
    store: Store, source_id: int, batch: int, at: Column, jobs: DataFrame, reports: DataFrame, raised: DataFrame | None
) -> tuple[dict[str, DataFrame], Result]:
    owned = catalog.with_ownership(catalog.one_per_native_id(jobs.withColumn("source_id", F.lit(source_id))))
    known = store.current("job").filter(F.col("source_id") == source_id)
    merged = session.cut(catalog.merge_jobs(known, owned, at))
    ids = merged.select(F.lower("native_id").alias("native_key"), "job_id")
    ownership = owned.join(ids, F.lower("native_id") == F.col("native_key")).select(
        "source_id", "job_id", F.lit(batch).cast("bigint").alias("sync_id"), "team_id", "parsed_from", "raw_evidence"
    )

    bindings = merged.select("native_id", "job_id")
    bound = runs.resolve_jobs(reports, bindings).withColumn("source_id", F.lit(source_id))
    touched = store.touched("run", bound)
    shape = [*RUN_KEY, "job_id", "started_at", "ended_at", "status", "error_text", "seq"]
    stored = touched.withColumn("seq", F.lit(-1).cast("bigint")).select(*shape)
    events = session.cut(stored.unionByName(bound.select(*shape)))
    outcomes = runs.write_outcomes(events, RUN_KEY, scan.id_chunk(F.col("seq") + 1)).filter(F.col("seq") >= 0)
    counts = outcomes.agg(
        F.count_if(F.col("outcome") == runs.INSERTED).alias("inserted"),
        F.count_if(F.col("outcome") == runs.CLOSED).alias("closed"),
    ).first()
    lost = runs.orphans(reports, bindings)
    result = Result(
        True,
        unowned=owned.filter(F.col("team_id").isNull()).count(),
        runs=reports.count(),
        inserted=counts.inserted,
        closed=counts.closed,
        orphans=lost.select(F.count_distinct(F.lower("native_job_id"))).first()[0],
        orphan_ids=tuple(r.native_job_id for r in runs.orphan_report(lost).collect()),
    )
    seen = merged.filter(F.col("last_seen") == at)
    state = session.cut(runs.merge_lifecycle(events, RUN_KEY, ["job_id"]))
    found = bindings_plan.points(seen.filter(F.col("first_seen") == at), at)
    tables = {"job": seen, "binding": found, "ownership": ownership, "run": state}
    alert = _alerts(store, batch, state, touched, ownership, raised)
    return ({**tables, "alert": alert} if alert is not None else tables), result


def _alerts(
    store: Store, batch: int, state: DataFrame, before: DataFrame, ownership: DataFrame, raised: DataFrame | None
) -> DataFrame | None:
    """Next alert rows: one raise per run that this batch made a failure, under its root cause.

    A new alert goes to the team of the first job that failed so; one that has a team keeps it.
    """
    failed = F.col("status") == vocab.FAILED
    newly = session.cut(state.filter(failed).join(before.filter(failed).select(*RUN_KEY), RUN_KEY, "left_anti"))
    events = signals.failure_events(newly, F.lit(batch).cast("bigint"))
    if raised is not None:
        events = events.unionByName(raised)
    elif newly.isEmpty():
        return None
    owners = newly.join(ownership.select("job_id", "team_id"), "job_id").groupBy(
        dedup_key(F.lit(vocab.JOB_FAILED), F.col("fingerprint")).alias("__key")
    ).agg(F.min_by("team_id", F.when(F.col("team_id").isNotNull(), F.struct("started_at", "native_run_id"))).alias("__team"))
    merged = alerts.merge(store.touched("alert", events), events)
    routed = merged.join(owners, F.col("dedup_key") == F.col("__key"), "left")
    return routed.withColumn("routed_to", F.coalesce("routed_to", "__team")).select(*merged.columns)


def _sync(
    past: Store, source_id: int, batch: int, at: Column, status: str, result: Result, new_watermark: str | None
) -> dict[str, DataFrame]:
    """Sync row, heartbeat and watermark join the batch. Without a new watermark the old one stays."""
    one = past.spark.range(1)
    mark = F.lit(new_watermark if new_watermark is not None else watermark(past, source_id)).cast("string")
    sync = one.select(
        F.lit(batch).cast("bigint").alias("sync_id"), F.lit(source_id).alias("source_id"), at.alias("started_at"),
        at.alias("completed_at"), F.lit(status).alias("status"),
        F.lit(result.jobs).cast("bigint").alias("job_count"), F.lit(result.unowned).cast("bigint").alias("unowned_count"),
        F.lit(result.error).cast("string").alias("error_text"),
    )
    state = one.select(F.lit(source_id).alias("source_id"), mark.alias("watermark"), at.alias("last_heartbeat"))
    return {"sync": sync, "source_state": state}
