"""Poll cycles against the store, the sweep, the timers, and pages."""

import datetime as dt
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from opslake import schemas, vocab
from opslake.functions.fingerprint import dedup_key
from opslake.operators import catalog, runs
from opslake.plans import collect, poll, sweep
from opslake.sources import landing, scheduler
from opslake.store import Store
from opslake.streaming import cycles, timers
from opslake.streaming.changes import ChangeLog, start

T0 = dt.datetime(2026, 9, 3, 2, 0)
RUN = schemas.RUN + ", seq bigint"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def batch(spark, jobs, reports, mark):
    job_rows = [(n, name, d, True, None, [], None, None) for n, name, d in jobs]
    report_rows = [(*r, i) for i, r in enumerate(reports)]
    return poll.Collected(spark.createDataFrame(job_rows, schemas.JOB), spark.createDataFrame(report_rows, RUN), mark)


def test_first_sync(spark, store):
    collected = batch(
        spark, [("job-a", "Nightly load", "Owner: ETL; Ticket: DE-1"), ("job-b", "Claims load", "See wiki.")],
        [("job-a", "run-1", T0, T0 + dt.timedelta(minutes=3), "Failed", "Could not find file '/landing/x_20260903.csv'"),
         ("JOB-B", "run-2", T0 + dt.timedelta(minutes=1), None, "Running", None)], "42",
    )
    result = poll.cycle(store, 7, "fake", 1, "2026-09-03 02:05:00", lambda _: collected)
    assert result.ok, result.error
    assert (result.jobs, result.unowned, result.runs, result.inserted, result.closed, result.orphans) == (2, 1, 2, 2, 0, 0)
    state = store.current("source_state").first()
    assert (state.watermark, state.last_heartbeat) == ("42", dt.datetime(2026, 9, 3, 2, 5))
    jobs = store.current("job").collect()
    assert len(jobs) == 2 and all(len(j.job_id) == 26 for j in jobs)
    owners = {r.native_id: (r.team_id, r.parsed_from) for r in store.current("ownership").join(store.current("job"), "job_id").collect()}
    assert owners == {"job-a": ("ETL", "Description"), "job-b": (None, "None")}
    got = {r.native_run_id: r for r in store.current("run").collect()}
    assert got["run-1"].status == "Failed" and len(got["run-1"].fingerprint) == 32
    assert (got["run-2"].status, got["run-2"].ended_at, got["run-2"].fingerprint) == ("Running", None, None)
    sync = store.current("sync").first()
    assert (sync.status, sync.job_count, sync.unowned_count) == ("Completed", 2, 1) and sync.completed_at is not None


def test_second_sync_closes_the_open_run_and_keeps_identity(spark, store):
    seen = []

    def collect(status, end):
        def inner(mark):
            seen.append(mark)
            return batch(spark, [("job-a", "Nightly load", "Owner: ETL")], [("job-a", "run-1", T0, end, status, None)], "1" if mark is None else "2")
        return inner

    assert poll.cycle(store, 7, "fake", 1, "2026-09-03 02:05:00", collect("Running", None)).inserted == 1
    first = store.current("job").first()
    end = T0 + dt.timedelta(minutes=5)
    again = poll.cycle(store, 7, "fake", 2, "2026-09-03 02:06:00", collect("Succeeded", end))
    assert (again.inserted, again.closed) == (0, 1)
    assert seen == [None, "1"] and poll.watermark(store, 7) == "2"
    job = store.current("job").first()
    assert (job.job_id, job.bound_at) == (first.job_id, first.bound_at) and job.last_seen > first.last_seen
    assert store.current("ownership").count() == 2
    run = store.current("run").first()
    assert (run.status, run.ended_at) == ("Succeeded", end)
    # A closed run is never rewritten, and a batch that runs twice leaves the same store.
    for _ in range(2):
        late = poll.cycle(store, 7, "fake", 3, "2026-09-03 02:07:00", collect("Failed", end))
        assert (late.inserted, late.closed) == (0, 0)
    assert [r.status for r in store.current("run").collect()] == ["Succeeded"]
    assert store.compact() == 2
    assert [r.status for r in store.current("run").collect()] == ["Succeeded"] and store.committed()[0].batch == 2
    before = sorted(map(str, store.current("ownership").collect()))
    assert store.expire() == 1 and store.expire() == 0
    assert sorted(map(str, store.current("ownership").collect())) == before
    assert poll.cycle(store, 7, "fake", 5, "2026-09-03 02:08:00", collect("Failed", end)).closed == 0


def test_empty_source_alerts_and_failed_sync_keeps_the_watermark(spark, store):
    empty = lambda _: batch(spark, [], [], "7")
    assert poll.cycle(store, 7, "fake", 1, "2026-09-03 02:05:00", empty).ok
    assert poll.cycle(store, 7, "fake", 2, "2026-09-03 02:06:00", empty).ok
    alert = store.current("alert").collect()
    assert [(a.type, a.status, a.occurrences) for a in alert] == [(vocab.ZERO_ROWS, vocab.FIRING, 2)]
    assert alert[0].dedup_key == spark.range(1).select(dedup_key(F.lit(vocab.ZERO_ROWS), F.lit("7"))).first()[0]

    def broken(_):
        raise RuntimeError("msdb said no")

    failed = poll.cycle(store, 7, "fake", 3, "2026-09-03 02:07:00", broken)
    assert (failed.ok, failed.error) == (False, "msdb said no")
    assert poll.watermark(store, 7) == "7"
    last = store.current("sync").orderBy(F.col("sync_id").desc()).first()
    assert (last.status, last.error_text) == (vocab.FAILED, "msdb said no")


def test_failures_are_raised_once_and_routed(spark, store):
    def collect(status):
        end = T0 + dt.timedelta(minutes=5) if status != "Running" else None
        got = batch(spark, [("job-a", "Load", "Owner: ETL"), ("job-b", "Other", "none")], [("job-a", "r1", T0, end, status, "Login failed for user 'x'")], "1")
        return lambda _: got

    poll.cycle(store, 7, "fake", 1, "2026-09-03 02:05:00", collect("Running"))
    assert store.current("alert").isEmpty()
    for n in (2, 3, 3):
        assert poll.cycle(store, 7, "fake", n, f"2026-09-03 02:0{n + 4}:00", collect("Failed")).ok
    (alert,) = store.current("alert").collect()
    assert (alert.type, alert.status, alert.occurrences, alert.routed_to) == (vocab.JOB_FAILED, vocab.FIRING, 1, "ETL")
    assert [r.completed_at for r in store.current("sync").filter("sync_id = 3").collect()] == [dt.datetime(2026, 9, 3, 2, 7)]


def test_ids_that_differ_by_case_are_one_job(spark, store):
    got = batch(spark, [("Load", "a", "Owner: ETL"), ("load", "b", "Owner: ETL")], [("LOAD", "r1", T0, None, "Running", None)], "1")
    result = poll.cycle(store, 7, "fake", 1, "2026-09-03 02:05:00", lambda _: got)
    assert result.ok and [store.current(t).count() for t in ("job", "ownership", "run")] == [1, 1, 1]


def test_a_replay_that_dies_changes_nothing(spark, store):
    rows = spark.createDataFrame([(1, "10", T0)], schemas.TABLES["source_state"][1])
    names = spark.createDataFrame([(1, "t", "n", "c")], schemas.TABLES["source"][1])
    store.commit(1, {"source": names, "source_state": rows})
    broken = rows.withColumn("watermark", F.raise_error(F.lit("dies")).cast("string"))
    with pytest.raises(Exception, match="dies"):
        store.commit(1, {"source": names.withColumn("name", F.lit("new")), "source_state": broken})
    assert store.current("source").first().name == "n" and store.current("source_state").first().watermark == "10"
    store.commit(1, {"source": names.withColumn("name", F.lit("new")), "source_state": rows})
    assert store.current("source").first().name == "new" and len(store.committed()) == 1


def test_unknown_job_is_skipped(spark, store):
    collected = batch(spark, [("job-a", "n", "")], [("deleted-job", "run-9", T0, T0, "Succeeded", None)], None)
    result = poll.cycle(store, 7, "fake", 1, "2026-09-03 02:05:00", lambda _: collected)
    assert result.ok and result.orphans == 1 and result.orphan_ids == ("deleted-job",) and store.current("run").count() == 0


def test_sharp_drop_between_cycles(spark, store):
    for n, count in enumerate([8, 8, 8, 3], start=1):
        jobs = [(f"job-{k}", "n", "") for k in range(count)]
        assert poll.cycle(store, 7, "fake", n, f"2026-09-03 02:0{n}:00", lambda _, j=jobs: batch(spark, j, [], None)).ok
    assert [(a.type, a.message) for a in store.current("alert").collect()] == [(vocab.SHARP_DROP, "fake job count dropped from a baseline of 8 to 3")]


AGENT = {
    "sysjobs": [("A", "load A", 1, "Owner: LPDE"), ("B", "load B", 1, None)],
    "sysjobservers": [("A", 0, 20260903, 20000), ("B", 1, 20260903, 1)],
    "sysjobactivity": [("A", 1, T0, None, None), ("B", 2, T0 + dt.timedelta(hours=1), None, T0 + dt.timedelta(days=1))],
    "syssessions": [(1,), (2,)],
}
STEP = lambda i, job, text: (i, job, 1, "s", 0, 20260903, 30000, 5, text)
OUTCOME = lambda i, job, status, clock: (i, job, 0, "(outcome)", status, 20260903, clock, 10, f"job {job} ended")


def export(spark, root, history):
    for name, rows in {**AGENT, "sysjobhistory": history}.items():
        spark.createDataFrame(rows, scheduler.AGENT_TABLES[name]).write.mode("overwrite").parquet(f"{root}/{name}")


def test_agent_cycles_pair_runs_and_lose_no_step(spark, store, tmp_path):
    root = str(tmp_path / "agent")
    read = collect.agent(spark, root, 7)
    # A's step comes before B's outcome, A's own outcome only with the next poll.
    export(spark, root, [STEP(10, "A", "disk full"), OUTCOME(11, "B", 1, 20000)])
    first = poll.cycle(store, 7, "agent", 1, "2026-09-03 03:10:00", read)
    assert first.ok, first.error
    assert (first.jobs, first.inserted, first.closed) == (2, 2, 0) and poll.watermark(store, 7) == "11"
    open_run = store.current("run").filter("ended_at is null").first()
    assert (open_run.native_run_id, open_run.status) == ("b:20260903030000", "Running")
    export(spark, root, [STEP(10, "A", "disk full"), OUTCOME(11, "B", 1, 20000), OUTCOME(12, "A", 0, 30000), OUTCOME(13, "B", 3, 30000)])
    second = poll.cycle(store, 7, "agent", 2, "2026-09-03 03:11:00", read)
    assert (second.inserted, second.closed) == (1, 1) and poll.watermark(store, 7) == "13"
    got = {r.native_run_id: (r.status, r.error_text) for r in store.current("run").collect()}
    assert got == {
        "a:20260903030000": ("Failed", "disk full"), "b:20260903020000": ("Succeeded", None), "b:20260903030000": ("Cancelled", None),
    }
    (failure,) = store.current("alert").collect()
    assert (failure.type, failure.status, failure.occurrences, failure.routed_to) == (vocab.JOB_FAILED, vocab.FIRING, 1, "LPDE")
    export(spark, root, [OUTCOME(40, "A", 1, 40000)])
    assert poll.cycle(store, 7, "agent", 3, "2026-09-03 04:10:00", read).ok
    (gap,) = store.current("alert").filter(F.col("type") == vocab.PURGE_GAP).collect()
    assert "26 rows missed" in gap.message


def test_dag_cycles(spark, store, tmp_path):
    dag = {"dag_id": "d", "owners": ["data-eng"], "tags": []}
    runs_of = lambda **kw: {"dag_runs": [{"dag_id": "d", "dag_run_id": "r", "run_type": "manual", **kw}], "total_entries": 1}
    for place, page in (("dags", {"dags": [dag], "total_entries": 1}), ("runs", runs_of(state="queued", execution_date="2026-09-03T01:00:00Z"))):
        (tmp_path / place).mkdir()
        (tmp_path / place / "1.json").write_text(json.dumps(page))
    read = lambda at: collect.dags(spark, str(tmp_path / "dags"), str(tmp_path / "runs"), at)
    assert poll.cycle(store, 8, "flow", 1, "2026-09-03 02:00:00", read("2026-09-03 02:00:00")).inserted == 1
    done = runs_of(state="failed", start_date="2026-09-03T01:30:00Z", end_date="2026-09-03T02:30:00Z", updated_at="2026-09-03T02:30:01Z")
    (tmp_path / "runs" / "1.json").write_text(json.dumps(done))
    assert poll.cycle(store, 8, "flow", 2, "2026-09-03 03:00:00", read("2026-09-03 03:00:00")).closed == 1
    run = store.current("run").first()
    assert (run.native_run_id, run.status, run.started_at) == ("d:r", "Failed", dt.datetime(2026, 9, 3, 1, 30))
    assert run.error_text == "Airflow DAG d run failed (manual)" and poll.watermark(store, 8) == "2026-09-03 03:00:00"
    # Not updated since the last poll: not read again. A short listing fails the sync.
    assert poll.cycle(store, 8, "flow", 3, "2026-09-03 04:00:00", read("2026-09-03 04:00:00")).runs == 0
    (tmp_path / "dags" / "1.json").write_text(json.dumps({"dags": [dag], "total_entries": 2}))
    failed = poll.cycle(store, 8, "flow", 4, "2026-09-03 05:00:00", read("2026-09-03 05:00:00"))
    assert failed.error == "DAG listing is incomplete" and poll.watermark(store, 8) == "2026-09-03 04:00:00"


def test_arrivals_as_a_stream(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x y.csv").write_text("h\n1\n")
    log = ChangeLog(str(tmp_path / "out"), ["arrival_id"])
    start(landing.arrival_stream(spark, str(tmp_path / "in")), log.write, str(tmp_path / "checkpoint"), "append").awaitTermination()
    row = log.latest(spark).first()
    assert row.key.endswith("/a/x y.csv") and row.size_bytes == 4


def test_cycles_from_a_stream(spark, store, tmp_path):
    minute = lambda n: T0 + dt.timedelta(minutes=n)
    pieces = [
        [("job-a", "r1", minute(0), None, "Running", None), ("job-b", "r2", minute(1), minute(2), "Failed", "boom 1")],
        [("JOB-A", "r1", minute(0), minute(5), "Succeeded", None), ("job-b", "r2", minute(1), minute(9), "Succeeded", None)],
        [("job-a", "r1", minute(0), minute(7), "Failed", "late"), ("job-a", "r3", minute(6), None, "Queued", None)],
    ]
    schema = RUN + ", reported_at timestamp"
    for n, piece in enumerate(pieces):
        rows = [(*r, 10 * n + k, minute(10 * n)) for k, r in enumerate(piece)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs = batch(spark, [("job-a", "A", "Owner: ETL"), ("job-b", "B", "")], [], None).jobs
    reports = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start(reports, cycles.cycle_sink(store, 7, "flow", lambda: jobs), str(tmp_path / "checkpoint"), "append").awaitTermination()
    got = {r.native_run_id: (r.status, r.ended_at) for r in store.current("run").collect()}
    assert got == {"r1": ("Succeeded", minute(5)), "r2": ("Failed", minute(2)), "r3": ("Queued", None)}
    assert store.current("sync").count() == 3 and store.current("ownership").count() == 6


def test_two_sources_write_to_one_store(spark, store):
    def collect(status, batch_no, name):
        end = T0 + dt.timedelta(minutes=5) if status != "Running" else None
        rows = [(f"job-{name}", f"r-{name}", T0, end, status, "Login failed for user 'x'")]
        return lambda _: batch(spark, [(f"job-{name}", f"Load {name}", f"Owner: {name}")], rows, f"{name}{batch_no}")

    failed = []

    def work(source, name):
        try:
            mine = Store(spark, store.root)
            for n, status in ((1, "Running"), (2, "Failed")):
                assert poll.cycle(mine, source, name, n, f"2026-09-03 02:0{n + 4}:00", collect(status, n, name)).ok
        except Exception as problem:  # noqa: BLE001
            failed.append(problem)

    threads = [threading.Thread(target=work, args=(k, n)) for k, n in ((7, "x"), (8, "y"))]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed
    assert {(r.source_id, r.status) for r in store.current("run").collect()} == {(7, "Failed"), (8, "Failed")}
    assert {(r.source_id, r.sync_id) for r in store.current("sync").collect()} == {(7, 1), (7, 2), (8, 1), (8, 2)}
    assert [poll.watermark(store, k) for k in (7, 8)] == ["x2", "y2"] and store.current("job").count() == 2
    (alert,) = store.current("alert").collect()  # both failures have one root cause
    assert (alert.type, alert.occurrences) == (vocab.JOB_FAILED, 2) and alert.routed_to in ("x", "y")


def test_sources_are_registered_and_swept(spark, store):
    wanted = lambda *names: spark.createDataFrame([("SQLAgent", n, "{}") for n in names], "type string, name string, config string")
    first = {r.name: r.source_id for r in poll.register(store, wanted("b", "a"), 1).collect()}
    again = {r.name: r.source_id for r in poll.register(store, wanted("a", "c"), 2, "other").collect()}
    assert first == {"a": 1, "b": 2} and again == {"a": 1, "b": 2, "c": 3}
    assert poll.cycle(store, 1, "a", 1, "2026-09-03 02:05:00", lambda _: batch(spark, [("j", "n", "")], [], None)).ok
    swept = sweep.sweep(store, 1, "2026-09-03 02:06:00", 120).collect()
    assert sorted(a.message.split()[0] for a in swept) == ["b", "c"]


def test_sweep_raises_and_resolves(spark, store):
    sources = [(n, "SQLAgent", name, "{}") for n, name in ((1, "old"), (2, "never"), (3, "fresh"))]
    beats = [(1, None, T0 - dt.timedelta(minutes=10)), (3, None, T0 - dt.timedelta(seconds=30))]
    store.commit(1, {
        "source": spark.createDataFrame(sources, schemas.TABLES["source"][1]),
        "source_state": spark.createDataFrame(beats, schemas.TABLES["source_state"][1]),
    })
    first = sweep.sweep(store, 2, str(T0), 120)
    assert {(a.message.split()[0], a.status) for a in first.collect()} == {("old", "Firing"), ("never", "Firing")}
    store.commit(3, {"source_state": spark.createDataFrame([(1, None, T0)], schemas.TABLES["source_state"][1])})
    second = sweep.sweep(store, 4, str(T0 + dt.timedelta(seconds=10)), 120)
    assert {(a.message.split()[0], a.status, a.occurrences) for a in second.collect()} == {("old", "Resolved", 1), ("never", "Firing", 2)}


def test_pages(spark, tmp_path):
    dag = lambda n: {"dag_id": f"d{n}", "owners": ["airflow", " ops "], "tags": [{"name": "team:etl"}], "is_paused": n == 1}
    for name, dags, total in (("1.json", [dag(0), dag(1)], 3), ("2.json", [dag(2)], 3)):
        (tmp_path / name).write_text(json.dumps({"dags": dags, "total_entries": total}, indent=1))
    pages = scheduler.dag_pages(spark, str(tmp_path))
    assert scheduler.completeness(pages).first().complete
    jobs = {r.native_id: r for r in catalog.dag_jobs(scheduler.items(pages)).collect()}
    assert sorted(jobs) == ["d0", "d1", "d2"] and not jobs["d1"].is_active and jobs["d0"].is_active
    assert jobs["d0"].declared_owner == "ops" and jobs["d0"].native_name == "d0"
    (tmp_path / "2.json").unlink()
    short = scheduler.completeness(scheduler.dag_pages(spark, str(tmp_path))).first()
    assert not short.complete and (short.landed, short.announced) == (2, 3)
    (tmp_path / "1.json").write_text("gateway timeout")
    assert not scheduler.completeness(scheduler.dag_pages(spark, str(tmp_path))).first().complete


def test_dag_run_pages(spark, tmp_path):
    run = {"dag_id": "d", "dag_run_id": "r", "state": "failed", "run_type": "manual", "start_date": "2026-09-03T02:00:00+00:00",
           "end_date": None, "note": None, "execution_date": "2026-09-03T01:00:00+02:00"}
    (tmp_path / "1.json").write_text(json.dumps({"dag_runs": [run], "total_entries": 1}))
    items = scheduler.items(scheduler.dag_run_pages(spark, str(tmp_path)))
    got = runs.dag_runs_to_runs(items, F.lit(T0)).first()
    assert (got.native_run_id, got.started_at, got.ended_at, got.status) == ("d:r", T0, None, "Failed")
    assert got.error_text == "Airflow DAG d run failed (manual)"


def drain(frame, tmp_path, enough, seconds=60):
    """Run a stream with processing-time triggers until its rows are ``enough``."""
    spark = frame.sparkSession
    log = ChangeLog(str(tmp_path / "out"), ["key"])
    query = start(frame, log.write, str(tmp_path / "checkpoint"), "append", processingTime="1 second")
    try:
        end = time.time() + seconds
        rows = []
        while time.time() < end:
            if query.exception():
                raise query.exception()
            time.sleep(1)
            try:
                rows = sorted(tuple(r) for r in log.read(spark).drop("batch").collect())
            except Exception:  # noqa: BLE001 - nothing written yet
                continue
            if enough(rows):
                break
        return rows
    finally:
        query.stop()


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_silent_source_is_raised_without_new_input(spark, tmp_path, rocksdb):
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    rows = [(1, now), (2, now + dt.timedelta(hours=1))]
    spark.createDataFrame(rows, "source_id bigint, at timestamp").write.parquet(str(tmp_path / "in"))
    beats = spark.readStream.schema("source_id bigint, at timestamp").parquet(str(tmp_path / "in"))
    got = drain(timers.stale_events(beats, 8), tmp_path, lambda r: len(r) >= 1)
    assert [(r[0], r[1]) for r in got] == [(1, "raise")]


def test_window_closes_without_a_file(spark, tmp_path, rocksdb):
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    soon, past = now + dt.timedelta(seconds=8), now - dt.timedelta(hours=1)
    schema = "feed_name string, day string, closes_at timestamp, arrived_at timestamp"
    rows = [("a", "d", soon, None), ("b", "d", soon, None), ("b", "d", None, now), ("c", "d", past, None), ("d", "d", past, None), ("d", "d", None, now)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = drain(timers.window_states(stream), tmp_path, lambda r: len(r) >= 4)
    assert [(r[0], r[2]) for r in got] == [("a", "missing"), ("b", "arrived"), ("c", "missing"), ("d", "late")]


def test_a_source_never_heard_becomes_an_alert(spark, store, tmp_path, rocksdb):
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    spark.createDataFrame([(1, now + dt.timedelta(hours=1))], "source_id bigint, at timestamp").write.parquet(str(tmp_path / "in"))
    beats = spark.readStream.schema("source_id bigint, at timestamp").parquet(str(tmp_path / "in"))
    registered = spark.createDataFrame([(1, now), (2, now), (3, now + dt.timedelta(hours=1))], "source_id int, at timestamp")
    said = timers.stale_events(beats, 4, registered)
    log = ChangeLog(str(tmp_path / "out"), ["source_id"])
    to_store = timers.alert_sink(store, "heartbeats", timers.stale_alerts)

    def both(rows, batch_id):
        log.write(rows, batch_id)
        to_store(rows, batch_id)
        to_store(rows, batch_id)  # as after a failure

    query = start(said, both, str(tmp_path / "checkpoint"), "append", processingTime="1 second")
    try:
        end = time.time() + 90
        while time.time() < end and query.isActive and not store.committed():
            time.sleep(1)
    finally:
        query.stop()
    (alert,) = store.current("alert").collect()
    assert (alert.type, alert.status, alert.occurrences) == (vocab.STALE, vocab.FIRING, 1) and alert.message.startswith("source 2 ")


def test_the_calendar_is_awaited_and_forgotten(spark, tmp_path, rocksdb):
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    calendar = [("a", "d", now + dt.timedelta(seconds=3)), ("b", "d", now + dt.timedelta(hours=1)), ("old", "d", now - dt.timedelta(days=9))]
    planned = spark.createDataFrame(calendar, "feed_name string, day string, closes_at timestamp")
    schema = "feed_name string, day string, closes_at timestamp, arrived_at timestamp"
    spark.createDataFrame([("b", "d", None, now)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = drain(timers.window_states(stream, planned, keep_seconds=1), tmp_path, lambda r: len(r) >= 3)
    assert [(r[0], r[2]) for r in got] == [("a", "missing"), ("b", "arrived"), ("old", "missing")]
    # a and old are forgotten by now: a file that comes for them is new
    held = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "slot").load()
    assert {r.key.feed_name for r in held.collect()} <= {"a", "b"}
