"""Folding and lifecycles against plain sequential replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opslake import schemas, vocab
from opslake.functions.fingerprint import fingerprint
from opslake.operators import runs, scan
from opslake.streaming.state import HistoryFold, Once, RunMerge, pending_steps

T0 = dt.datetime(2026, 9, 3, 2, 0)


def fold_in_order(rows):
    """What the fold means, one row after the other."""
    pending, done = {}, []
    for i, job, step, _, status, date, _, _, message in sorted(rows):
        if step != 0:
            pending.setdefault(job, []).append((status, message))
            continue
        if date <= 0:
            continue
        failed = [m for s, m in pending.pop(job, []) if s == 0]
        text = None
        if status == 0:
            text = failed[-1] if failed and failed[-1] is not None else message
        done.append((i, job, vocab.AGENT_STATUS.get(status, vocab.UNKNOWN), text))
    return sorted(done)


def history_rows(seed, n=1200, jobs=6):
    r = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        job = "hot" if r.random() < 0.4 else f"j{r.randrange(jobs)}"
        step = r.choice([0, 0, 1, 2])
        date = 0 if step == 0 and r.random() < 0.2 else 20260903
        rows.append((i, job, step, "s", r.choice([0, 0, 1, 2, 3, 4, 9]), date, 20000 + i % 60, 45, r.choice([None, f"m{i}"])))
    return rows


@pytest.mark.parametrize("width", [1, 16, 5000])
def test_fold_equals_sequential_fold(spark, width):
    rows = history_rows(width)
    folded = runs.fold_history(spark.createDataFrame(rows, schemas.SYSJOBHISTORY), chunk_rows=width)
    got = sorted((r.instance_id, r.native_job_id, r.status, r.error_text) for r in folded.collect())
    assert got == fold_in_order(rows)


def test_fold_by_hand(spark):
    rows = [
        (1, "A", 1, "s", 0, 20260903, 20000, 5, "step one"), (2, "A", 2, "s", 0, 20260903, 20005, 5, "step two"),
        (3, "A", 0, "o", 0, 0, 0, 0, "unusable"), (4, "A", 0, "o", 0, 20260903, 20000, 300, "job"),
        (5, "A", 0, "o", 0, 20260903, 30000, 0, "job only"), (6, "B", 1, "s", 0, 20260903, 1, 1, None),
        (7, "B", 0, "o", 0, 20260903, 1, 250000, "own text"), (8, "B", 0, "o", 1, 20260903, 2, 0, "fine"),
    ]
    got = {r.instance_id: r for r in runs.fold_history(spark.createDataFrame(rows, schemas.SYSJOBHISTORY)).collect()}
    assert {k: v.error_text for k, v in got.items()} == {4: "step two", 5: "job only", 7: "own text", 8: None}
    assert got[4].native_run_id == "a:20260903020000" and got[4].ended_at - got[4].started_at == dt.timedelta(minutes=3)
    assert got[7].ended_at - got[7].started_at == dt.timedelta(hours=25)


def test_watermarks(spark):
    rows = [(10, "A", 1, "s", 0, 20260903, 1, 1, "late"), (11, "B", 0, "o", 1, 20260903, 1, 1, "x"), (12, "A", 0, "o", 0, 0, 0, 0, "y")]
    h = spark.createDataFrame(rows, schemas.SYSJOBHISTORY)
    assert runs.history_watermark(h, F.lit("3")).first()[0] == "12"
    assert runs.history_watermark(h, F.lit("50")).first()[0] == "50"
    assert runs.history_watermark(h, F.lit(None).cast("string")).first()[0] == "12"
    assert runs.read_position(h, 11).first()[0] == 9
    assert runs.read_position(h.filter("job_id = 'B'"), 11).first()[0] == 11


def test_fold_in_pieces_equals_fold_at_once(spark, tmp_path):
    rows = history_rows(7)
    whole = spark.createDataFrame(rows, schemas.SYSJOBHISTORY)
    fold = HistoryFold(spark, str(tmp_path / "fold"))
    for n, (a, b) in enumerate([(0, 300), (300, 301), (301, 900), (900, 1300)]):
        piece = whole.filter((F.col("instance_id") > a) & (F.col("instance_id") <= b))
        fold(piece, n)
        fold(piece, n)  # a replayed batch changes nothing
    got = sorted(map(str, fold.rows(spark).collect()))
    assert got == sorted(map(str, runs.fold_history(whole).collect()))
    assert pending_steps(whole).groupBy("job_id").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_of_any_layout_equals_fold_at_once(spark, tmp_path, seed):
    rows = history_rows(seed, 400)
    whole = spark.createDataFrame(rows, schemas.SYSJOBHISTORY)
    random.Random(seed).shuffle(rows)
    fold = HistoryFold(spark, str(tmp_path / "fold"))
    for n in range(4):
        fold(spark.createDataFrame(rows[n::4], schemas.SYSJOBHISTORY), n)
    assert sorted(map(str, fold.rows(spark).collect())) == sorted(map(str, runs.fold_history(whole).collect()))


def test_runs_and_repeats_of_any_layout(spark, tmp_path, reports):
    rows = list(reports[:1500])
    schema = "native_run_id string, started_at timestamp, ended_at timestamp, status string, error_text string, seq bigint"
    whole = spark.createDataFrame(rows, schema)
    random.Random(1).shuffle(rows)
    merge, once = RunMerge(str(tmp_path / "runs"), ["native_run_id"]), Once(str(tmp_path / "once"), ["seq"])
    for n in range(4):
        piece = spark.createDataFrame(rows[n::4] + rows[: 40 * n], schema)
        once(piece, n)
        once(piece, n)  # a replayed batch changes nothing
        merge(spark.createDataFrame(rows[n::4], schema), n)
        merge(spark.createDataFrame(rows[n::4], schema), n)
    assert sorted(map(str, merge.rows(spark).collect())) == sorted(map(str, runs.merge_lifecycle(whole, ["native_run_id"]).collect()))
    assert sorted(r.seq for r in once.log.read(spark).collect()) == sorted(r[-1] for r in rows)


def replay(events):
    """Reports one after the other: outcome of each, and the rows that result."""
    rows, outcomes = {}, []
    for key, started, ended, status, error, seq in sorted(events, key=lambda e: e[-1]):
        row = rows.get(key)
        if row is None:
            rows[key] = [started, ended, status, error]
            outcomes.append((seq, runs.INSERTED))
        elif status in vocab.TERMINAL and row[1] is None:
            rows[key] = [started, ended, status, error]
            outcomes.append((seq, runs.CLOSED))
        else:
            outcomes.append((seq, runs.UNCHANGED))
    return rows, outcomes


@pytest.fixture(scope="module")
def reports():
    r = random.Random(3)
    every = [vocab.QUEUED, vocab.RUNNING, vocab.SUCCEEDED, vocab.FAILED, vocab.CANCELLED, vocab.RETRY, vocab.UNKNOWN]
    out = []
    for seq in range(4000):
        key = "hot" if r.random() < 0.05 else f"run{r.randrange(900)}"
        start = T0 + dt.timedelta(minutes=seq)
        out.append((key, start, r.choice([None, None, start]), r.choice(every), r.choice([None, f"e{seq}"]), seq))
    return out


SHAPE = "native_run_id string, started_at timestamp, ended_at timestamp, status string, error_text string, seq bigint"


def test_lifecycle_equals_replay(spark, reports):
    rows, _ = replay(reports)
    merged = runs.merge_lifecycle(spark.createDataFrame(reports, SHAPE), ["native_run_id"])
    got = {r.native_run_id: [r.started_at, r.ended_at, r.status, r.error_text] for r in merged.collect()}
    assert got == rows


def test_lifecycle_in_batches_equals_lifecycle_at_once(spark, reports):
    events = spark.createDataFrame(reports, SHAPE)
    first = runs.merge_lifecycle(events.filter("seq < 1500"), ["native_run_id"])
    stored = first.select("native_run_id", "started_at", "ended_at", "status", "error_text", F.lit(-1).cast("bigint").alias("seq"))
    both = runs.merge_lifecycle(stored.unionByName(events.filter("seq >= 1500")), ["native_run_id"])
    columns = ["native_run_id", "started_at", "ended_at", "status", "error_text", "fingerprint"]
    whole = runs.merge_lifecycle(events, ["native_run_id"])
    assert sorted(map(str, both.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_write_outcomes_equal_replay(spark, reports, width):
    _, outcomes = replay(reports)
    got = runs.write_outcomes(spark.createDataFrame(reports, SHAPE), ["native_run_id"], scan.id_chunk("seq", width))
    assert sorted((r.seq, r.outcome) for r in got.collect()) == outcomes


def test_fingerprint_follows_the_deciding_report(spark):
    events = [("r", T0, None, "Running", None, 0), ("r", T0, T0, "Failed", "boom 12", 1), ("r", T0, T0, "Succeeded", None, 2)]
    row = runs.merge_lifecycle(spark.createDataFrame(events, SHAPE), ["native_run_id"]).first()
    assert (row.status, row.error_text) == ("Failed", "boom 12")
    assert row.fingerprint == spark.range(1).select(fingerprint(F.lit("boom 99"))).first()[0]


def test_in_flight_takes_the_newest_session(spark):
    t = dt.datetime(2026, 9, 3, 2, 0, 5)
    activity = spark.createDataFrame(
        [("A", 1, t, None, None), ("B", 2, t, None, None), ("C", 2, t, t, None), ("D", 2, None, None, None)], schemas.SYSJOBACTIVITY
    )
    sessions = spark.createDataFrame([(1,), (2,)], schemas.SYSSESSIONS)
    got = runs.in_flight(activity, sessions, "America/Chicago").collect()
    assert [(r.native_run_id, r.status, r.ended_at) for r in got] == [("b:20260903070005", "Running", None)]


def test_dag_run_keys_carry_the_dag(spark):
    rows = [(d, "scheduled__1", "failed", None, None, None, None, None, None, None) for d in ("a", "b")]
    raw = spark.createDataFrame(rows, "dag_id string, dag_run_id string, state string, run_type string, logical_date timestamp, "
                                "execution_date timestamp, start_date timestamp, end_date timestamp, updated_at timestamp, note string")
    got = runs.dag_runs_to_runs(raw, F.lit("2026-01-01").cast("timestamp"))
    assert got.select("native_run_id").distinct().count() == 2


def test_collisions_equal_brute_force(spark):
    r = random.Random(5)
    rows = []
    for n in range(400):
        start = T0 + dt.timedelta(minutes=r.randrange(3000))
        rows.append((r.choice(["a", "a", "b"]), n, start, r.choice([None, start + dt.timedelta(minutes=r.randrange(30))]) if n % 97 == 0 else start + dt.timedelta(minutes=r.randrange(30))))
    df = spark.createDataFrame(rows, "source_id string, native_run_id int, started_at timestamp, ended_at timestamp")
    got = {x.native_run_id for x in runs.collisions(df, ["source_id"], scan.time_chunk("started_at", 3600)).collect()}
    far = dt.datetime(9999, 1, 1)
    want = {
        b[1] for b in rows for a in rows
        if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and (a[3] or far) > b[2]
    }
    assert got == want
