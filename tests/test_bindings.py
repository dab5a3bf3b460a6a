"""Bindings in both times against a replay of the commands."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslake.plans import bindings
from opslake.store import Store

DAY = lambda n: dt.datetime(2026, 1, n)
COMMAND = "command_id string, job_id string, source_id int, native_id string, native_name string, at timestamp, who string"


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    jobs = spark.createDataFrame([(1, "A", "ja", DAY(1)), (1, "B", "jb", DAY(1)), (1, "C", "jc", DAY(5))], "source_id int, native_id string, job_id string, bound_at timestamp")
    store.commit(1, {"binding": bindings.points(jobs, F.lit(DAY(6)))}, "poll")
    return store


def send(store, batch, now, *commands):
    rows = [(*c[:4], f"name of {c[3]}", c[4], "dba") for c in commands]
    log = bindings.rebind(store, store.spark.createDataFrame(rows, COMMAND), batch, str(DAY(now)))
    return {r.command_id: r.outcome for r in log.collect()}


def known(store, at=None):
    spans = bindings.believed(store.current("binding"), None if at is None else F.lit(DAY(at)))
    return {(r.source_id, r.native_id, r.bound_at.day): (r.job_id, r.unbound_at and r.unbound_at.day) for r in spans.collect()}


FIRST = {(1, "A", 1): ("ja", None), (1, "B", 1): ("jb", None), (1, "C", 5): ("jc", None)}


def test_a_job_moves_once_however_often_it_is_told(spark, store):
    assert send(store, 1, 10, ("m", "ja", 2, "X", DAY(9))) == {"m": "Done"}
    after = FIRST | {(1, "A", 1): ("ja", 9), (2, "X", 9): ("ja", None)}
    assert known(store) == after and known(store, 9) == FIRST
    assert send(store, 2, 12, ("m", "ja", 2, "X", DAY(9)), ("n", "jb", 2, "x", DAY(11))) == {"m": "Done", "n": "Refused"}
    assert known(store) == after and store.current("command").count() == 2
    jobs = {(r.source_id, r.native_id): (r.job_id, r.is_active) for r in store.current("job").collect()}
    assert jobs[2, "X"] == ("ja", True)


def test_commands_sent_again_write_nothing(spark, store):
    send(store, 1, 10, ("m", "ja", 2, "X", DAY(9)))
    after = known(store)
    assert send(store, 2, 12, ("m", "ja", 2, "X", DAY(9))) == {"m": "Done"}
    assert [(c.writer, c.batch, sorted(c.tables)) for c in store.committed()][-1] == ("commands", 2, [])
    assert known(store) == after and store.last_batch("commands") == 2


def test_jobs_change_places(spark, store):
    assert send(store, 1, 10, ("p", "ja", 1, "b", DAY(8)), ("q", "jb", 1, "a", DAY(8))) == {"p": "Done", "q": "Done"}
    assert known(store) == {(1, "A", 1): ("ja", 8), (1, "B", 1): ("jb", 8), (1, "C", 5): ("jc", None), (1, "b", 8): ("ja", None), (1, "a", 8): ("jb", None)}


def test_a_late_command_changes_the_past_up_to_the_next_change(spark, store):
    send(store, 1, 20, ("m", "ja", 2, "X", DAY(15)))
    assert send(store, 2, 25, ("l", "ja", 3, "Y", DAY(7))) == {"l": "Done"}
    assert known(store) == FIRST | {(1, "A", 1): ("ja", 7), (3, "Y", 7): ("ja", 15), (2, "X", 15): ("ja", None)}
    assert known(store, 22) == FIRST | {(1, "A", 1): ("ja", 15), (2, "X", 15): ("ja", None)}
    runs = [(s, n, f"r{d}", DAY(d)) for s, n, days in ((1, "a", (3, 8)), (3, "y", (6, 9, 16)), (2, "x", (14, 16))) for d in days]
    frame = spark.createDataFrame(runs, "source_id int, native_job_id string, native_run_id string, started_at timestamp")
    bound = lambda at=None: {(r.source_id, r.started_at.day): r.job_id for r in bindings.bound_runs(store, frame, at).collect()}
    assert bound() == {(1, 3): "ja", (1, 8): None, (3, 6): None, (3, 9): "ja", (3, 16): None, (2, 14): None, (2, 16): "ja"}
    assert bound(F.lit(DAY(22))) == {(1, 3): "ja", (1, 8): "ja", (3, 6): None, (3, 9): None, (3, 16): None, (2, 14): None, (2, 16): "ja"}


def test_what_is_refused(spark, store):
    assert send(store, 1, 10, ("future", "ja", 2, "X", DAY(11)), ("a", "jb", 2, "Y", DAY(9)), ("b", "jb", 2, "Z", DAY(9)), ("c", "jc", 2, "y", DAY(9))) == {
        "future": "Refused", "a": "Done", "b": "Refused", "c": "Refused"
    }
    assert known(store) == FIRST | {(1, "B", 1): ("jb", 9), (2, "Y", 9): ("jb", None)}


def test_empty_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], COMMAND)
    assert bindings.rebind(store, none, 1, str(DAY(3))).isEmpty()
    assert bindings.believed(store.current("binding")).isEmpty()
