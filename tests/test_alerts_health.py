"""Alert merges against a sequential replay; health checks by hand."""

import datetime as dt
import random

from pyspark.sql import functions as F

from opslake import vocab
from opslake.operators import alerts, health

T0 = dt.datetime(2026, 9, 3, 2, 0)


def replay(state, events):
    rows = {r[0]: dict(zip(alerts.STATE, r, strict=True)) for r in state}
    for key, kind_, kind, at, _, message in sorted(events, key=lambda e: e[4]):
        row = rows.get(key)
        if kind == alerts.RAISE:
            if row is None:
                rows[key] = dict(dedup_key=key, type=kind_, status=vocab.FIRING, routed_to=None, message=message, first_seen=at,
                                 last_occurrence=at, occurrences=1, acked_by=None, acked_at=None)
            else:
                row.update(status=vocab.FIRING, last_occurrence=at, occurrences=row["occurrences"] + 1, message=message)
        elif row is not None and row["status"] == vocab.FIRING:
            row["status"] = vocab.RESOLVED
    return rows


def test_merge_equals_replay(spark):
    r = random.Random(2)
    state = [
        (f"k{n}", "T", r.choice([vocab.FIRING, vocab.ACKNOWLEDGED, vocab.RESOLVED]), "team", "old", T0, T0, n + 1, "me", T0) for n in range(60)
    ]
    events = [
        (f"k{r.randrange(120)}", "T", r.choice([alerts.RAISE, alerts.RESOLVE]), T0 + dt.timedelta(minutes=n + 1), n, f"m{n}") for n in range(200)
    ]
    got = alerts.merge(
        spark.createDataFrame(state, alerts.empty_state_schema()),
        spark.createDataFrame(events, "dedup_key string, type string, kind string, at timestamp, seq bigint, message string"),
    )
    assert {x.dedup_key: x.asDict() for x in got.collect()} == replay(state, events)


def test_acknowledge_ends_firing_only(spark):
    state = spark.createDataFrame(
        [(k, "T", s, None, "m", T0, T0, 1, None, None) for k, s in (("a", vocab.FIRING), ("b", vocab.RESOLVED))], alerts.empty_state_schema()
    )
    acks = spark.createDataFrame([("a", "z", T0), ("a", "y", T0 - dt.timedelta(1)), ("b", "z", T0)], "dedup_key string, acked_by string, acked_at timestamp")
    got = {r.dedup_key: (r.status, r.acked_by) for r in alerts.acknowledge(state, acks).collect()}
    assert got == {"a": (vocab.ACKNOWLEDGED, "y"), "b": (vocab.RESOLVED, None)}


def syncs(spark, counts, status="Completed"):
    rows = [(1, n, T0 + dt.timedelta(minutes=n), status if isinstance(status, str) else status[n], c) for n, c in enumerate(counts)]
    return spark.createDataFrame(rows, "source_id int, sync_id bigint, started_at timestamp, status string, job_count bigint")


def dropped(df):
    return [(r.sync_id, r.baseline) for r in health.sharp_drop(df).orderBy("sync_id").collect()]


def test_sharp_drop(spark):
    assert dropped(syncs(spark, [10, 10, 4])) == []  # two samples only
    assert dropped(syncs(spark, [10, 10, 10, 4])) == [(3, 10.0)]
    assert dropped(syncs(spark, [10, 10, 10, 5])) == []  # exactly half is no drop
    assert dropped(syncs(spark, [10, 0, 10, 0, 10, 4])) == [(5, 10.0)]  # empty syncs are no baseline
    failed = ["Completed", "Failed", "Completed", "Completed"]
    assert dropped(syncs(spark, [10, 10, 10, 4], failed)) == []


def test_baseline_is_the_last_five(spark):
    assert dropped(syncs(spark, [1000, 10, 10, 10, 10, 10, 6])) == [(3, 340.0), (4, 257.5), (5, 208.0)]
    assert dropped(syncs(spark, [1000, 10, 10, 10, 10, 10, 4]))[-1] == (6, 10.0)


def test_zero_rows_only_for_completed(spark):
    df = syncs(spark, [0, 0], ["Completed", "Failed"])
    assert [r.sync_id for r in health.zero_rows(df).collect()] == [0]


def test_purge_gap(spark):
    history = spark.createDataFrame([(1, 100), (1, 120), (2, 51), (3, 5)], "source_id int, instance_id bigint")
    marks = spark.createDataFrame([(1, 90), (2, 50), (3, 0)], "source_id int, since bigint")
    assert [tuple(r) for r in health.purge_gap(history, marks).collect()] == [(1, 100, 90, 9)]


def test_stale(spark):
    rows = [(1, "old", T0 - dt.timedelta(minutes=10)), (2, "never", None), (3, "fresh", T0 - dt.timedelta(seconds=30))]
    sources = spark.createDataFrame(rows, "source_id int, name string, last_heartbeat timestamp")
    swept = health.stale_sources(sources, F.lit(T0), 120)
    assert {r.source_id: r.stale for r in swept.collect()} == {1: True, 2: True, 3: False}
    events = health.stale_events(swept, F.lit(T0), F.lit(1))
    got = {r.message: r.kind for r in events.collect()}
    assert got["never has not heartbeated since never"] == alerts.RAISE
    assert sorted(got.values()) == [alerts.RAISE, alerts.RAISE, alerts.RESOLVE]
    assert health.stale_after(60) == 120 and health.stale_after(0) == 2 and health.stale_after(60, 5) == 5
