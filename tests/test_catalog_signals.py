"""Identity, bindings, cones, classes."""

import datetime as dt
import random

from pyspark.sql import functions as F

from opslake.operators import catalog, invariants, scan, signals
from opslake.operators import runs as run_ops

T0 = dt.datetime(2026, 9, 3, 2, 0)
KNOWN = (
    "source_id int, native_id string, job_id string, name string, is_active boolean, first_seen timestamp, "
    "last_seen timestamp, bound_at timestamp"
)


def test_merge_jobs(spark):
    known = spark.createDataFrame([(1, "Job-A", "ID-A", "old", True, T0, T0, T0), (1, "gone", "ID-G", "gone", True, T0, T0, T0)], KNOWN)
    batch = spark.createDataFrame([(1, "job-a", "new", False), (1, "job-n", "n", True)], "source_id int, native_id string, native_name string, is_active boolean")
    now = T0 + dt.timedelta(minutes=1)
    got = {r.native_id: r for r in catalog.merge_jobs(known, batch, F.lit(now)).collect()}
    assert (got["Job-A"].job_id, got["Job-A"].name, got["Job-A"].is_active, got["Job-A"].last_seen, got["Job-A"].bound_at) == ("ID-A", "new", False, now, T0)
    assert (got["gone"].name, got["gone"].last_seen) == ("gone", T0)
    assert len(got["job-n"].job_id) == 26 and got["job-n"].bound_at == now


def test_ids_that_differ_by_case_are_one_job(spark):
    known = spark.createDataFrame([], KNOWN)
    batch = spark.createDataFrame([(1, "Load", "a", True), (1, "load", "b", False), (2, "LOAD", "c", True)], "source_id int, native_id string, native_name string, is_active boolean")
    got = sorted((r.source_id, r.native_id, r.name) for r in catalog.merge_jobs(known, batch, F.lit(T0)).collect())
    assert got == [(1, "load", "b"), (2, "LOAD", "c")]
    first = catalog.merge_jobs(known, batch.withColumn("place", F.when(F.col("native_name") == "a", 9).otherwise(1)), F.lit(T0))
    assert {(r.source_id, r.name) for r in first.collect()} == {(1, "a"), (2, "c")}
    bindings = spark.createDataFrame([("Load", "J1"), ("load", "J2")], "native_id string, job_id string")
    ran = spark.createDataFrame([("LOAD", "r1"), ("load", "r2")], "native_job_id string, native_run_id string")
    assert sorted((r.native_run_id, r.job_id) for r in run_ops.resolve_jobs(ran, bindings).collect()) == [("r1", "J1"), ("r2", "J1")]


def test_rebind_leaves_bound_targets(spark):
    schema = "job_id string, source_id int, native_id string, native_name string, bound_at timestamp, unbound_at timestamp"
    bindings = spark.createDataFrame([("A", 1, "x", "x", T0, None), ("B", 1, "Y", "y", T0, None), ("C", 1, "z", "z", T0, None)], schema)
    later = T0 + dt.timedelta(hours=1)
    commands = spark.createDataFrame([("A", 1, "y", "y", later), ("C", 1, "w", "w", later)], "job_id string, source_id int, native_id string, native_name string, at timestamp")
    got = catalog.rebind(bindings, commands)
    assert sorted((r.job_id, r.native_id, r.unbound_at is None) for r in got.collect()) == [("A", "x", True), ("B", "Y", True), ("C", "w", True), ("C", "z", False)]


def test_binding_at_start_equals_brute_force(spark):
    r = random.Random(4)
    bindings = []
    for native in ("hot", "b", "c"):
        at = T0
        for n in range(12):
            at += dt.timedelta(minutes=r.randrange(1, 300))
            end = at + dt.timedelta(minutes=r.randrange(1, 200))
            bindings.append((1, native.upper(), f"{native}{n}", at, end if n < 11 else None))
            at = end
    runs = [(1, r.choice(["hot", "hot", "b", "c", "x"]), f"r{n}", T0 + dt.timedelta(minutes=r.randrange(6000))) for n in range(500)]
    got = catalog.bound_at_start(
        spark.createDataFrame(runs, "source_id int, native_job_id string, native_run_id string, started_at timestamp"),
        spark.createDataFrame(bindings, "source_id int, native_id string, job_id string, bound_at timestamp, unbound_at timestamp"),
        chunk_seconds=3600,
    )
    want = {}
    for _, native, run, at in runs:
        hits = [b[2] for b in bindings if b[1].lower() == native and b[3] <= at and (b[4] is None or at < b[4])]
        want[run] = hits[0] if hits else None
    assert {x.native_run_id: x.job_id for x in got.collect()} == want


def test_ownership_changes(spark):
    rows = [("j", n, t) for n, t in enumerate(["a", "a", None, None, "b"])]
    df = spark.createDataFrame(rows, "job_id string, sync_id bigint, team_id string")
    got = catalog.ownership_changes(df, scan.id_chunk("sync_id", 2)).orderBy("sync_id").collect()
    assert [(r.sync_id, r.team_id, r.previous_team) for r in got] == [(0, "a", None), (2, None, "a"), (4, "b", None)]


def test_invariants(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "upstream int, downstream int")
    assert [tuple(r) for r in invariants.self_edges(edges).collect()] == [(1, 1)]
    assert [tuple(r) for r in invariants.repeated_edges(edges).collect()] == [(1, 2, 2)]
    runs = spark.createDataFrame([(1, "r"), (1, "r"), (2, "r")], "source_id int, native_run_id string")
    assert [tuple(r) for r in invariants.repeated_runs(runs).collect()] == [(1, "r", 2)]
    rows = [(1, "J1", "a", None), (1, "J1", "b", None), (1, "J2", "C", None), (1, "J3", "c", None), (1, "J4", "d", T0), (1, "J4", "d", None)]
    bound = spark.createDataFrame(rows, "source_id int, job_id string, native_id string, unbound_at timestamp")
    assert sorted(tuple(r) for r in invariants.double_bindings(bound).collect()) == [("job", 1, "J1", 2), ("native", 1, "c", 2)]


def cone_of(edges, failed):
    depth = {f: 0 for f in failed}
    layer = list(depth)
    while layer:
        nxt = sorted({v for u, v in edges if u in layer and v not in depth and u != v})
        depth.update({v: depth[layer[0]] + 1 for v in nxt})
        layer = nxt
    return depth


def test_cone_with_cycles_and_hot_node(spark):
    r = random.Random(6)
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(60)} | {(7, n) for n in range(100, 300)} | {(100, 7), (150, 150)}
    failed = [3, 7, 999]
    df = spark.createDataFrame(sorted(edges), "upstream int, downstream int")
    got = signals.cone(df, spark.createDataFrame([(f,) for f in failed], "job_id int"))
    assert {x.job_id: x.depth for x in got.collect()} == cone_of(edges, failed)


def test_classes(spark):
    rows = [
        ("Could not find file 'x'", None, "file missing"), ("Could not find file 'x'", T0 + dt.timedelta(hours=1), "file late"),
        ("Could not find file 'x'", T0 - dt.timedelta(hours=1), "file missing"), ("Schema drift: column X renamed", None, "schema drift"),
        ("Login failed for user 'x'", None, "connection-credential"), ("Cannot insert the value NULL", None, "data violation"),
        ("deadlock victim", None, "schedule collision"), ("name does not match mask", None, "filemask drift"),
        ("upstream job failed", None, "upstream failed"), ("NullReferenceException", None, "code bug"), (None, None, "code bug"),
    ]
    df = spark.createDataFrame([(n, T0, e, a) for n, (e, a, _) in enumerate(rows)], "job_id int, started_at timestamp, error_text string, last_arrival timestamp")
    got = {r.job_id: r["class"] for r in signals.classify(df).collect()}
    assert [got[n] for n in range(len(rows))] == [c for _, _, c in rows]
    below = spark.createDataFrame([(9,), (9,), (0,)], "job_id int")
    got = {r.job_id: r["class"] for r in signals.classify(df, below).collect()}
    assert len(got) == len(rows) and got[9] == "upstream failed" and got[0] == "file missing"
