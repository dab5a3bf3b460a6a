"""The stored closure against breadth-first search."""

import random

import pytest

from opslake.plans import dependencies
from opslake.store import Store

EDGE = "upstream string, downstream string, declared_by string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), file_rows=64)


def declare(store, batch, edges, now="2026-01-01", writer="dependencies"):
    frame = store.spark.createDataFrame([(u, v, f"by {batch}") for u, v in edges], EDGE)
    return dependencies.declare(store, frame, batch, now, writer)


def distances(edges):
    """(upstream, downstream) -> length of the shortest chain, for different ends."""
    after = {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            after.setdefault(u, set()).add(v)
    found = {}
    for start in after:
        depth, layer = {start: 0}, [start]
        while layer:
            nxt = {w for x in layer for w in after.get(x, ()) if w not in depth}
            depth.update({w: depth[layer[0]] + 1 for w in nxt})
            layer = list(nxt)
        found.update({(start, w): d for w, d in depth.items() if d})
    return found


def stored(store, table="reach"):
    return {(r.upstream, r.downstream): r.depth for r in store.current(table).collect()}


def test_batches_of_edges_equal_search(store):
    r = random.Random(1)
    name = lambda: f"j{r.randrange(30)}"
    edges = []
    for batch in range(1, 4):
        fresh = [(name(), name()) for _ in range((20, 1, 9)[batch - 1])]
        fresh += [fresh[0], ("a", "a"), (None, "a"), ("a", None), *edges[:2]]
        edges += fresh
        declare(store, batch, fresh)
        assert stored(store) == stored(store, "reached") == distances(edges)
    declare(store, 3, fresh)  # a batch that runs again
    assert stored(store) == distances(edges)
    store.settle()
    failed = store.spark.createDataFrame([("j1",), ("j2",), ("unknown",), (None,), ("j1",)], "job_id string")
    now = stored(store)
    want = {v: min(now.get((s, v), 99) for s in ("j1", "j2")) for _, v in now if any((s, v) in now for s in ("j1", "j2"))}
    got = {x.job_id: x.depth for x in dependencies.downstream_of(store, failed).collect()}
    assert got == want | {"j1": 0, "j2": 0, "unknown": 0}
    back = {x.job_id: x.depth for x in dependencies.upstream_of(store, failed.filter("job_id = 'j2'")).collect()}
    assert back == {u: d for (u, v), d in now.items() if v == "j2"} | {"j2": 0}


def test_a_chain_takes_ten_rounds(store, monkeypatch):
    rounds = []
    release = dependencies.session.release
    monkeypatch.setattr(dependencies.session, "release", lambda spark: (rounds.append(1), release(spark)))
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(1000)]
    declare(store, 1, chain)
    assert len(rounds) == 10
    far = store.current("reach").agg({"*": "count", "depth": "max"}).first()
    assert (far["count(1)"], far["max(depth)"]) == (500500, 1000)


def test_one_edge_reads_what_it_reaches(store):
    groups = [(f"g{g}-{i}", f"g{g}-{i + 1}") for g in range(40) for i in range(5)]
    declare(store, 1, groups)
    store.commit(2, {}, "dependencies")
    store.commit(3, {}, "dependencies")
    store.compact()
    store.settle()
    files = [f for f in store._state().files["reach"]]
    asked = store.spark.createDataFrame([("g3-5",)], "upstream string")
    assert len(files) > 4 and len(store.files_for("reach", asked)) < len(files) / 2
    declare(store, 4, [("g3-5", "g4-0")])
    assert stored(store) == distances([*groups, ("g3-5", "g4-0")])


def test_two_writers_join_a_path(store):
    declare(store, 1, [("a", "b"), ("c", "d")])
    real, done = Store.touched, []

    def late(self, table, rows):
        got = real(self, table, rows)
        if table == "reach" and not done:
            done.append(1)
            declare(store, 1, [("d", "e")], writer="other")
        return got

    Store.touched = late
    try:
        declare(store, 2, [("b", "c")])
    finally:
        Store.touched = real
    assert stored(store) == distances([("a", "b"), ("c", "d"), ("d", "e"), ("b", "c")])


def test_edges_of_a_hot_job_and_none(store):
    hot = [("hub", f"n{i}") for i in range(200)] + [(f"m{i}", "hub") for i in range(50)]
    declare(store, 1, hot)
    assert stored(store) == distances(hot)
    declare(store, 2, [])
    assert stored(store) == distances(hot)
    assert store.current("edge").count() == 250
    assert store.current("edge").filter("declared_by != 'by 1'").isEmpty()
