"""Several writers, lookups by key, levels and expiry."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from opslake import commits, schemas
from opslake import store as module
from opslake.store import Store

STATE = schemas.TABLES["source_state"][1]
SOURCE = schemas.TABLES["source"][1]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), file_rows=160)


def states(spark, rows):
    return spark.createDataFrame([(k, str(v), None) for k, v in rows], STATE)


def held(store):
    return {r.source_id: r.watermark for r in store.current("source_state").collect()}


def add_one(spark, keys, calls=None, then=None):
    """A build that counts up the rows of some keys."""

    def build(past):
        if calls is not None:
            calls.append(1)
        wanted = states(spark, [(k, 0) for k in keys])
        had = {r.source_id: int(r.watermark) for r in past.touched("source_state", wanted).collect()}
        if then is not None and (calls is None or len(calls) == 1):
            then()
        return {"source_state": states(spark, [(k, had.get(k, 0) + 1) for k in keys])}

    return build


def test_records_are_created_once(spark, tmp_path):
    log = commits.Log(spark, str(tmp_path / "log"))
    assert log.append(1, {"a": 1}) and not log.append(1, {"a": 2}) and log.record(1) == {"a": 1}
    won = []
    threads = [threading.Thread(target=lambda n=n: won.append(n) if log.append(2, {"n": n}) else None) for n in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and commits.Log(spark, log.root).record(2) == {"n": won[0]} and log.names() == ([1, 2], [])


def test_a_writer_that_loses_merges_again(spark, store):
    calls = []
    other = lambda: store.transact("b", 1, add_one(spark, [1, 5]))
    assert store.transact("a", 1, add_one(spark, [1, 2], calls, other))
    assert held(store) == {1: "2", 2: "1", 5: "1"} and len(calls) == 2
    assert [(c.writer, c.batch) for c in store.committed()] == [("b", 1), ("a", 1)]


def test_a_writer_that_loses_to_other_rows_does_not(spark, store):
    calls = []
    other = lambda: store.commit(1, {"source_state": states(spark, [(9, 9)]), "source": spark.createDataFrame([(1, "t", "n", "c")], SOURCE)}, "b")
    assert store.transact("a", 1, add_one(spark, [1, 2], calls, other)) and len(calls) == 1
    assert held(store) == {1: "1", 2: "1", 9: "9"}
    again = []
    assert store.transact("a", 2, add_one(spark, [1], again, lambda: store.commit(2, {"source": spark.createDataFrame([(2, "t", "n", "c")], SOURCE)}, "b")), reads=("source",))
    assert len(again) == 2


def test_writers_at_once_lose_nothing(spark, store):
    failures = []

    def work(name):
        try:
            mine = Store(spark, store.root)
            for batch in range(1, 4):
                mine.transact(name, batch, add_one(spark, [0, 1 + ord(name)]))
        except Exception as problem:  # noqa: BLE001
            failures.append(problem)

    threads = [threading.Thread(target=work, args=(name,)) for name in "xyz"]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failures
    assert held(store) == {0: "9", **{1 + ord(n): "3" for n in "xyz"}} and len(store.committed()) == 9


def test_batches_of_writers_are_replaced_at_their_place(spark, store):
    store.commit(1, {"source_state": states(spark, [(1, 10), (2, 10)])}, "a")
    store.commit(1, {"source_state": states(spark, [(1, 20)])}, "b")
    store.commit(1, {"source_state": states(spark, [(1, 30), (2, 30)])}, "a")
    assert held(store) == {1: "20", 2: "30"} and len(store.committed()) == 2
    assert store.before(1, "a").current("source_state").isEmpty()
    assert {r.watermark for r in store.before(1, "b").current("source_state").collect()} == {"30"}


def test_a_folded_batch_is_not_committed_again(spark, store):
    for batch in (1, 2, 3):
        store.commit(batch, {"source_state": states(spark, [(batch, batch), (7, batch)])}, "a")
    assert store.compact() == 2 and store.last_batch("a") == 3
    assert not store.commit(2, {"source_state": states(spark, [(7, 99)])}, "a")
    assert store.commit(2, {"source_state": states(spark, [(8, 99)])}, "b")
    assert held(store) == {1: "1", 2: "2", 3: "3", 7: "3", 8: "99"}


@pytest.mark.parametrize("inline", [1 << 14, 4])
def test_levels_and_lookups(spark, store, monkeypatch, inline):
    monkeypatch.setattr(module, "INLINE_ROWS", inline)
    monkeypatch.setattr(module, "FOLD_AFTER", 2)
    make, want, n = random.Random(inline), {}, 22
    for batch in range(1, n + 1):
        rows = {make.randrange(10**6): batch for _ in range(24)} | {k: batch for k in make.sample(sorted(want), min(len(want), 3))}
        want |= rows
        store.commit(batch, {"source_state": states(spark, rows.items())}, make.choice("ab"))
        store.settle()
        if batch == 16:
            store.expire(4)
    assert {k: int(v) for k, v in held(store).items()} == want
    files = store._state().files["source_state"]
    assert 2 in {f["level"] for f in files} and len(files) <= 8 + 1 + 4
    assert all((f["words"] is None) == (f["rows"] > inline) for f in files if f["level"] == 0)
    assert sum(c.base is False for c in store.committed()) < 4
    known = make.sample(sorted(want), 3)
    one = store.files_for("source_state", states(spark, [(known[0], 0)]))
    assert 1 <= len(one) <= len(files) // 2
    none = store.files_for("source_state", states(spark, [(-k, 0) for k in range(1, 4)]))
    assert len(none) <= len(files) // 2
    found = store.touched("source_state", states(spark, [(k, 0) for k in [*known, -5]]))
    assert {r.source_id: int(r.watermark) for r in found.collect()} == {k: want[k] for k in known}
    records, sums = store._commits.names()
    store.expire()
    assert {k: int(v) for k, v in held(Store(spark, store.root)).items()} == want
    assert len(records) - sums[-1] < 3 * commits.SNAPSHOT and len(store._commits.names()[0]) == 1 and store.expire() == 0


def test_a_reader_keeps_its_snapshot(spark, store):
    store.commit(1, {"source_state": states(spark, [(1, 1)])})
    past = store.snapshot()
    store.commit(2, {"source_state": states(spark, [(1, 2)])})
    assert held(past) == {1: "1"} and held(store) == {1: "2"}
    with pytest.raises(ValueError, match="snapshot"):
        past.commit(3, {})


def test_empty_batches_and_null_keys(spark, store):
    assert store.current("source").isEmpty() and store.touched("source", spark.createDataFrame([(1, "t", "n", "c")], SOURCE)).isEmpty()
    store.commit(1, {"source_state": states(spark, [])})
    store.commit(2, {})
    store.commit(3, {"source_state": states(spark, [(None, 4), (3, 3)])})
    assert [c.batch for c in store.committed()] == [1, 2, 3] and held(store) == {None: "4", 3: "3"}
    assert store.files_for("source_state", states(spark, [])) == []
    assert store.compact() == 2 and held(store) == {None: "4", 3: "3"}
    assert store.log("source_state").select(F.max("batch")).first()[0] == 3


def test_a_large_fold_is_dealt_over_tasks(spark, store, monkeypatch):
    monkeypatch.setattr(module, "FILE_ROWS", 64)
    monkeypatch.setattr(module, "INLINE_ROWS", 16)
    for batch in (1, 2, 3):
        store.commit(batch, {"source_state": states(spark, [(k, batch) for k in range(0, 1000, batch)])}, "a")
    want = {k: str(max(b for b in (1, 2, 3) if k % b == 0)) for k in range(1000)}
    assert store.compact() == 2
    level = [f for f in store._state().files["source_state"] if f["level"] == 1]
    assert sum(f["rows"] for f in level) == 1000 and max(f["rows"] for f in level) <= 2 * 64
    assert held(store) == want
    assert store.settle() > 0 and held(store) == want
    below = [f for f in store._state().files["source_state"] if f["level"] > 1]
    assert below and max(f["rows"] for f in below) <= 2 * 64
    found = store.touched("source_state", states(spark, [(6, 0), (7, 0), (-1, 0)]))
    assert {r.source_id: r.watermark for r in found.collect()} == {6: "3", 7: "1"}
