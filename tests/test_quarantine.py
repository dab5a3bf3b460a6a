"""Files set aside by runs that die, repeat and race."""

import os

import pytest
from pyspark.sql import functions as F

from opslake.plans import quarantine
from opslake.sources import listing
from opslake.store import Store

NOW = "2026-01-01 00:00:00"


@pytest.fixture
def zone(spark, tmp_path):
    root, aside = tmp_path / "zone", tmp_path / "aside"
    for n in range(8):
        path = root / f"feed{n % 2}" / f"f {n}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * (n + 1))
    store = Store(spark, str(tmp_path / "store"))
    judge(store, root, 1)
    return store, root, aside


def judge(store, root, batch):
    """Files of feed1 are bad."""
    key = F.substring(F.col("key"), len(f"file:{root}/") + 1, 1000)
    feed = F.substring_index(key, "/", 1)
    files = listing.table(store.spark, str(root)).select(
        "arrival_id", feed.alias("feed_name"), key.alias("key"), "size_bytes", "arrived_at",
        F.when(feed == "feed1", "Quarantined").otherwise("Validated").alias("disposition"),
    )
    store.commit(batch, {"arrival": files}, "landing")


def seen(store, root):
    return sorted((r.feed_name, r.place, r.path) for r in quarantine.places(store, str(root)).collect())


def names(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file())


def test_a_run_that_dies_is_finished_by_the_next(spark, zone, monkeypatch):
    store, root, aside = zone
    quarantine.intend(store, str(root), str(aside), 1, NOW)
    # two moves were made, then the run died; one file was gone and another replaced in the meantime
    intents = {r.from_path: r for r in store.current("move").collect()}
    first, second, third, fourth = (intents[f"{root}/feed1/f {n}.csv"] for n in (1, 3, 5, 7))
    millis = lambda r: int(r.arrived_at.timestamp() * 1000 + 0.5)
    assert quarantine.move(first.from_path, first.to_path, millis(first)) == "Moved"
    (root / "feed1" / "f 5.csv").unlink()
    (root / "feed1" / "f 7.csv").write_text("other")

    os.utime(root / "feed1" / "f 7.csv", (5, 5))
    assert {p for _, p, _ in seen(store, root)} == {"Landed", "Moving"}
    listed = listing.table(spark, str(root))
    left = {r.key.split("/")[-1] for r in quarantine.landed(store, listed).collect()}
    assert left == {"f 0.csv", "f 2.csv", "f 4.csv", "f 6.csv", "f 7.csv"}
    quarantine.run(store, str(root), str(aside), 2, NOW)
    outcome = {r.from_path[-7:]: r.outcome for r in store.current("move").collect()}
    assert outcome == {"f 1.csv": "Moved", "f 3.csv": "Moved", "f 5.csv": "Gone", "f 7.csv": "Replaced"}
    assert names(aside) == ["f 1.csv", "f 3.csv"] and names(root / "feed1") == ["f 7.csv"]
    assert open(first.to_path).read() == "xx"
    quarantine.run(store, str(root), str(aside), 2, NOW)  # the same run again
    assert names(aside) == ["f 1.csv", "f 3.csv"] and store.current("move").count() == 4
    assert [p for f, w, p in seen(store, root) if w == "Aside"] == sorted([first.to_path, second.to_path])
    # what replaced a file is judged, and moved, on its own
    judge(store, root, 2)
    quarantine.run(store, str(root), str(aside), 3, NOW)
    assert names(aside) == ["f 1.csv", "f 3.csv", "f 7.csv"] and names(root / "feed1") == []
    assert {r.key.rsplit("/", 1)[-1] for r in quarantine.set_aside(store).collect()} == {"f 1.csv", "f 3.csv", "f 7.csv"}


def test_moves_may_be_tried_again(tmp_path):
    old, new = tmp_path / "a.csv", tmp_path / "x" / "y" / "a.csv"
    old.write_text("ab")
    millis = old.stat().st_mtime_ns // 1_000_000
    move = lambda at=millis: quarantine.move(str(old), str(new), at)
    assert move(millis + 1) == "Replaced" and old.exists()
    assert move() == "Moved" and move() == "Moved" and not old.exists()

    old.write_text("ab")
    os.utime(old, ns=(new.stat().st_mtime_ns,) * 2)
    assert move() == "Moved" and not old.exists()  # a copy whose source had not been deleted
    old.write_text("later")
    assert move() == "Moved" and old.read_text() == "later"
    new.unlink()
    old.unlink()
    assert move() == "Gone"


def test_aside_is_outside_the_zone(zone):
    store, root, _ = zone
    with pytest.raises(ValueError):
        quarantine.run(store, str(root), str(root / "bad"), 1, NOW)
