"""Listings as a table and as a stream against a walk of the folders."""

import datetime as dt
import os
import random

import pytest

from opslake.sources import landing, listing
from opslake.streaming.changes import ChangeLog, start


def put(path, content=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)


@pytest.fixture
def zone(tmp_path):
    """Folders of several depths, names that have to be quoted, files without a byte, and names that readers pass over."""
    root, make = tmp_path / "zone", random.Random(3)
    names = ["a/x y.csv", "a/é%20.csv", "a/b/c/deep+1.json", "a/b/empty.csv", "top.csv", "b/#1?.csv", "b/two=2.txt", "c/[x].csv"]
    names += [f"many/{n}.csv" for n in range(60)]
    for name in names:
        put(root / name, "" if "empty" in name else "x" * make.randrange(1, 50))
    for name in ("a/_SUCCESS", ".hidden", "_tmp/x.csv", "a/y._COPYING_"):
        put(root / name, "no")
    (root / "none").mkdir()
    return root, names


def rows(frame):
    return {(r.arrival_id, r.key, r.size_bytes, r.arrived_at) for r in frame.collect()}


def test_every_file_as_spark_names_it(spark, zone):
    root, names = zone
    got = rows(listing.table(spark, str(root)))
    assert {(k.removeprefix(f"file:{root}/"), s) for _, k, s, _ in got} == {(n, (root / n).stat().st_size) for n in names}
    spark_rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    assert {(r[0], r[1], r[2]) for r in got if r[2]} == {(r.arrival_id, r.key, r.size_bytes) for r in landing.as_arrivals(spark_rows).collect()}
    at = {k: t for _, k, _, t in got}
    assert all(abs(at[f"file:{root}/{n}"].timestamp() - (root / n).stat().st_mtime) < 0.002 for n in names)


def test_globs_prefixes_and_roots_that_are_not_there(spark, zone):
    root, names = zone
    keys = lambda frame: sorted(r.key.removeprefix(f"file:{root}/") for r in frame.collect())
    assert keys(listing.table(spark, f"file://{root}/", "*.csv")) == sorted(n for n in names if n.endswith(".csv"))
    assert keys(listing.table(spark, str(root), prefixes=["a/b", "a/b/c", "b/"])) == sorted(n for n in names if n.startswith(("a/b/", "b/")))
    assert keys(listing.table(spark, str(root), prefixes=[])) == keys(listing.table(spark, str(root / "gone"))) == []
    assert listing.table(spark, str(root)).rdd.getNumPartitions() == 6  # five folders and the root


def test_the_stream_gives_the_rows_of_the_table(spark, zone, tmp_path):
    root, names = zone
    log = ChangeLog(str(tmp_path / "out"), ["arrival_id"])
    old = dt.datetime(2026, 9, 3, tzinfo=dt.UTC).timestamp()
    for n in names[:30]:
        os.utime(root / n, (old, old))
    run = lambda: start(listing.stream(spark, str(root), settle=0), log.write, str(tmp_path / "checkpoint"), "append").awaitTermination()
    run()
    assert rows(log.read(spark).drop("batch")) == rows(listing.table(spark, str(root)))
    put(root / "later/z.csv", "12")
    put(root / "later/0.csv")
    run()
    run()
    got = log.read(spark).collect()
    assert len(got) == len(names) + 2 and rows(log.read(spark).drop("batch")) == rows(listing.table(spark, str(root)))
