"""Files set aside: intents are committed first, then tasks move the files, and what became of each is stored.

From the commit of its intent on a file is not among the landed ones, wherever its bytes are; once its move is
stored it is read at its new path. So readers see it in one place, and a run that dies between two moves leaves
intents that the next run finishes. A move may be tried any number of times, also by two tasks at once.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake import session, vocab
from opslake.sources import listing
from opslake.store import Store

FILE = ["arrival_id", "arrived_at"]
#: What became of an intent: moved; not there any more; another file has come under its name, which was not judged.
MOVED, GONE, REPLACED = "Moved", "Gone", "Replaced"
LANDED, MOVING, ASIDE = "Landed", "Moving", "Aside"


def run(store: Store, root: str, aside: str, batch: int, now: str) -> DataFrame:
    """Move what is quarantined in the landing zone ``root`` below ``aside``; returns the moves of all runs.

    Finishes the intents of runs that died. ``aside`` lies on the same file system, and outside the zone.
    """
    if (aside.rstrip("/") + "/").startswith(root.rstrip("/") + "/"):
        raise ValueError("what is set aside would be found as landed")
    intend(store, root, aside, batch, now)
    carry_out(store, batch, now)
    return store.current("move")


def intend(store: Store, root: str, aside: str, batch: int, now: str) -> bool:
    """Commit an intent for each file that was judged as quarantined and has none."""
    path = lambda base, *parts: F.concat_ws("/", F.lit(base.rstrip("/")), *parts)

    def build(past: Store) -> dict[str, DataFrame]:
        bad = past.current("arrival").filter(F.col("disposition") == vocab.QUARANTINED)
        fresh = bad.join(past.current("move").select(*FILE), FILE, "left_anti")
        none = F.lit(None)
        rows = fresh.select(
            *FILE, path(root, "key").alias("from_path"), path(aside, F.unix_millis("arrived_at").cast("string"), "key").alias("to_path"),
            F.lit(now).cast("timestamp").alias("intended_at"), none.cast("timestamp").alias("done_at"), none.cast("string").alias("outcome"),
        )
        return {"move": session.cut(rows)}

    return store.transact("quarantine", batch, build, reads=("arrival",))


def carry_out(store: Store, batch: int, now: str) -> bool:
    """Carry out every open intent by tasks, and store what became of it."""

    def build(past: Store) -> dict[str, DataFrame]:
        open_ = past.current("move").filter("outcome is null").drop("outcome", "done_at")
        asked = open_.withColumn("millis", F.unix_millis("arrived_at")).repartition("arrival_id")
        done = asked.select(*FILE, "from_path", "to_path", "millis").mapInPandas(_move_all, "arrival_id string, arrived_at timestamp, outcome string")
        return {"move": open_.join(session.cut(done), FILE).withColumn("done_at", F.lit(now).cast("timestamp"))}

    return store.transact("quarantine-moves", batch, build)


def _move_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        outcome = [move(r.from_path, r.to_path, r.millis) for r in frame.itertuples()]
        yield frame[FILE].assign(outcome=outcome)


def move(source: str, target: str, millis: int) -> str:
    """Move one file that was modified at ``millis``, unless that has been done; the outcome.

    Where moving is copying and deleting, an attempt that died in between left both; the source goes then.
    """
    _, held, here = listing.opened(source)
    there = listing.opened(target)[2]
    for last in (False, True):
        at_source, at_target = held.get_file_info([here, there])
        same = at_source.type == fs.FileType.File and listing.millis(at_source) == millis
        if at_target.type == fs.FileType.File:
            if same and at_source.size == at_target.size:
                held.delete_file(here)
            return MOVED
        if at_source.type != fs.FileType.File:
            return GONE
        if not same:
            return REPLACED
        held.create_dir(posixpath.dirname(there), recursive=True)
        try:
            held.move(here, there)
            return MOVED
        except OSError:
            if last:
                raise
            # another attempt was quicker, or its file system failed: look again
    raise AssertionError("a second attempt returns or raises")


def landed(store: Store, files: DataFrame) -> DataFrame:
    """Rows of a listing of the zone without the files that are, or are being, set aside."""
    kept = F.coalesce("outcome", F.lit(MOVED)) != REPLACED
    return files.join(store.current("move").filter(kept).select(*FILE), FILE, "left_anti")


def places(store: Store, root: str) -> DataFrame:
    """arrival_id, arrived_at, feed_name, place, path: where each judged file is, one row a file.

    A file that is being moved has no path; one that was gone or replaced before its move has none either.
    """
    known = store.current("arrival").join(store.current("move"), FILE, "left")
    open_ = F.col("intended_at").isNotNull() & F.col("outcome").isNull()
    place = F.when(F.col("intended_at").isNull(), LANDED).when(open_, MOVING).when(F.col("outcome") == MOVED, ASIDE).otherwise(F.col("outcome"))
    path = F.when(place == LANDED, F.concat_ws("/", F.lit(root.rstrip("/")), "key")).when(place == ASIDE, F.col("to_path"))
    return known.select(*FILE, "feed_name", place.alias("place"), path.alias("path"))


def set_aside(store: Store) -> DataFrame:
    """Arrivals whose files have been moved: they did come, though the zone does not hold them."""
    moved = store.current("move").filter(F.col("outcome") == MOVED).select(*FILE)
    return store.current("arrival").join(moved, FILE, "left_semi").select("arrival_id", "key", "size_bytes", "arrived_at")
