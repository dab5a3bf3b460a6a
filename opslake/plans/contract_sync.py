"""Contract sync: a directory of contract files into feeds and contract versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake import session
from opslake.operators import contracts, scan
from opslake.sources import contracts as files
from opslake.store import Store

# Order of a sync: by path. So many files, in that order, are one slice of a feed.
SLICE_FILES = 1 << 16


def sync(store: Store, directory: str, batch: int, now: str) -> DataFrame:
    """Read, check, number and store; returns one result row per file."""
    at = F.lit(now).cast("timestamp")
    checked = session.cut(contracts.check_rules(files.read(store.spark, directory)))
    good = contracts.with_hash(checked.filter(F.col("error").isNull()))
    good = session.cut(scan.numbered(good, ["place"], "file"))
    held = {}

    def build(past: Store) -> dict[str, DataFrame]:
        numbered = session.cut(
            contracts.next_versions(good, past.current("contract_version"), ["place"], scan.id_chunk("file", SLICE_FILES))
        )
        held["numbered"] = numbered
        created = numbered.filter("created").withColumn("effective_from", at)
        return {"contract_version": created, "feed": contracts.merge_feeds(past.current("feed"), good, ["place"])}

    store.transact("contracts", batch, build)
    return contracts.sync_results(checked, held["numbered"])
