"""Poll cycles driven by a stream: every micro-batch of reports is one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.plans import poll
from opslake.store import Store


def cycle_sink(
    store: Store, source_id: int, name: str, jobs: Callable[[], DataFrame], first_batch: int = 1
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for run reports that carry ``seq`` and ``reported_at``.

    The checkpoint keeps the place in the input, so no watermark is stored; a replayed micro-batch
    replaces its commit. Any number of sources may write to one store. ``jobs`` reads the catalogue as of now. A failed cycle stops the stream, as
    its reports would be lost otherwise.
    """

    def sink(reports: DataFrame, batch_id: int) -> None:
        now = reports.agg(F.max("reported_at").cast("string")).first()[0]
        if now is None:
            return
        got = poll.Collected(jobs(), reports.drop("reported_at"), None)
        result = poll.cycle(store, source_id, name, first_batch + batch_id, now, lambda _: got)
        if not result.ok:
            raise RuntimeError(result.error)

    return sink
