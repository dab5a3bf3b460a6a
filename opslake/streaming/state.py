"""Streaming forms of the run lifecycle, the history fold, alerts and polling overlap.

Sinks for ``foreachBatch`` that keep what they know in change logs, so results equal the batch twins
on any layout of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake import session, vocab
from opslake.operators import alerts, runs
from opslake.streaming.changes import ChangeLog


class RunMerge:
    """A ``foreachBatch`` sink that merges reports into runs, in whatever order they come.

    What decides about each run is kept in the change log, not in a state store: a batch reads the
    rows of its own runs and writes their new versions. So closed runs cost nothing, a report may
    come at any age, and a replayed batch gives the same.
    """

    def __init__(self, root: str, keys: list[str], carry: list[str] | None = None):
        self.keys, self.carry = keys, carry
        self.parts = ChangeLog(f"{root.rstrip('/')}/parts", keys)

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        fresh = session.cut(runs.lifecycle_parts(events, self.keys, self.carry))
        both = self.parts.touched(fresh, batch_id).unionByName(fresh)
        self.parts.write(runs.combine_parts(both, self.keys), batch_id)

    def rows(self, spark: SparkSession) -> DataFrame:
        return runs.lifecycle_of(self.parts.latest(spark), self.keys, self.carry)


def alert_updates(events: DataFrame) -> DataFrame:
    """Alert rows as raise and resolve events arrive, from an empty alert table."""
    folded = alerts.fold_events(events)
    return folded.filter(F.col("raises") > 0).select(
        "dedup_key", F.col("e_type").alias("type"),
        F.when(F.col("last_kind") == alerts.RAISE, vocab.FIRING).otherwise(vocab.RESOLVED).alias("status"),
        F.col("first_raise").alias("first_seen"), F.col("last_raise").alias("last_occurrence"),
        F.col("raises").alias("occurrences"),
    )


class Once:
    """A ``foreachBatch`` sink that drops reports which overlapping polls read twice, by key and never by age."""

    def __init__(self, root: str, keys: list[str]):
        self.log = ChangeLog(root, keys)

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        keys = self.log.keys
        seen = self.log.before(rows, batch_id).select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        self.log.write(rows.dropDuplicates(keys).join(seen, same, "left_anti"), batch_id)


def pending_steps(history: DataFrame) -> DataFrame:
    """Per job the last failed step that no usable outcome has taken yet: all a later fold needs."""
    is_step = F.col("step_id") != 0
    failed = is_step & (F.col("run_status") == 0)
    usable = ~is_step & (F.col("run_date") > 0)
    columns = [c for c in history.columns if c != "job_id"]
    last = history.filter(failed | usable).groupBy("job_id").agg(
        F.max_by(F.struct(*columns), F.col("instance_id")).alias("r")
    )
    return last.filter(F.col("r.step_id") != 0).select("job_id", "r.*").select(*history.columns)


class HistoryFold:
    """Folds history that arrives in pieces, in any order.

    Between batches a table keeps, per job, how far its history has come and the failed step that no
    outcome has taken yet. A job whose rows all lie beyond that goes on from there. A job with late
    rows is folded again from the log of what came, and its runs are written anew. A replayed batch
    gives the same.
    """

    def __init__(self, spark: SparkSession, root: str, zone: str = "UTC"):
        self.spark, self.root, self.zone = spark, root.rstrip("/"), zone
        self.runs = ChangeLog(f"{self.root}/runs", ["native_run_id", "instance_id"])
        self.came = ChangeLog(f"{self.root}/came", ["job_id", "instance_id"])

    def __call__(self, history: DataFrame, batch_id: int) -> None:
        # steps that did not fail change nothing
        rows = session.cut(history.filter((F.col("step_id") == 0) | (F.col("run_status") == 0)).dropDuplicates(["job_id", "instance_id"]))
        self.came.write(rows, batch_id)
        state = self._state(rows, batch_id)
        spans = rows.groupBy("job_id").agg(F.min("instance_id").alias("low"), F.max("instance_id").alias("high"))
        late = session.cut(spans.join(state.select("job_id", "reached"), "job_id").filter(F.col("low") <= F.col("reached")).select("job_id"))
        pending = state.filter("step is not null").select("step.*").select(*rows.columns)
        todo = rows.join(late, "job_id", "left_anti").unionByName(pending.join(spans, "job_id", "left_semi").join(late, "job_id", "left_anti")).select(*rows.columns)
        if not late.isEmpty():
            again = self.came.before(rows, batch_id).drop("batch").unionByName(rows).join(late, "job_id", "left_semi")
            todo = session.cut(todo.unionByName(again).dropDuplicates(["job_id", "instance_id"]))
        self.runs.write(runs.fold_history(todo, self.zone), batch_id)
        self._next_state(state, spans, todo).write.mode("overwrite").parquet(f"{self.root}/state/{batch_id}")

    def _state(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """job_id, reached, step: one row per job that has come so far."""
        schema = rows.select("job_id", F.col("instance_id").alias("reached"), F.struct(*rows.columns).alias("step")).schema
        for f in schema:
            f.nullable = True
        if batch_id == 0:
            return rows.sparkSession.createDataFrame([], schema)
        return rows.sparkSession.read.schema(schema).parquet(f"{self.root}/state/{batch_id - 1}")

    @staticmethod
    def _next_state(state: DataFrame, spans: DataFrame, todo: DataFrame) -> DataFrame:
        waits = pending_steps(todo).select(F.col("job_id").alias("j"), F.struct(*todo.columns).alias("waits"))
        moved = state.join(spans.drop("low"), "job_id", "full").join(waits, F.col("job_id") == F.col("j"), "left")
        return moved.select(
            "job_id", F.greatest("reached", "high").alias("reached"),
            F.when(F.col("high").isNull(), F.col("step")).otherwise(F.col("waits")).alias("step"),
        )

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.runs.latest(spark).select(*runs.RUN_COLUMNS, "instance_id")
