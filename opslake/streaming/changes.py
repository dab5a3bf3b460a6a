"""Change logs: what a streaming query updates, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChangeLog:
    """Updated rows per micro-batch in a shared folder. A replayed batch overwrites itself."""

    def __init__(self, root: str, keys: list[str]):
        self.root, self.keys = root.rstrip("/"), keys

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.root)

    def before(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The log as it was before a batch, also when the batch runs again; ``rows`` have its columns."""
        schema = rows.drop("batch").schema.add("batch", "long")
        if batch_id == 0:
            return rows.sparkSession.createDataFrame([], schema)
        log = rows.sparkSession.read.schema(schema).option("basePath", self.root).parquet(self.root)
        return log.filter(F.col("batch") < batch_id)

    def touched(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The last versions before a batch of the keys in ``rows``."""
        log = self.before(rows, batch_id).join(rows.select(*self.keys).distinct(), self.keys, "left_semi")
        values = [c for c in rows.columns if c not in self.keys]
        last = log.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v"))
        return last.select(*self.keys, "v.*")

    def latest(self, spark: SparkSession) -> DataFrame:
        """Last update of every key."""
        log = self.read(spark)
        values = [c for c in log.columns if c not in (*self.keys, "batch")]
        return (
            log.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v"))
            .select(*self.keys, "v.*")
        )


def start(updates: DataFrame, sink, checkpoint: str, mode: str = "update", **trigger):
    """Run a streaming frame into ``sink(rows, batch_id)``; by default until the input is used up."""
    writer = updates.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()
