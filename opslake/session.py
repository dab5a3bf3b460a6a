"""Session settings, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "opslake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; anything in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split hot join keys also where a grouping on the same keys follows.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return reach(builder.getOrCreate())


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    paths = spark.sparkContext.environment.setdefault("PYTHONPATH", "").split(os.pathsep)
    here = str(Path(__file__).resolve().parents[1])
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="opslake-"))
    return named or context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so lost executors cost one read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that no table in use needs any more.

    It does so when the driver's collector has found them; iterative jobs say when that is worth it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lookup(big: DataFrame, small: DataFrame, key: str, row_bytes: Column, limit: int = 128 << 20) -> DataFrame:
    """Join a table with one row per key to a big one whose keys may be hot.

    ``row_bytes`` measures the small side, which should be cut or cheap. Up to ``limit`` bytes it is
    broadcast and the big side is not moved. Beyond, it is an ordinary join, in which adaptive
    execution splits hot keys.
    """
    size = small.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).cast("bigint")).first()[0]
    return big.join(F.broadcast(small) if size <= limit else small, key)
