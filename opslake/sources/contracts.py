"""Contract files: YAML to spec rows. The one place where rows pass through Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.functions import contract as fn
from opslake.sources.landing import empty_files

_DECODED = (
    "path string, feed_id string, owner string, landing_prefix string, file_mask string, start string, `end` string, "
    "schema_name string, columns array<struct<name:string, type:string, nullable:string, max_length:string>>, "
    "read_error string"
)


def _text(node: dict, key: str) -> str:
    value = node.get(key)
    return "" if value is None else str(value)


def _decode(path: str, content: bytes) -> dict:
    """One file to one flat row; all scalars stay text, typed later by column expressions."""
    import yaml

    row = dict.fromkeys(
        ["feed_id", "owner", "landing_prefix", "file_mask", "start", "end", "schema_name", "columns", "read_error"]
    )
    row["path"] = path
    try:
        doc = yaml.load(content.decode("utf-8-sig"), Loader=yaml.BaseLoader)
        if doc is None:
            return {**row, "read_error": "contract is empty"}
        window, schema = doc.get("arrivalWindow") or {}, doc.get("schema") or {}
        columns = [
            {
                "name": _text(c, "name"), "type": _text(c, "type"), "nullable": c.get("nullable"),
                "max_length": c.get("maxLength"),
            }
            for c in schema.get("columns") or []
        ]
        row.update(
            feed_id=_text(doc, "feedId"), owner=_text(doc, "owner"), landing_prefix=_text(doc, "landingPrefix"),
            file_mask=_text(doc, "fileMask"), start=window.get("start"), end=window.get("end"),
            schema_name=_text(schema, "name"), columns=columns,
        )
    except (yaml.YAMLError, UnicodeDecodeError, AttributeError, TypeError) as problem:
        row["read_error"] = f"contract is not valid YAML: {' '.join(str(problem).split())}"
    return row


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([_decode(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)])


def decode(files: DataFrame) -> DataFrame:
    """Files (path, content) to specs, one row per file; unreadable ones carry ``read_error``."""
    raw = files.select("path", "content").mapInPandas(_decode_batches, _DECODED)
    bad_clock = lambda c: c.isNotNull() & fn.clock_seconds(c).isNull()
    flag = lambda c: F.lower(c).isin("true", "yes", "on", "y", "1")
    known = lambda c: F.lower(c).isin("true", "yes", "on", "y", "1", "false", "no", "off", "n", "0")
    bad_column = F.exists(
        F.coalesce("columns", F.array().cast("array<struct<name:string,type:string,nullable:string,max_length:string>>")),
        lambda c: (c["nullable"].isNotNull() & ~known(c["nullable"]))
        | (c["max_length"].isNotNull() & (c["max_length"] != "") & c["max_length"].try_cast("int").isNull()),
    )
    error = (
        F.when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(bad_clock(F.col("start")) | bad_clock(F.col("end")), F.lit("contract is not valid YAML: bad time"))
        .when(bad_column, F.lit("contract is not valid YAML: bad column value"))
    )
    columns = F.transform(
        "columns",
        lambda c: F.struct(
            c["name"].alias("name"), c["type"].alias("type"),
            F.coalesce(flag(c["nullable"]), F.lit(False)).alias("nullable"),
            c["max_length"].try_cast("int").alias("max_length"),
        ),
    )
    return raw.select(
        "path", "feed_id", "owner", "landing_prefix", "file_mask",
        F.coalesce(fn.clock_seconds(F.col("start")), F.lit(0)).alias("window_start"),
        F.coalesce(fn.clock_seconds(F.col("end")), F.lit(0)).alias("window_end"),
        "schema_name", columns.alias("columns"), error.alias("read_error"),
    )


def read(spark: SparkSession, directory: str) -> DataFrame:
    """All contract files below a directory, with ``place``, their order: path without case."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml}")
        .option("recursiveFileLookup", True).load(directory)
    )
    empty = empty_files(spark, directory).filter(F.col("key").rlike(r"\.ya?ml\z"))
    nothing = empty.select(F.col("key").alias("path"), F.lit("").cast("binary").alias("content"))
    return decode(files.select("path", "content").unionByName(nothing)).withColumn("place", F.upper("path"))


