"""Landed feed files: listings, headers, delimited and fixed-width rows, JSON structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions import contract as fn
from opslake.sources import listing


def arrivals(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """What lies in the landing zone, files without a byte included. Contents are not read; tasks list the folders."""
    return listing.table(spark, path, glob)


def empty_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """arrival_id, key, arrived_at of the files without a byte, which Spark's other readers pass over."""
    return listing.table(spark, path, glob).filter(F.col("size_bytes") == 0).select("arrival_id", "key", "arrived_at")


def arrival_stream(spark: SparkSession, path: str, glob: str = "*", settle: float = 1) -> DataFrame:
    """The same as a stream of new files."""
    return listing.stream(spark, path, glob, settle=settle)


def as_arrivals(files: DataFrame) -> DataFrame:
    """Rows of a binary file reader as arrivals."""
    return files.select(
        F.col("_metadata.file_path").alias("arrival_id"), F.col("path").alias("key"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("arrived_at"),
    )


def relative_key(arrivals: DataFrame, root: str) -> DataFrame:
    """Keys as seen from the root of the landing zone, as landing prefixes are."""
    at = F.locate(root.rstrip("/") + "/", F.col("key"))
    tail = F.substring(F.col("key"), at + len(root.rstrip("/")) + 1, F.length("key"))
    return arrivals.withColumn("key", F.when(at > 0, tail).otherwise(F.col("key")))


def _kind(rows: DataFrame, fixed: bool, glob: str | None) -> DataFrame:
    """Rows of the files asked for: by glob, or else the ``.txt`` files or all others but JSON.

    A condition on a file's name is applied when files are listed; the others are not opened.
    """
    name = F.col("_metadata.file_name")
    return rows if glob else rows.filter(fn.is_fixed_width(name) if fixed else ~fn.is_fixed_width(name) & ~fn.is_json(name))


def _lines(spark: SparkSession, path: str, fixed: bool, glob: str | None) -> DataFrame:
    """Lines with their file and a number that grows along each file block."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob or "*").text(path)
    return (
        _kind(text, fixed, glob)
        .select(
            F.col("_metadata.file_path").alias("arrival_id"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("n"),
            "value",
        )
    )


def _first_lines(lines: DataFrame) -> DataFrame:
    """First line of every file: the lowest number within the block that starts at byte 0.

    That block is read by one task, so the number tells the order whatever the other tasks do.
    """
    return lines.filter(F.col("block") == 0).groupBy("arrival_id").agg(F.min_by("value", "n").alias("header_line"))


def _split(line: Column) -> Column:
    """Header line of a delimited file to names, quotes taken off."""
    bare = F.regexp_replace(line, "^﻿", "")
    return F.transform(
        F.split(bare, r',(?=(?:[^"]*"[^"]*")*[^"]*\z)'),
        lambda n: F.replace(F.regexp_replace(F.trim(n), r'\A"|"\z', ""), F.lit('""'), F.lit('"')),
    )


def delimited_headers(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """arrival_id and the column names each file itself declares."""
    return _first_lines(_lines(spark, path, False, glob)).select("arrival_id", _split(F.col("header_line")).alias("header"))


def delimited_rows(
    spark: SparkSession, path: str, width: int, glob: str | None = None, multi_line: bool = False
) -> DataFrame:
    """arrival_id, values and n_fields (how many the line has) of each data line, for files of up to ``width`` columns.

    The CSV reader drops each file's own header line; an empty field is null. ``multi_line`` allows
    line breaks inside quotes, at the price of one task per file.
    """
    # One column more than any file has, so that every line differs from the schema and is kept as it was
    names = [f"c{i}" for i in range(width + 1)]
    rows = (
        spark.read.schema(", ".join(f"{n} string" for n in [*names, "line"])).option("header", True)
        .option("enforceSchema", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", "line").option("columnPruning", False)
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob or "*").csv(path)
    )
    plain = F.size(F.split("line", ","))
    count = F.when(F.col("line").isNull(), width + 1).when(F.contains("line", F.lit('"')), F.size(_split(F.col("line")))).otherwise(plain)
    # A line has a field at least; Spark reads a line as it was together with another column only
    count = F.greatest(count, F.col("c0").isNotNull().cast("int"))
    return _kind(rows, False, glob).select(
        F.col("_metadata.file_path").alias("arrival_id"), F.array(*names).alias("values"), count.alias("n_fields")
    )


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """arrival_id and value: the lines of all JSON files."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    return text.filter(fn.is_json(F.col("_metadata.file_name"))).select(F.col("_metadata.file_path").alias("arrival_id"), "value")


def with_offsets(columns: Column) -> Column:
    """Contract columns with the width and the offset (from 1) they have in a fixed-width file."""
    sized = F.transform(
        columns, lambda c: c.withField("width", fn.field_width(c["type"], c["max_length"]))
    )
    return F.transform(
        sized,
        lambda c, i: c.withField(
            "offset", F.aggregate(F.slice(sized, F.lit(1), i), F.lit(1), lambda acc, p: acc + p["width"])
        ),
    )


def cut_fields(line: Column, columns: Column) -> Column:
    """Fixed-width line to values; blanks are null."""
    return F.transform(
        columns, lambda c: F.nullif(F.rtrim(F.substring(line, c["offset"], c["width"])), F.lit(""))
    )


def fit_name(name: Column, width: Column) -> Column:
    """A column name as a fixed-width header can show it."""
    return F.rtrim(fn.fit(name, width))


# Never part of a line, so the CSV reader sees one column
_NO_SEPARATOR = "\u0001\u0002\u0001\u0002"


def fixed_width_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """arrival_id and line for each data line.

    The CSV reader drops each file's own header line, whatever the splits; it also drops lines of
    blanks, which are rows without a value here, so these are added from the text.
    """
    lines = (
        spark.read.schema("line string").option("header", True).option("enforceSchema", True)
        .option("sep", _NO_SEPARATOR).option("quote", "").option("escape", "")
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob or "*").csv(path)
    )
    blanks = _lines(spark, path, True, glob).filter(F.col("value").rlike(r"\A\s+\z"))
    return _kind(lines, True, glob).select(F.col("_metadata.file_path").alias("arrival_id"), "line").unionByName(
        blanks.select("arrival_id", F.col("value").alias("line"))
    )


def fixed_width_headers(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """arrival_id and header line of every fixed-width file, also of those without data lines."""
    return _first_lines(_lines(spark, path, True, glob))


def render_fixed_width(df: DataFrame, columns: list[dict]) -> Column:
    """One line per row, every field padded or cut to its width."""
    width = lambda c: vocab.TYPE_WIDTH.get(c["type"], c.get("max_length") or vocab.DEFAULT_WIDTH)
    return F.concat(*[fn.fit(F.col(c["name"]).cast("string"), width(c)) for c in columns])


def json_structure(lines: DataFrame, declared: list[str] | Column) -> DataFrame:
    """Structural check of JSON feed lines (arrival_id, value): unreadable lines, missing and extra keys.

    ``declared``: the names for all lines, or a column of each line's names.
    """
    keys = F.json_object_keys("value")
    names = declared if isinstance(declared, Column) else F.array(*[F.lit(n) for n in declared])
    mark = lambda check, column: F.struct(F.lit(check).alias("check"), column.alias("column_name"))
    drifted = F.concat(
        F.transform(F.array_except(names, keys), lambda n: mark(vocab.V_REMOVED, n)),
        F.transform(F.array_except(keys, names), lambda n: mark(vocab.V_ADDED, n)),
    )
    marks = F.when(keys.isNull(), F.array(mark("unreadable", F.lit("")))).otherwise(drifted)
    return (
        lines.select("arrival_id", F.explode(marks).alias("f")).groupBy("arrival_id", "f.check", "f.column_name")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
