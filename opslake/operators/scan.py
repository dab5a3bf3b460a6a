"""Running values over ordered groups that may be too big for one task.

A plain window puts each group into one task. Here a group is cut into *chunks*, consecutive slices
of its order, given as an expression of the row (id or time divided by a width). Each chunk is
scanned by itself, the chunks' totals are scanned per group, and the part before the chunk is
joined back. The rows of one group so spread over as many tasks as it has chunks, and only one row
per chunk meets in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslake import session

CHUNK_ROWS = 1 << 20
CHUNK_SECONDS = 86400


def id_chunk(column: Column | str, width: int = CHUNK_ROWS) -> Column:
    """Slices of a unique whole number: at most ``width`` rows each."""
    column = F.col(column) if isinstance(column, str) else column
    return F.call_function("div", column.cast("bigint"), F.lit(width).cast("bigint"))


def time_chunk(column: Column | str, seconds: int = CHUNK_SECONDS) -> Column:
    """Slices of time. Choose ``seconds`` so that the busiest group fits a task in one slice."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(F.unix_micros(column.cast("timestamp")) / (seconds * 1_000_000))


def day_chunk(day: Column | str, tie: Column | str, slices: int = 64, low: int = 0, high: int = (1 << 40) - 1) -> Column:
    """Slices for coarse dates: a day, cut again by the id that breaks ties within the day.

    ``low`` and ``high`` are the least and the greatest id (see ``bounds``); ids beyond them share the
    first or the last slice of the day.
    """
    day = F.col(day) if isinstance(day, str) else day
    tie = F.col(tie) if isinstance(tie, str) else tie
    part = F.least(id_chunk(tie - low, max(1, -(-(high - low + 1) // slices))), F.lit(slices - 1))
    return F.unix_date(day.cast("date")).cast("bigint") * slices + F.greatest(part, F.lit(0))


def bounds(df: DataFrame, column: str) -> dict[str, int]:
    """``low`` and ``high`` of a whole number, in one aggregation; an empty table has 0 and 0."""
    row = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    return {"low": row.low or 0, "high": row.high or 0}


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the position (from 1) of each row in the order of the whole table.

    Rows are sorted into ranges that follow the data, so names with a common beginning spread as well
    as any; only the number of rows per range meets in one place. ``order`` must be a total order.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written down, as the ranges are drawn from a sample
    rows = session.cut(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__n")))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("many"), F.min("__n").alias("first"))
    earlier = F.sum("many").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col("__part").alias("__of"), (F.coalesce(earlier, F.lit(0)) - F.col("first") + 1).alias("__base"))
    joined = rows.join(F.broadcast(counts), F.col("__part") == F.col("__of"))
    return joined.select(*df.columns, (F.col("__n") + F.col("__base")).alias(name))


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is last (non-null), total, high or low of ``value``."""

    kind: str
    value: Column


def last(value: Column) -> Running:
    return Running("last", value)


def total(value: Column) -> Running:
    return Running("total", value)


def high(value: Column) -> Running:
    return Running("high", value)


def low(value: Column) -> Running:
    return Running("low", value)


_NEVER_NULL = {
    "string": "", "boolean": False, "tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0, "double": 0,
    "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01",
}


def partition(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Add the group (``__g...``, ``__z``) and ``__chunk`` of each row, for ``running_within``.

    Null keys are keys like any other: their columns get a stand-in value and ``__z`` says which were
    null. So plain equality finds equal groups, and the window and the join after it share one
    shuffle. Plain columns, because structs sort slowly.
    """
    kinds = dict(df.dtypes)
    chunk_kind = dict(df.select(chunk.alias("c")).dtypes)["c"]
    if chunk_kind in _NEVER_NULL:
        first = F.lit(-(1 << 63)) if chunk_kind == "bigint" else F.lit(_NEVER_NULL[chunk_kind]).cast(chunk_kind)
        chunk = F.coalesce(chunk, first)
    groups, nulls = {}, F.lit(0)
    for n, k in enumerate(keys):
        if kinds[k] in _NEVER_NULL:
            groups[f"__g{n}"] = F.coalesce(F.col(k), F.lit(_NEVER_NULL[kinds[k]]).cast(kinds[k]))
            nulls = nulls + F.when(F.col(k).isNull(), 1 << n).otherwise(0)
        else:
            groups[f"__g{n}"] = F.struct(F.col(k))
    return df.withColumns({**groups, "__z": nulls, "__chunk": chunk})


def _group_columns(parted: DataFrame) -> list[str]:
    return [c for c in parted.columns if c.startswith("__g") and c[3:].isdigit()] + ["__z"]


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    values: dict[str, Running],
    inclusive: bool = False,
) -> DataFrame:
    """Add a running value per name over the rows of the group before (or up to) each row.

    ``order`` must be a total order within a group, and ``chunk`` must not decrease along it.
    """
    rows = partition(df, keys, chunk).withColumns({f"__in_{n}": r.value for n, r in values.items()})
    part = [*_group_columns(rows), "__chunk"]
    within = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    across = W.partitionBy(*[f"__of{c}" for c in part[:-1]]).orderBy("__of__chunk").rowsBetween(W.unboundedPreceding, -1)
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])

    local, totals, carried, result = {}, [], [], {}
    for name, r in values.items():
        value, chunk_value = F.col(f"__in_{name}"), F.col(f"__t_{name}")
        here, prior = F.col(f"__l_{name}"), F.col(f"__p_{name}")
        if r.kind == "last":
            local[f"__l_{name}"] = F.last(value, ignorenulls=True).over(within)
            totals.append(F.max_by(value, F.when(value.isNotNull(), place)).alias(f"__t_{name}"))
            carried.append(F.last(chunk_value, ignorenulls=True).over(across).alias(f"__p_{name}"))
            result[name] = F.coalesce(here, prior)
        elif r.kind == "total":
            local[f"__l_{name}"] = F.sum(value).over(within)
            totals.append(F.sum(value).alias(f"__t_{name}"))
            carried.append(F.sum(chunk_value).over(across).alias(f"__p_{name}"))
            result[name] = F.coalesce(here + prior, here, prior, F.lit(0))
        else:
            extreme, pick = (F.max, F.greatest) if r.kind == "high" else (F.min, F.least)
            local[f"__l_{name}"] = extreme(value).over(within)
            totals.append(extreme(value).alias(f"__t_{name}"))
            carried.append(extreme(chunk_value).over(across).alias(f"__p_{name}"))
            result[name] = pick(here, prior)

    before = rows.groupBy(*[F.col(c).alias(f"__of{c}") for c in part]).agg(*totals)
    before = before.select(*[f"__of{c}" for c in part], *carried)
    known = F.lit(False)
    for name in values:
        known = known | F.col(f"__p_{name}").isNotNull()
    joined = rows.withColumns(local).join(before.filter(known), _same_part(part), "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in result.items()])


def _same_part(part: list[str]) -> Column:
    same = F.lit(True)
    for c in part:
        same = same & (F.col(c) == F.col(f"__of{c}"))
    return same


def numbered_changes(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, start: DataFrame | None = None
) -> DataFrame:
    """Add ``changed`` (value differs from the row before), ``number`` (changes so far) and ``previous``.

    ``start`` (keys, start_value, start_number) says what stands before a group's first row; without
    it the first row is a change. The rows are shuffled once; ``start`` meets one row per chunk.
    """
    local = partition(df, keys, chunk)
    groups = _group_columns(local)
    part = [*groups, "__chunk"]
    w = W.partitionBy(*part).orderBy(*order)
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    local = (
        local.withColumn("__now", F.struct(value.alias("v")))
        .withColumn("__lag", F.lag("__now").over(w))
        .withColumn("__step", F.when(F.col("__lag").isNull(), 0).otherwise((F.col("__lag") != F.col("__now")).cast("int")))
        .withColumn("__steps", F.sum("__step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    chunks = local.groupBy(*[F.col(c).alias(f"__of{c}") for c in part]).agg(
        F.min_by("__now", place).alias("__first"), F.max_by("__now", place).alias("__last"), F.sum("__step").alias("__sum")
    )
    across = W.partitionBy(*[f"__of{c}" for c in groups]).orderBy("__of__chunk")
    before = F.lag("__last").over(across)
    if start is None:
        chunks = chunks.withColumn("__base", F.lit(0))
    else:
        known = partition(start, keys, F.lit(0)).select(
            *groups, F.struct(F.col("start_value").alias("v")).alias("__begin"), F.col("start_number").alias("__base")
        )
        chunks = chunks.join(known, _same_part(groups), "left").drop(*groups)
        before = F.coalesce(before, F.col("__begin"))
    chunks = chunks.withColumn("__before", before).withColumn(
        "__turn", F.coalesce((F.col("__before") != F.col("__first")).cast("int"), F.lit(1))
    )
    made = F.sum(F.col("__turn") + F.col("__sum")).over(across.rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")
    chunks = chunks.select(
        *[f"__of{c}" for c in part], "__turn", (F.coalesce("__base", F.lit(0)) + made).alias("__number"),
        F.col("__before.v").alias("__v"),
    )
    joined = local.join(chunks, _same_part(part))
    return joined.select(
        *df.columns,
        (F.when(F.col("__lag").isNull(), F.col("__turn")).otherwise(F.col("__step")) == 1).alias("changed"),
        (F.col("__number") + F.col("__steps")).cast("bigint").alias("number"),
        F.when(F.col("__lag").isNull(), F.col("__v")).otherwise(F.col("__lag.v")).alias("previous"),
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "rank") -> DataFrame:
    """Add the position (from 1) of each row within its group."""
    return running(df, keys, order, chunk, {name: total(F.lit(1))}, inclusive=True)


def trailing(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    rows_back: int,
    aggs: dict,
    block: int = 1 << 18,
) -> DataFrame:
    """Add aggregates over the ``rows_back`` rows before each row of its group.

    Rows are numbered, cut into blocks by number, and the last rows of a block are lent to the next
    one, so the frame never needs a whole group in one task. ``aggs`` maps a name to a function of
    the window.
    """
    numbered = ranked(df, keys, order, chunk, "__n")
    own = F.floor((F.col("__n") - 1) / block)
    reach = F.floor((F.col("__n") - 1 + rows_back) / block)
    lent = numbered.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(own, reach)))
    frame = W.partitionBy(*keys, "__block").orderBy("__n").rowsBetween(-rows_back, -1)
    return (
        lent.withColumns({name: make(frame) for name, make in aggs.items()})
        .filter(F.col("__block") == F.col("__own"))
        .select(*df.columns, *aggs)
    )
