"""Order over all rows without a window over few keys: numbers, predecessors and running totals by range partitions.

Rows are dealt out by ranges of the order and written with their part and place in it. What a part's rows need to know
of earlier parts is one small row for each part and key: how many rows there were, the last one, or their total. So a key
that holds most of the table is in as many parts as its rows fill.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

PART, PLACE = "_part", "_place"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def laid(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str] | None = None) -> DataFrame:
    """A written table of keep's columns (all, if none are named), with the part of each row and its place in it (from
    0). Rows are in the order of keys and order over all parts; rows that tie may be in several parts, in any order."""
    line = [_column(x) for x in (*keys, *order)]
    dealt = df.repartitionByRange(*line, F.monotonically_increasing_id()).sortWithinPartitions(*line)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return shared.written(dealt.select(*(keep or df.columns), F.spark_partition_id().alias(PART), place.alias(PLACE)), "laid")


def _with_edges(rows: DataFrame, keys: Sequence[str], found: Sequence[Column], carried: Sequence[Column]) -> DataFrame:
    """rows with found, aggregates of each part and key, and carried, columns of those of earlier parts of the key."""
    edges = rows.groupBy(PART, *keys).agg(*found)
    edges = edges.select(*(F.col(c).alias(f"_e{c}") for c in (PART, *keys)), *carried)
    # without keys there is a row a part, which is few enough to go everywhere
    edges = edges if keys else F.broadcast(edges)
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_e{c}")) for c in (PART, *keys)])
    return rows.join(edges, on).drop(*(f"_e{c}" for c in (PART, *keys)))


def _earlier(keys: Sequence[str]):
    """Earlier parts of the key: as many rows as it has parts."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), into: str = "number", keep: Sequence[str] | None = None) -> DataFrame:
    """df (or keep's columns) with column into: the row's number from 1 in order, within its key or over all rows. Rows
    that tie are numbered in any order. Null keys are a key; an empty table stays empty."""
    rows = laid(df, keys, order, keep)
    found = F.min(PLACE).alias("_first"), F.count("*").alias("_n")
    carried = "_first", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before")
    both = _with_edges(rows, keys, found, [_column(x) for x in carried])
    return both.withColumn(into, F.col(PLACE) - F.col("_first") + F.col("_before") + 1).drop(PART, PLACE, "_first", "_before")


def with_previous(df: DataFrame, order: Sequence[Column | str], values: Sequence[str], into: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """df with into: the values of the row just before in order, of the same key; null for a key's first row. A part's
    rows look at each other; only its first row of a key takes the last one of an earlier part."""
    rows = laid(df, keys, order)
    last = F.max_by(F.struct(*values), PLACE).alias("_last")
    carried = F.last("_last").over(_earlier(keys)).alias("_carried")
    both = _with_edges(rows, keys, [last], [carried])
    inside = Window.partitionBy(PART, *keys).orderBy(PLACE)
    before = F.when(F.row_number().over(inside) > 1, F.lag(F.struct(*values)).over(inside)).otherwise(F.col("_carried"))
    taken = both.withColumn("_before", before)
    return taken.select(*df.columns, *(F.col("_before")[v].alias(n) for v, n in zip(values, into)))


def running_total(df: DataFrame, order: Sequence[Column | str], value: str, into: str = "total", keys: Sequence[str] = ()) -> DataFrame:
    """df with column into: the sum of value over the key's rows up to and with this one. Rows that tie come in any
    order; a null value adds nothing."""
    rows = laid(df, keys, order)
    carried = F.coalesce(F.sum("_sum").over(_earlier(keys)), F.lit(0)).alias("_before")
    both = _with_edges(rows, keys, [F.coalesce(F.sum(value), F.lit(0)).alias("_sum")], [carried])
    inside = Window.partitionBy(PART, *keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(into, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_before")).drop(PART, PLACE, "_before")


def carried(df: DataFrame, order: Sequence[Column | str], value: str, into: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with column into: the last value that is not null among the key's rows up to and with this one."""
    rows = laid(df, keys, order)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(PLACE))).alias("_last")
    before = F.last("_last", ignorenulls=True).over(_earlier(keys)).alias("_before")
    both = _with_edges(rows, keys, [last], [before])
    inside = Window.partitionBy(PART, *keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(into, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_before"))).drop(PART, PLACE, "_before")


def on_lines(df: DataFrame, points: DataFrame, key: str, at: str, x: str, y: str, into: str) -> DataFrame:
    """df with column into: the height at its column at of the line through its key's points, level beyond both ends. Rows
    whose key has no points at all are left out; a null place has a null height. Of points at one place the largest y
    holds. points: key, x, y.

    Each point is met with the next one and carried to the rows behind it, so a key with many rows on both sides is
    sorted, not joined or searched row by row. A key's line begins with a point at no place, which knows only the next.
    """
    curve = points.filter(F.col(key).isNotNull() & F.col(x).isNotNull()).groupBy(key, F.col(x).alias("_x")).agg(F.max(y).alias("_y"))
    begin = points.filter(F.col(key).isNotNull()).select(key).distinct()
    nothing = [F.lit(None).cast(curve.schema[c].dataType).alias(c) for c in ("_x", "_y")]
    steps = with_previous(curve.union(begin.select(key, *nothing)), [F.col("_x").desc_nulls_last()], ["_x", "_y"], ["_x1", "_y1"], [key])
    marks = steps.select(key, F.col("_x").alias("_t"), F.lit(0).alias("_side"), F.struct("_x", "_y", "_x1", "_y1").alias("_s"))
    lines = df.filter(F.col(key).isNotNull()).withColumns({"_t": F.col(at), "_side": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    met = carried(lines, ["_t", "_side"], "_s", "_step", [key]).filter("_side = 1 AND _step IS NOT NULL")
    x0, y0, x1, y1 = (F.col("_step")[c] for c in ("_x", "_y", "_x1", "_y1"))
    between = y0 + (y1 - y0) * (F.col(at) - x0) / (x1 - x0)
    height = F.when(F.col(at).isNotNull(), F.when(x0.isNull(), y1).when(x1.isNull(), y0).otherwise(between))
    return met.select(*df.columns, height.alias(into))
