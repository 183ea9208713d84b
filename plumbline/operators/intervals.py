"""Joins of points with the spans that hold them, by cells of a grid instead of a range over a whole key.

A span lies on the level whose cells are at least as long as it is, so it touches two or three of them however long it
is; a point asks one cell of each level that has spans. Key, level and cell are equal then, and the exact condition
is tested on what meets there. A span is on one level and a point in one cell of it, so no pair comes twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's cells are so many times as long as those of the one below; the lowest level's are of length 1.
STEP = 4.0


def axis(df: DataFrame, column: str) -> Column:
    """A number for a value of the column: microseconds of a timestamp, days of a date, the value of a number."""
    kind = dict(df.dtypes)[column]
    at = F.col(column)
    if kind.startswith("timestamp"):
        return F.unix_micros(at.cast("timestamp")).cast("double")
    return F.unix_date(at).cast("double") if kind == "date" else at.cast("double")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(STEP), level))


def with_cells(spans: DataFrame, since: str, until: str) -> DataFrame:
    """spans with _level and _cell, a row for each cell that a span touches. A span without an end, or whose end comes
    before its start, touches none and goes."""
    a, b = axis(spans, since), axis(spans, until)
    level = F.when(b - a > 1, F.ceil(F.log(b - a) / F.log(F.lit(STEP)))).otherwise(0).cast("int")
    placed = spans.filter(a <= b).withColumn("_level", level)
    return placed.withColumn("_cell", F.explode(F.sequence(_cell(a, F.col("_level")), _cell(b, F.col("_level")))))


def levels(celled: DataFrame) -> list[int]:
    """The levels that have spans: at most some thirty for all the numbers that there are."""
    return sorted(r[0] for r in celled.select("_level").distinct().collect())


def at_cells(points: DataFrame, at: str, found: list[int]) -> DataFrame:
    """points with _level and _cell, a row for each of the levels found; a point that is null has no cell but stays."""
    every = points.withColumn("_level", F.explode(F.array(*(F.lit(x) for x in found or [0]))))
    return every.withColumn("_cell", _cell(axis(points, at), F.col("_level")))


def stabbed(points: DataFrame, at: str, spans: DataFrame, since: str, until: str, keys: dict[str, str], condition: Column) -> DataFrame:
    """Each row of points with the spans of its key that touch its cell and meet condition, null where a level has none
    (so a point without any span is there, once or more). keys: the points' columns and the spans' that equal them;
    columns of both sides must have different names."""
    celled = with_cells(spans, since, until)
    asked = at_cells(points, at, levels(celled))
    held = celled.withColumnsRenamed({"_level": "_span_level", "_cell": "_span_cell"})
    same = [F.col(a) == F.col(b) for a, b in keys.items()] + [F.col("_level") == F.col("_span_level"), F.col("_cell") == F.col("_span_cell")]
    joined = asked.join(held, reduce(Column.__and__, same) & condition, "left")
    return joined.drop("_level", "_cell", "_span_level", "_span_cell")
