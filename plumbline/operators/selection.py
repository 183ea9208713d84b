"""Exact quantiles by selection: counts of cells narrow down where each rank lies, and only that cell's rows are sorted.

Nothing keeps the distinct values of a group: a pass adds up CELLS counts for each rank that is sought, with the least
and the greatest value in each, which are the ends of the next pass's cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Cells of a pass, rows that are sorted at last in one task, and rows of sought ranks that are broadcast.
CELLS, SMALL, FEW = 4096, 50_000, 100_000


def _same(by: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by], F.lit(True))


def _met(data: DataFrame, sought: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows that may be of a sought rank."""
    named = sought.withColumnsRenamed({c: f"_t_{c}" for c in by})
    named = F.broadcast(named) if sought.count() <= FEW else named
    return data.join(named, _same(by) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop(*(f"_t_{c}" for c in by))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """by and a column for each of at, its name to a share from 0 to 1: the quantile of value in each group, interpolated
    between the two ranks next to it. Nulls, NaN and infinities are left out; a group of nothing else is not there. by
    must name a column; a null is a group."""
    v = F.col(value).cast("double")
    data = rows.select(*by, v.alias("_v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ends = shared.written(data.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "ends")
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in at.values()))))
    open_ = shared.written(ends.select(*by, F.explode(ranks).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_size")), "sought")
    done = []
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_size") > SMALL)
    while not open_.filter(wide).isEmpty():
        done.append(open_.filter(~wide))
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        cell = F.least(F.lit(CELLS - 1), F.floor(share * CELLS).cast("int")).alias("_cell")
        met = _met(data, open_.filter(wide), by).groupBy(*by, "_k", "_below", cell)
        counts = met.agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        line = Window.partitionBy(*by, "_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # CELLS rows
        upto = counts.withColumn("_upto", F.col("_below") + F.sum("_c").over(line))
        hit = upto.filter((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
        open_ = shared.written(hit.select(*by, "_k", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_size")), "sought")
    last = reduce(DataFrame.unionByName, done, open_)
    flat = last.filter(F.col("_lo") == F.col("_hi")).select(*by, "_k", F.col("_lo").alias("_x"))
    some = last.filter(F.col("_lo") < F.col("_hi"))
    line = Window.partitionBy(*by, "_k").orderBy("_v")  # SMALL rows at most
    found = _met(data, some, by).withColumn("_i", F.row_number().over(line)).filter(F.col("_i") == F.col("_k") - F.col("_below") + 1)
    found = flat.unionByName(found.select(*by, "_k", F.col("_v").alias("_x"))).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_m"))
    named = found.withColumnsRenamed({c: f"_t_{c}" for c in by})
    both = ends.join(named, _same(by))

    def between(p: float) -> Column:
        low, high = F.col("_m")[F.floor(place(p))], F.col("_m")[F.ceil(place(p))]
        return low + (high - low) * (place(p) - F.floor(place(p)))

    return both.select(*by, *(between(p).alias(name) for name, p in at.items()))
