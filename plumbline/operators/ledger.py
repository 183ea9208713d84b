"""Ledgers: unions with tags, attrition, first records, top rows with overflow, thinning, declared order, set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tagged_union(parts: dict[str, DataFrame], tag: str = "segment", place: str = "segment_order") -> DataFrame:
    """All rows of the parts, missing columns null, with the part's name and its place in the given order."""
    out = None
    for k, (name, df) in enumerate(parts.items()):
        one = df.withColumn(tag, F.lit(name)).withColumn(place, F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def attrition(rows: DataFrame, reasons: list[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """reason and n: each row counts for the first reason that holds, else as kept, so the counts add up to all rows. A
    condition that is null does not hold."""
    reason = F.lit(kept)
    for name, condition in reversed(reasons):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def first_records(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Of each identity the first row in order; what follows is a remeasurement. Aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in identity]
    first = rows.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*identity, "_f.*")


def top_with_overflow(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in order, with their rank and more, the number of rows left out of the group."""
    n = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    line = Window.partitionBy(*group).orderBy(*order)
    top = rows.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
    return top.join(n, group).withColumn("more", F.greatest(F.lit(0), F.col("_n") - k)).drop("_n")


def thinned(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """Every step-th row of each group, from the first on, with the least step that leaves at most so many."""
    n = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    line = Window.partitionBy(*group).orderBy(*order)
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    placed = rows.withColumn("_i", F.row_number().over(line) - 1).join(n, group)
    return placed.filter(F.col("_i") % step == 0).drop("_i", "_n")


def in_declared_order(rows: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """Rows whose column is declared, with number: the place among the declared values that are there at all."""
    spark = rows.sparkSession
    places = spark.createDataFrame(list(enumerate(declared)), f"_place int, {column} string")
    there = rows.select(column).distinct().join(F.broadcast(places), column)
    numbered = there.withColumn("number", F.row_number().over(Window.orderBy("_place"))).drop("_place")  # one row a value
    return rows.join(F.broadcast(numbered), column)


def hash_sample(rows: DataFrame, group: list[str], key: str, k: int) -> DataFrame:
    """k rows of each group, the same ones whenever it is run: those whose key has the smallest SHA-256."""
    line = Window.partitionBy(*group).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return rows.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= k)


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """side and n: how many distinct rows only left has, only right has and both have."""
    cols = left.columns
    sides = left.select(*cols, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*cols, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    found = sides.groupBy(*cols).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left_only").otherwise("right_only")
    return found.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def accounting(rows: DataFrame, by: list[str], profile: list[str], identity: list[str], order: list[str], value: str) -> DataFrame:
    """by, records, remeasured, duplicates, identities and variance: records less remeasurements of an identity within its
    profile, less those profiles of it beyond one, are the identities; the sample variance is that of their first records
    in order alone. Counted per identity and profile before anything else, so a busy identity is one row."""
    one = rows.groupBy(*by, *identity, *profile).agg(F.count("*").alias("_n"), F.min(F.struct(F.struct(*order).alias("o"), F.col(value).alias("v"))).alias("_f"))
    ids = one.groupBy(*by, *identity).agg(F.sum("_n").alias("_n"), F.count("*").alias("_p"), F.min("_f")["v"].alias("_v"))
    return ids.groupBy(*by).agg(
        F.sum("_n").alias("records"), F.sum(F.col("_n") - F.col("_p")).alias("remeasured"), F.sum(F.col("_p") - 1).alias("duplicates"),
        F.count("*").alias("identities"), F.var_samp("_v").alias("variance"),
    )
