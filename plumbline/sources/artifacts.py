"""Parquet artifacts that are bound to a manifest of their parts' lengths and SHA-256 digests.

The manifest is written after the parts, so an artifact without one is unfinished. Reading takes the digests anew, on
the executors, and fails where a part was altered, is missing or was added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part int, length long, sha256 string"


class Altered(ValueError):
    """An artifact whose parts are not those of its manifest."""


def parts(spark: SparkSession, path: str) -> DataFrame:
    """part, length and sha256 of each part file. Parts are known by their number, as names differ in every run. A part
    is digested in one piece: keep them below 2 GB by maxRecordsPerFile."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").load(f"{path}/parts")
    number = F.regexp_extract("path", r"part-(\d+)-", 1).cast("int")
    return files.select(number.alias("part"), "length", F.sha2("content", 256).alias("sha256"))


def write(df: DataFrame, path: str) -> None:
    """Writes df and its manifest under path. The same rows in the same order and parts give the same manifest."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(f"{path}/parts")
    manifest = parts(df.sparkSession, path)
    manifest.repartitionByRange(1, "part").sortWithinPartitions("part").write.mode("overwrite").json(f"{path}/manifest")


def differences(spark: SparkSession, path: str) -> DataFrame:
    """part and status (altered, missing, unexpected) of the parts that are not as the manifest says."""
    said = spark.read.schema(MANIFEST).json(f"{path}/manifest").select("part", F.struct("length", "sha256").alias("said"))
    there = parts(spark, path).select("part", F.struct("length", "sha256").alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("said").isNull(), "unexpected").when(F.col("said") != F.col("there"), "altered")
    return said.join(there, "part", "full_outer").select("part", status.alias("status")).filter("status IS NOT NULL")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The artifact's rows, once its parts were found to be those of the manifest; else Altered names some that differ."""
    wrong = differences(spark, path).orderBy("part").limit(10).collect()
    if wrong:
        raise Altered(", ".join(f"part {r.part} {r.status}" for r in wrong))
    return spark.read.parquet(f"{path}/parts")
