"""Readers and writers of documents, ledgers and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from ..operators import shared


def documents(spark: SparkSession, path: str, glob: str = "*.json", skip: tuple[str, ...] = ()) -> DataFrame:
    """name and raw, the whole text of each file, so that hashes are of the bytes as they are; top level only. Skipped
    names are not read."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw"))
    return named.filter(~F.col("name").isin(*skip)) if skip else named


def typed(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """One row for each JSON document of a known schema. Strict: the first that does not fit fails; else it is null."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(schema).json(path)


CORRUPT = "_corrupt_record"


def tolerant(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame | None]:
    """Each named JSON document, None where it is missing or not JSON; the others are read all the same."""
    out: dict[str, DataFrame | None] = {}
    for name, path in paths.items():
        try:
            found = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
            out[name] = None if CORRUPT in found.columns else found
        except AnalysisException:
            out[name] = None
    return out


def all_or_nothing(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame] | None:
    """All named documents, or None if one is missing or not JSON."""
    found = tolerant(spark, paths)
    return None if None in found.values() else found


def quarantined(spark: SparkSession, path: str, schema: StructType, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a folder of JSON documents: those that fit schema, with file, and file, reason and raw of the
    others. reason: not_json, or not_of_schema for JSON with a value of another type. Every document is in one of them;
    an empty file is no document."""
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    read = reader.option("pathGlobFilter", glob).schema(wide).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    read = shared.written(read, "parsed")  # parsed once, for both
    rows = read.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    reason = F.when(F.try_parse_json(CORRUPT).isNull(), "not_json").otherwise("not_of_schema")
    rejects = read.filter(F.col(CORRUPT).isNotNull()).select("file", reason.alias("reason"), F.col(CORRUPT).alias("raw"))
    return rows, rejects


def whole_or_none(spark: SparkSession, path: str, schema: StructType, expected: list[str], glob: str = "*.json") -> DataFrame | None:
    """The rows of a folder of JSON documents if all files expected are there and none is rejected, else None: one bad
    document voids the set."""
    rows, rejects = quarantined(spark, path, schema, glob)
    if not rejects.isEmpty():
        return None
    missing = spark.createDataFrame([(x,) for x in expected], "file string").join(rows.select("file"), "file", "left_anti")
    return rows if missing.isEmpty() else None


def readable_parquet(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a folder of Parquet files: files that cannot be read are skipped and named in rejects (file,
    reason), not dropped silently. Only files that gave no row are looked into: one that ends as Parquet does is empty, not
    broken."""
    reader = spark.read.option("ignoreCorruptFiles", True).schema(schema)
    rows = reader.parquet(path)
    gave = rows.select(F.col("_metadata.file_name").alias("file")).distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select(F.col("_metadata.file_name").alias("file"), "content", "length")
    silent = files.join(gave, "file", "left_anti")
    ends = F.substring(F.col("content"), -4, 4) == F.lit("PAR1").cast("binary")
    reason = F.when(F.col("length") < 12, "too_short").when(~ends, "no_footer")
    return rows, silent.select("file", reason.alias("reason")).filter("reason IS NOT NULL")


def lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A ledger of one JSON object a line."""
    return spark.read.schema(schema).json(path)


def colon_pairs(spark: SparkSession, path: str) -> DataFrame:
    """name, title and pairs of files with a title line and 'key: value' lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.split("value", "\r?\n").alias("l"))
    kept = F.filter(F.slice("l", F.lit(2), F.size("l")), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    return whole.select("name", F.element_at("l", 1).alias("title"), F.map_from_entries(F.transform(kept, pair)).alias("pairs"))


def delimited(spark: SparkSession, path: str, schema: StructType | str, separator: str = "|") -> DataFrame:
    return spark.read.option("sep", separator).option("header", True).schema(schema).csv(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """name and html of whole files, gzip or plain."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("html"))


def report(df: DataFrame, path: str) -> None:
    """A JSON report, one object a line."""
    df.write.mode("overwrite").json(path)


def fresh(df: DataFrame, at: str, now: str, seconds: int = 60) -> DataFrame:
    """Cached values that are not older than so many seconds at the time now."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    return df.filter(age.between(0, seconds))
