"""The corpus pipeline: toxic texts, near copies and benchmark passages go, personal values are replaced, tokens counted.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, minhash, pii, toxicity, workspace
from plumbline.llm.queries import DEMO_SECRET, tokenizer_path


def unused(docs: DataFrame, name: str) -> str:
    """A name like the given one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the cut; a null or empty text scores low and stays, as does a row without
    an id."""
    model, score = toxicity.train(docs, workspace.table(spark, sf_dir, "labels")), unused(docs, "score")
    return toxicity.score(docs, model, into=score).filter(F.col(score) < toxicity.CUT).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id, and of repeated rows one. Documents without an
    id or without words have no near copies: those without an id all stay.

    Rows are told apart by doc_id. Where one stands on several rows they are told apart by a hash of id and text, so a
    copy of another document goes even if its namesake stays."""
    known = docs.filter(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        copies = minhash.near_duplicates(known.select("doc_id", "text")).filter("NOT kept").select("doc_id")
        copies = minhash.small_side(workspace.stage(copies, "copies"))
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    row = unused(docs, "row")
    keyed = known.withColumn(row, F.xxhash64("doc_id", "text"))
    classes = minhash.near_duplicates(keyed.select(row, "text"), key=row).select(row, "class_id")
    least = keyed.select(row, "doc_id").distinct().join(classes.distinct(), row).groupBy("class_id").agg(F.min_by(row, F.struct("doc_id", row)).alias(row))
    kept = keyed.join(minhash.small_side(workspace.stage(least.select(row), "kept")), row, "left_semi").dropDuplicates([row])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover less than the share of every benchmark item; those with a null or empty text stay."""
    share = unused(docs, "coverage")
    covered = decontaminate.coverage(docs, workspace.table(spark, sf_dir, "benchmark"), into=share)
    return covered.filter(F.col(share) < decontaminate.SHARE).drop(share)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal values and n_chars of the new text; a null text stays null."""
    out = pii.pseudonymise(docs, DEMO_SECRET, counts=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of token ids and decoded text; a null or empty text has none, of an empty digest."""
    shared = bpe.load(spark, tokenizer_path())
    return bpe.round_trip(docs.select("doc_id", "text"), shared).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal),
    ("bpe", encode_and_decode),
]
#: Toxicity, near copies and encoding have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each one's result written to the shared folder; it goes when the
    next one is there."""
    docs, held = workspace.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = workspace.stage(stage(spark, docs, sf_dir), name)
        if held is not None:
            workspace.drop(held)
        held = docs
    return docs
