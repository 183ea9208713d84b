"""The queries of this subpackage over the driver tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, licenses, lm, minhash, pii, prefix_trie, resample, secrets, token_files, toxicity, warc, workspace
from .workspace import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, indexed and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL["op1_warc_archive"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p),
     f AS (SELECT h, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND d.n >= 100
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each whole text, and of the text that they decode to."""
    shared = bpe.load(spark, tokenizer_path())
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), shared).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of each whole text: the base kinds by the contract, and all kinds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("found")
    base = tuple(r.kind for r in secrets.BASE)
    n = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.scan(docs).select(
        "doc_id",
        *(n(kind) for kind in base),
        F.sha2(secrets.joined(found, base), 256).alias("base_sha256"),
        secrets.joined(found, tuple(r.kind for r in secrets.RULES)).alias("spans"),
    )


#: A stand-in for the secret that a deployment passes in; whoever knows it can undo the permutations.
DEMO_SECRET = "not a secret: replace it"


@query
def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with their personal values replaced, and how many of each kind."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_SECRET)
    n = lambda kind: F.coalesce(F.col("pii")[kind], F.lit(0)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(n(kind) for kind in pii.KINDS), "text")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with each item that their tiles cover enough of."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs.select("doc_id", "text"), items, ["doc_id"])


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each whole text by the classifier trained on the label model's posterior labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
    )


@query
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and interpolated score of each whole text."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op5_embedding_links"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda y: CASE WHEN isfinite(y) THEN 0 ELSE 1 END), 'sum') = 0
    AND list_aggregate(list_transform(embedding, lambda y: abs(y)), 'max') > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.component_id, m.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM c GROUP BY a) m ON m.a = e.vec_id
"""


@query
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of each document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence sentences of each whole text, and the licences that the rules find in their sequence."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "sequence", "licenses")


SQL["op2_license_scan"] = licenses.duckdb_sql()


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back: where each document's ids lie, and their digest."""
    path = workspace.new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.with_crc(token_files.read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weights towards the benchmark's texts, and the ranks of the drawn quarter."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))
