"""Gates, decisions, threshold contracts and content hashes. A missing input fails a gate; it is never unknown."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import ed25519

COMPARE = {
    ">=": lambda x, y: x >= y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, "<": lambda x, y: x < y, "=": lambda x, y: x == y,
}


def gates(conditions: dict[str, Column]) -> Column:
    """map<name, passed>, a null condition having failed."""
    return F.create_map(*(x for name, c in conditions.items() for x in (F.lit(name), F.coalesce(c, F.lit(False)))))


def failed(gate_map: Column) -> Column:
    """The names of the gates that failed, in their order."""
    return F.map_keys(F.map_filter(gate_map, lambda _, ok: ~ok))


def decision(gated: Column, killed: Column, failures: Column) -> Column:
    """DATA_GATED before KILL before REJECT before PASS."""
    return F.when(F.coalesce(gated, F.lit(True)), "DATA_GATED").when(F.coalesce(killed, F.lit(True)), "KILL").when(F.size(failures) > 0, "REJECT").otherwise("PASS")


def deployable(dsr: Column, pbo: Column, beats: Column) -> Column:
    """At least 0.95, strictly below 0.20, and better than the baseline."""
    return F.coalesce((dsr >= 0.95) & (pbo < 0.20) & beats & ~F.isnan(dsr) & ~F.isnan(pbo), F.lit(False))


def check_contract(metrics: DataFrame, contract: DataFrame, key: str) -> DataFrame:
    """key, check, value, threshold and passed for each check of the contract (check, metric, op, threshold) and each
    key of metrics (key, metric, value); a metric that is missing or not finite fails."""
    keys = metrics.select(key).distinct()
    due = keys.join(F.broadcast(contract), F.lit(True))
    joined = due.join(metrics.select(key, "metric", "value"), [key, "metric"], "left")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    held = reduce(lambda out, o: F.when(F.col("op") == o, COMPARE[o](F.col("value"), F.col("threshold"))).otherwise(out), COMPARE, F.lit(False))
    return joined.select(key, "check", "value", "threshold", F.coalesce(finite & held, F.lit(False)).alias("passed"))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The object without content_hash, keys sorted, without blanks, other than ASCII escaped; null if it is no object.
    Numbers keep the form that they were written in: whole ones stay whole."""

    def one(raw: str | None) -> str | None:
        try:
            value = json.loads(raw)
            value.pop("content_hash", None)
            return json.dumps(value, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError, AttributeError):
            return None

    return text.map(one)


def verify_hashes(documents: DataFrame, skip: list[str], name: str = "name", raw: str = "raw") -> DataFrame:
    """name, status and digest: PASS or FAIL of the stated content_hash against that of the canonical bytes, SKIP for
    names to skip, for what does not parse and for what states none. Also reported: matches_without_time, whether the
    hash fits once generated_at is left out."""
    stated = F.regexp_replace(F.get_json_object(raw, "$.content_hash"), "^sha256:", "")
    kept = documents.withColumn("_c", canonical_json(F.col(raw))).withColumn("_s", stated)
    digest = F.sha2("_c", 256)
    skipped = F.col(name).isin(*skip) | F.col("_c").isNull() | F.col("_s").isNull()
    bare = F.sha2(_without_time(F.col("_c")), 256)
    status = F.when(skipped, "SKIP").when(digest == F.col("_s"), "PASS").otherwise("FAIL")
    return kept.select(name, status.alias("status"), digest.alias("digest"), (~skipped & (bare == F.col("_s"))).alias("matches_without_time"))


@F.pandas_udf(StringType())
def _without_time(text: pd.Series) -> pd.Series:
    def one(raw: str | None) -> str | None:
        if raw is None:
            return None
        value = json.loads(raw)
        value.pop("generated_at", None)
        return json.dumps(value, sort_keys=True, separators=(",", ":"))

    return text.map(one)


def verify_signatures(documents: DataFrame, name: str = "name", payload: str = "payload", digest: str = "digest", signature: str = "signature", key: str = "key") -> DataFrame:
    """name and status: PASS if the stated digest is that of the canonical payload and the Ed25519 signature (hex) over
    the digest's bytes fits the public key (hex), else FAIL, also where one of them is null or malformed."""

    @F.pandas_udf("boolean")
    def fits(keys: pd.Series, signatures: pd.Series, digests: pd.Series) -> pd.Series:
        def one(*hexes: str | None) -> bool:
            try:
                return ed25519.verify(*(bytes.fromhex(x) for x in hexes))
            except (TypeError, ValueError):  # not hexadecimal, or null
                return False

        return pd.Series([one(*x) for x in zip(keys, signatures, digests)], dtype=bool)

    same = F.sha2(canonical_json(F.col(payload)), 256) == F.col(digest)
    ok = F.coalesce(same & fits(F.col(key), F.col(signature), F.col(digest)), F.lit(False))
    return documents.select(name, F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def signed(documents: DataFrame, secret: bytes, digest: str = "digest", signature: str = "signature") -> DataFrame:
    """documents with signature, the Ed25519 signature (hex) over the bytes of the digest (hex); null for a null one."""

    @F.pandas_udf("string")
    def run(digests: pd.Series) -> pd.Series:
        return digests.map(lambda x: None if x is None else ed25519.sign(secret, bytes.fromhex(x)).hex())

    return documents.withColumn(signature, run(digest))


def known_spans(revisions: DataFrame, key: list[str], revision: str, known: str) -> DataFrame:
    """revisions with known_until, when the next revision of the same key became known; null for the last one. A revision
    that is known no earlier than a later one never held."""
    later = Window.partitionBy(*key).orderBy(revision).rowsBetween(1, Window.unboundedFollowing)  # a row a revision
    return revisions.withColumn("known_until", F.min(known).over(later))


def state_hash(rows: DataFrame, group: list[str], line: Column) -> DataFrame:
    """group and state: a digest of the group's rows, each stated as a whole by line, in any order; repeated rows count.
    Null lines count as empty ones.

    It is SHA-256 of the number of rows and the sums of four parts of 60 bits of each line's SHA-256, so rows are added up
    where they are and no group is held together. It tells replays apart, not forgeries that are made to collide."""
    digest = F.sha2(F.coalesce(line, F.lit("")), 256)
    parts = [F.sum(F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(20,0)")) for k in (1, 16, 31, 46)]
    sums = rows.groupBy(*group).agg(F.count("*").cast("string").alias("_n"), *(p.cast("string").alias(f"_p{k}") for k, p in enumerate(parts)))
    return sums.select(*group, F.sha2(F.concat_ws(":", "_n", *(f"_p{k}" for k in range(4))), 256).alias("state"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
