"""Gates and verification (G rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ed25519
from ..operators import governance as G
from .registry import Tables, query

PER_USER = "u AS (SELECT user_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (WHERE event_type = 'error') / count(*) AS errors FROM events GROUP BY 1)"


def per_user(t: Tables) -> DataFrame:
    errors = F.count_if(F.col("event_type") == "error") / F.count("*")
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), errors.alias("errors"))


@query(f"""WITH {PER_USER}, f AS (SELECT user_id, n, mean, list_filter(['coverage', 'level', 'quality'], lambda g: NOT coalesce(CASE g WHEN 'coverage' THEN n >= 60 WHEN 'level' THEN mean > 20 ELSE errors < 0.2 END, false)) AS bad FROM u)
 SELECT user_id, array_to_string(bad, ',') AS blocking_reasons, CASE WHEN n < 40 THEN 'DATA_GATED' WHEN mean < 10 THEN 'KILL' WHEN len(bad) > 0 THEN 'REJECT' ELSE 'PASS' END AS decision FROM f""")
def gates_to_decision(t: Tables) -> DataFrame:
    u = per_user(t).withColumn("g", G.gates({"coverage": F.col("n") >= 60, "level": F.col("mean") > 20, "quality": F.col("errors") < 0.2}))
    bad = G.failed(F.col("g"))
    return u.select("user_id", F.array_join(bad, ",").alias("blocking_reasons"), G.decision(F.col("n") < 40, F.col("mean") < 10, bad).alias("decision"))


@query(f"WITH {PER_USER} SELECT user_id, coalesce(mean / 30 >= 0.95 AND errors < 0.20 AND mean > sd, false) AS deploy FROM u")
def deploy_rule(t: Tables) -> DataFrame:
    return per_user(t).select("user_id", G.deployable(F.col("mean") / 30, F.col("errors"), F.col("mean") > F.col("sd")).alias("deploy"))


@query("SELECT user_id, coalesce(bool_or(value > 250 OR (event_type = 'error' AND value > 100)), true) AS killed FROM events GROUP BY 1")
def kill_rules(t: Tables) -> DataFrame:
    rule = (F.col("value") > 250) | ((F.col("event_type") == "error") & (F.col("value") > 100))
    return t.events.groupBy("user_id").agg(F.coalesce(F.bool_or(rule), F.lit(True)).alias("killed"))


CONTRACT = [("c1", "n", ">=", 60.0), ("c2", "mean", ">", 20.0), ("c3", "errors", "<", 0.2), ("c4", "turnover", "<=", 5.0)]


@query(f"""WITH {PER_USER}, m AS (SELECT user_id, unnest(['n', 'mean', 'errors']) AS metric, unnest([n::DOUBLE, mean, errors]) AS value FROM u), c("check", metric, op, threshold) AS (VALUES ('c1', 'n', '>=', 60.0::DOUBLE), ('c2', 'mean', '>', 20), ('c3', 'errors', '<', 0.2), ('c4', 'turnover', '<=', 5))
 SELECT u.user_id, c."check", round(m.value, 6) AS value, c.threshold, coalesce(CASE op WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold ELSE value <= threshold END, false) AS passed FROM u CROSS JOIN c LEFT JOIN m ON m.user_id = u.user_id AND m.metric = c.metric""")
def threshold_contract(t: Tables) -> DataFrame:
    u = per_user(t).select("user_id", F.col("n").cast("double").alias("n"), "mean", "errors")
    metrics = u.unpivot("user_id", ["n", "mean", "errors"], "metric", "value")
    contract = t.spark.createDataFrame(CONTRACT, "check string, metric string, op string, threshold double")
    return G.check_contract(metrics, contract, "user_id").withColumn("value", F.round("value", 6))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'pending' WHEN role = 'system' THEN 'head' ELSE 'anchored at ' || turn END AS label FROM conversations""")
def anchor_status(t: Tables) -> DataFrame:
    role = F.col("role")
    label = F.when(role == "user", F.lit("pending")).when(role == "system", F.lit("head")).otherwise(F.concat(F.lit("anchored at "), F.col("turn").cast("string")))
    return t.conversations.select("conv_id", "turn", label.alias("label"))


@query("""WITH v AS (SELECT user_id, event_id, 0 AS revision, floor(value * 1000 + 0.5)::BIGINT AS amount, ts AS known FROM events UNION ALL SELECT user_id, event_id, 1, floor(value * 2000 + 0.5)::BIGINT, ts + INTERVAL 7 DAY FROM events WHERE event_type = 'error'),
 k AS (SELECT user_id, event_id, max(revision) AS revision, arg_max(amount, revision) AS amount FROM v WHERE known < TIMESTAMP '2024-01-15' GROUP BY ALL), h AS (SELECT user_id, sha256(event_id || '/' || revision || '=' || amount) AS d FROM k),
 s AS (SELECT user_id, count(*) || ':' || sum(('0x' || substr(d, 1, 15))::BIGINT) || ':' || sum(('0x' || substr(d, 16, 15))::BIGINT) || ':' || sum(('0x' || substr(d, 31, 15))::BIGINT) || ':' || sum(('0x' || substr(d, 46, 15))::BIGINT) AS x FROM h GROUP BY 1)
 SELECT user_id, sha256(x) AS state, true AS invariant FROM s""")
def slice_invariance(t: Tables) -> DataFrame:
    """What each user's events were at a time, errors being amended a week later: replayed from all revisions, by when
    each was superseded, and from the revisions until then only. The digest, and whether both are the same."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    events = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    amount = lambda x: F.floor(F.col("value") * x + 0.5).cast("long").alias("amount")
    first = events.select("user_id", "event_id", F.lit(0).alias("revision"), amount(1000), F.col("ts").alias("known"))
    amended = events.filter("event_type = 'error'").select("user_id", "event_id", F.lit(1).alias("revision"), amount(2000), F.expr("ts + INTERVAL '7' DAY").alias("known"))
    revisions = first.unionByName(amended)

    def state(rows: DataFrame) -> DataFrame:
        spans = G.known_spans(rows, ["user_id", "event_id"], "revision", "known")
        held = spans.filter((F.col("known") < at) & (F.col("known_until").isNull() | (F.col("known_until") >= at)))
        return G.state_hash(held, ["user_id"], F.format_string("%d/%d=%d", "event_id", "revision", "amount"))

    cut = state(revisions.filter(F.col("known") < at)).withColumnRenamed("state", "again")
    return state(revisions).join(cut, "user_id", "full").select("user_id", "state", F.coalesce(F.col("state") == F.col("again"), F.lit(False)).alias("invariant"))


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS n, conv_id % 5 AS kind FROM conversations),
 c AS (SELECT *, '{"conv_id":' || conv_id || ',"n":' || n || ',"turn":' || turn || '}' AS bare, '{"conv_id":' || conv_id || ',"generated_at":"2026-01-01","n":' || n || ',"turn":' || turn || '}' AS stamped FROM r)
 SELECT conv_id || '/' || turn AS name, CASE kind WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 4 THEN 'FAIL' ELSE 'SKIP' END AS status,
 CASE kind WHEN 3 THEN NULL WHEN 4 THEN sha256(stamped) ELSE sha256(bare) END AS digest, kind IN (0, 4) AS matches_without_time FROM c""")
def content_hash_verify(t: Tables) -> DataFrame:
    """A document for each turn, by the conversation's number sound, hashed before it was altered, without a hash, broken,
    or hashed before its time stamp was put in."""
    kind = F.col("conv_id") % 5
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    bare = lambda n: F.format_string('{"conv_id":%d,"n":%d,"turn":%d}', "conv_id", n, "turn")
    digest = F.sha2(bare(F.when(kind == 1, F.col("n") + 1).otherwise(F.col("n"))), 256)
    stated = F.when(kind != 2, F.format_string(', "content_hash": "sha256:%s"', digest)).otherwise("")
    stamp = F.when(kind == 4, ', "generated_at": "2026-01-01"').otherwise("")
    raw = F.concat(F.format_string('{"turn": %d, "n": %d, "conv_id": %d', "turn", "n", "conv_id"), stamp, stated, F.when(kind == 3, "").otherwise("}"))
    return G.verify_hashes(rows.select(F.concat_ws("/", "conv_id", "turn").alias("name"), raw.alias("raw")), ["manifest"])


#: The secret of a published test vector, a stand-in for one that nobody knows.
TEST_SECRET = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")


@query("""SELECT source AS name, CASE WHEN count(*) % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM documents GROUP BY 1""")
def signature_verify(t: Tables) -> DataFrame:
    """A signed manifest for each source; those that count an odd number of documents are signed for one more."""
    sources = t.documents.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    payload = lambda n: F.format_string('{"chars":%d,"n":%d}', "chars", n)
    stated = F.sha2(payload(F.col("n") + F.col("n") % 2), 256)
    signed = G.signed(sources.select("name", payload("n").alias("payload"), stated.alias("digest")), TEST_SECRET)
    return G.verify_signatures(signed.withColumn("key", F.lit(ed25519.public_key(TEST_SECRET).hex())))
