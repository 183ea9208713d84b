"""Ledger unions, sorts, top rows, samples and set operations (O, U, part of A and W rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger, ordered
from .registry import Tables, query


@query("""WITH u AS (SELECT o_orderkey, o_totalprice AS amount, 'KILLED' AS verdict, 'killed' AS segment, 0 AS segment_order, o_orderstatus = 'F' AS keep FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT o_orderkey, o_totalprice / 2, 'SCREEN', 'screen', 1, o_orderstatus = 'F' FROM orders WHERE o_orderpriority = '5-LOW')
 SELECT o_orderkey, round(amount, 6) AS amount, verdict, segment, segment_order, row_number() OVER (ORDER BY segment_order, keep DESC, amount DESC, o_orderkey) AS place,
 count(*) OVER (PARTITION BY segment) AS n_segment, count(*) FILTER (WHERE keep) OVER (PARTITION BY segment) AS n_keep FROM u""")
def kill_ledger_union(t: Tables) -> DataFrame:
    keep = (F.col("o_orderstatus") == "F").alias("keep")
    killed = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_totalprice").alias("amount"), F.lit("KILLED").alias("verdict"), keep)
    screen = t.orders.filter("o_orderpriority = '5-LOW'").select("o_orderkey", (F.col("o_totalprice") / 2).alias("amount"), F.lit("SCREEN").alias("verdict"), keep)
    both = ledger.tagged_union({"killed": killed, "screen": screen})
    counts = both.groupBy("segment").agg(F.count("*").alias("n_segment"), F.count_if("keep").alias("n_keep"))  # a row for each segment
    line = "segment_order", F.desc("keep"), F.desc("amount"), "o_orderkey"
    numbered = ordered.numbered(both, line, into="place").join(F.broadcast(counts), "segment")
    return numbered.select("o_orderkey", F.round("amount", 6).alias("amount"), "verdict", "segment", "segment_order", "place", "n_segment", "n_keep")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, k AS rank, greatest(0, n - 15) AS more FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE k <= 15""")
def topk_overflow(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ledger.top_with_overflow(rows, ["l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 15)


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT user_id, event_id, value FROM r WHERE i % greatest(1, ceil(n / 24)::BIGINT) = 0""")
def systematic_downsample(t: Tables) -> DataFrame:
    return ledger.thinned(t.events.select("user_id", "event_id", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 24).drop("ts")


@query("""WITH d(event_type, place) AS (VALUES ('purchase', 1), ('refund', 2), ('view', 3), ('click', 4)), p AS (SELECT event_type, row_number() OVER (ORDER BY place) AS number FROM d WHERE event_type IN (SELECT event_type FROM events))
 SELECT number::INT AS number, event_type, count(*) AS n FROM events JOIN p USING (event_type) GROUP BY ALL""")
def declared_order(t: Tables) -> DataFrame:
    found = ledger.in_declared_order(t.events.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", ["purchase", "refund", "view", "click"])
    return found.select("number", "event_type", "n")


@query("""SELECT p_brand, p_partkey, lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS number FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)""")
def display_index(t: Tables) -> DataFrame:
    rows = ordered.numbered(t.part.select("p_brand", "p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], ["p_brand"])
    return rows.select("p_brand", "p_partkey", S.padded(F.col("number"), 4).alias("number"))


@query("""SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY coalesce(CASE WHEN c_acctbal > 1000 THEN c_acctbal END, 0), c_custkey) AS place FROM customer""")
def null_as_zero_sort(t: Tables) -> DataFrame:
    known = F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal"))
    rows = t.customer.select("c_mktsegment", "c_custkey", F.coalesce(known, F.lit(0.0)).alias("balance"))
    return ordered.numbered(rows, ["balance", "c_custkey"], ["c_mktsegment"], into="place", keep=["c_mktsegment", "c_custkey"])


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""")
def first_n(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("""SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size < 10""")
def union_distinct(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).union(t.part.filter("p_size < 10").select("p_partkey")).distinct()


A_B = "a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O')"


def a_and_b(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in "FO")


@query(f"WITH {A_B} (SELECT id, 'a_only' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) UNION ALL (SELECT id, 'b_only' FROM (SELECT id FROM b EXCEPT SELECT id FROM a))")
def except_both_ways(t: Tables) -> DataFrame:
    a, b = a_and_b(t)
    return a.subtract(b).withColumn("side", F.lit("a_only")).unionByName(b.subtract(a).withColumn("side", F.lit("b_only")))


@query(f"""WITH {A_B}, i AS (SELECT id FROM a INTERSECT SELECT id FROM b) SELECT (SELECT count(*) FROM i) AS common, (SELECT count(*) FROM a) = (SELECT count(*) FROM i) AND (SELECT count(*) FROM b) = (SELECT count(*) FROM i) AS equal""")
def set_equality(t: Tables) -> DataFrame:
    sides = ledger.set_differences(*a_and_b(t))
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0).cast("long"))
    return sides.agg(n("both").alias("common"), (n("left_only") + n("right_only") == 0).alias("equal"))


@query(f"WITH {A_B} SELECT (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS missing, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS unexpected")
def missing_unexpected(t: Tables) -> DataFrame:
    sides = ledger.set_differences(*a_and_b(t))
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0).cast("long"))
    return sides.agg(n("left_only").alias("missing"), n("right_only").alias("unexpected"))


@query("""SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS place FROM documents) WHERE place <= 5""")
def hash_sample_per_group(t: Tables) -> DataFrame:
    return ledger.hash_sample(t.documents.select("source", "doc_id"), ["source"], "doc_id", 5)


@query("""SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN contains(text, '|') THEN 'table' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def attrition_ledger(t: Tables) -> DataFrame:
    reasons = [("short", F.col("n_chars") < 100), ("language", ~F.col("lang").isin("en", "de")), ("table", F.contains("text", F.lit("|")))]
    return ledger.attrition(t.documents, reasons)


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
 SELECT user_id, count(*) AS records, count(*) FILTER (WHERE k > 1) AS remeasured, count(*) FILTER (WHERE k = 1) AS identities, round(var_samp(value) FILTER (WHERE k = 1), 8) AS variance FROM r GROUP BY 1""")
def trial_accounting(t: Tables) -> DataFrame:
    first = ledger.first_records(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    records = t.events.groupBy("user_id").agg(F.count("*").alias("records"))
    units = first.groupBy("user_id").agg(F.count("*").alias("identities"), F.round(F.var_samp("value"), 8).alias("variance"))
    return records.join(units, "user_id").withColumn("remeasured", F.col("records") - F.col("identities"))


@query("""WITH r AS (SELECT event_type, user_id, event_id % 4 AS profile, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events),
 c AS (SELECT event_type, user_id, count(*) AS n, count(DISTINCT profile) AS p, max(value) FILTER (WHERE k = 1) AS v FROM r GROUP BY ALL)
 SELECT event_type, sum(n)::BIGINT AS records, sum(n - p)::BIGINT AS remeasured, sum(p - 1)::BIGINT AS duplicates, count(*) AS identities, round(var_samp(v), 6) AS variance FROM c GROUP BY 1""")
def trial_profiles(t: Tables) -> DataFrame:
    rows = t.events.withColumn("profile", F.col("event_id") % 4)
    return ledger.accounting(rows, ["event_type"], ["profile"], ["user_id"], ["ts", "event_id"], "value").withColumn("variance", F.round("variance", 6))
