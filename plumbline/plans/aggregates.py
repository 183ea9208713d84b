"""Aggregations (A rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import selection
from .registry import Tables, query


@query("""SELECT event_type, min(value) AS low, max(value) AS high, CASE WHEN max(value) = min(value) THEN 1 ELSE round(max(value) - min(value), 6) END AS span FROM events GROUP BY 1""")
def domain_min_max(t: Tables) -> DataFrame:
    span = F.coalesce(F.nullif(F.round(F.max("value") - F.min("value"), 6), F.lit(0.0)), F.lit(1.0))
    return t.events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), span.alias("span"))


@query("""SELECT c_nationkey, greatest(0.5, max(abs(c_acctbal))) AS scale FROM customer GROUP BY 1""")
def max_abs_floor(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.greatest(F.lit(0.5), F.max(F.abs("c_acctbal"))).alias("scale"))


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS passed, count(*) FILTER (WHERE NOT o_totalprice > 100000) AS failed, bool_and(o_totalprice > 100000) AS all_pass FROM orders GROUP BY 1""")
def pass_fail_tally(t: Tables) -> DataFrame:
    ok = F.col("o_totalprice") > 100000
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.bool_and(ok).alias("all_pass"))


@query("""SELECT l_returnflag, coalesce(nullif(round(sum(CASE WHEN l_discount > 0.05 THEN 1.4 ELSE 1 END), 4), 0), 1)::DOUBLE AS weight FROM lineitem GROUP BY 1""")
def weighted_sum(t: Tables) -> DataFrame:
    total = F.sum(F.when(F.col("l_discount") > 0.05, 1.4).otherwise(1.0))
    return t.lineitem.groupBy("l_returnflag").agg(F.coalesce(F.nullif(F.round(total, 4), F.lit(0.0)), F.lit(1.0)).alias("weight"))


@query("""SELECT user_id, bool_or(value > 90) AS any_large, bool_and(value >= 0) AS all_positive FROM events GROUP BY 1""")
def any_all(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.bool_or(F.col("value") > 90).alias("any_large"), F.bool_and(F.col("value") >= 0).alias("all_positive"))


@query("""SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_keys(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT DISTINCT lang, source FROM documents""")
def distinct_set(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source").distinct()


@query("""SELECT year(o_orderdate)::INT AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL""")
def counts_by_year(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_scope(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().cast("long").alias("level"))


@query("""SELECT event_type, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS complete, round(avg(CASE WHEN dayofweek(ts) = 2 THEN 1.0 ELSE 0.0 END), 6) AS tuesday, round(count(DISTINCT user_id) / count(*), 6) AS unique_rate FROM events GROUP BY 1""")
def completeness_rates(t: Tables) -> DataFrame:
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return t.events.groupBy("event_type").agg(
        rate(F.col("value") > 10).alias("complete"), rate(F.dayofweek("ts") == 3).alias("tuesday"), F.round(F.count_distinct("user_id") / F.count("*"), 6).alias("unique_rate")
    )


@query("""SELECT l_linestatus, min(l_quantity) AS low, quantile_cont(l_quantity, 0.5) AS mid, max(l_quantity) AS high, round(avg((l_quantity >= 10)::INT), 6) AS share_10, round(avg((l_quantity >= 40)::INT), 6) AS share_40 FROM lineitem GROUP BY 1""")
def threshold_shares(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    share = lambda least: F.round(F.avg((q >= least).cast("double")), 6).alias(f"share_{least}")
    shares = t.lineitem.groupBy("l_linestatus").agg(F.min(q).alias("low"), F.max(q).alias("high"), share(10), share(40))
    return shares.join(selection.quantiles(t.lineitem, ["l_linestatus"], "l_quantity", {"mid": 0.5}), "l_linestatus")


@query("""SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def exact_quantiles(t: Tables) -> DataFrame:
    found = selection.quantiles(t.events, ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")))


@query("""SELECT flag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM (SELECT *, l_returnflag AS flag FROM lineitem) GROUP BY 1""")
def distinct_exact(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT o_custkey, coalesce(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) + coalesce(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS closed, count(*) FILTER (WHERE o_totalprice > 150000) AS passed, count(*) AS total FROM orders GROUP BY 1""")
def gates_passed(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg((F.count_if(s == "F") + F.count_if(s == "P")).alias("closed"), F.count_if(F.col("o_totalprice") > 150000).alias("passed"), F.count("*").alias("total"))
