"""Joins (J rows) over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals, ordered, timeline
from .registry import Tables, query


@query("""SELECT o.o_orderkey, coalesce(c.c_name, 'customer ' || o.o_custkey) AS name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey""")
def lookup_default(t: Tables) -> DataFrame:
    names = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    default = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", "o_custkey").join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", default).alias("name"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_ids(t: Tables) -> DataFrame:
    ids = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi")


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)""")
def anti_names(t: Tables) -> DataFrame:
    large = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(large, "c_custkey", "left_anti")


@query("""WITH d AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
 SELECT d.event_id, d.user_id, r.value AS rate FROM d ASOF LEFT JOIN r ON d.user_id = r.user_id AND r.ts <= d.ts""")
def asof_available_revision(t: Tables) -> DataFrame:
    decisions = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    revisions = t.events.filter("event_type = 'view'").select("user_id", "ts", "value")
    return timeline.as_of(decisions, revisions, "user_id", "ts", "ts", "value", "rate").select("event_id", "user_id", "rate")


STATES = "SELECT event_id, user_id, event_type, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, value FROM events"


def states(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", "event_type", F.col("ts").alias("since"), F.lead("ts").over(line).alias("until"), "value")


@query(f"""WITH s AS ({STATES}), n AS (SELECT event_id, user_id, ts AS start, ts + INTERVAL 10 MINUTE AS stop FROM events WHERE event_type = 'click')
 SELECT n.event_id, count(s.event_id) AS n_quotes, CASE count(s.event_id) WHEN 1 THEN 'covered' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status
 FROM n LEFT JOIN s ON s.user_id = n.user_id AND s.since <= n.start AND s.until >= n.stop GROUP BY 1""")
def interval_cover(t: Tables) -> DataFrame:
    needs = t.events.filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("stop"))
    return timeline.cover(needs, states(t), "user_id", ("start", "stop"), ("since", "until")).select("event_id", "n_quotes", "status")


@query("""WITH s AS (SELECT user_id, ts AS a, ts + INTERVAL 6 HOUR AS b, CASE event_type WHEN 'click' THEN ts + INTERVAL 90 MINUTE ELSE ts END AS v FROM events WHERE event_type IN ('click', 'view')),
 e AS (SELECT user_id, a AS start, 1 AS step, 0 AS seen FROM s UNION ALL SELECT user_id, b, -1, 0 FROM s UNION ALL SELECT user_id, v, 0, 1 FROM s UNION ALL SELECT user_id, b, 0, -1 FROM s),
 g AS (SELECT user_id, start, sum(step) AS step, sum(seen) AS seen FROM e GROUP BY ALL),
 w AS (SELECT user_id, start, lead(start) OVER p AS stop, sum(step) OVER (p ROWS UNBOUNDED PRECEDING) AS depth, sum(seen) OVER (p ROWS UNBOUNDED PRECEDING) AS seen FROM g WINDOW p AS (PARTITION BY user_id ORDER BY start))
 SELECT user_id, start, stop, depth::BIGINT AS depth, seen::BIGINT AS seen, CASE WHEN depth = 0 THEN 'no_effective_status' WHEN seen = 0 THEN 'status_not_yet_available' ELSE 'covered' END AS label FROM w WHERE stop IS NOT NULL""")
def coverage_sweep(t: Tables) -> DataFrame:
    """A click is known an hour and a half late, a view at once."""
    late = F.when(F.col("event_type") == "click", F.col("ts") + F.expr("INTERVAL 90 MINUTES")).otherwise(F.col("ts"))
    spans = t.events.filter("event_type IN ('click', 'view')").select("user_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("b"), late.alias("v"))
    found = timeline.sweep(spans, "user_id", "a", "b", "v")
    return found.withColumn("label", timeline.coverage_label(F.col("depth"), F.col("seen")))


@query("""WITH r AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts DESC, event_id) AS k
 FROM events WHERE ts < TIMESTAMP '2024-01-20') SELECT user_id, event_type, event_id, ts < TIMESTAMP '2024-01-10' AS usable FROM r WHERE k = 1""")
def status_precedence(t: Tables) -> DataFrame:
    rank = F.struct(F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2).alias("r"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), F.col("event_id").alias("e"))
    effective = t.events.filter("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    found = timeline.by_precedence(effective, ["user_id"], rank, F.expr("ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return found.select("user_id", "event_type", "event_id", "usable")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status_code, round(o_totalprice, 2) AS total, o_orderdate::DATE AS available FROM orders WHERE o_orderkey % 11 <> 0),
 b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status_code, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS total, o_orderdate::DATE + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE -1 END AS available FROM orders WHERE o_orderkey % 13 <> 0),
 j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, a.status_code IS DISTINCT FROM b.status_code AS ds, a.total IS DISTINCT FROM b.total AS dt, greatest(a.available, b.available) AS available FROM a FULL JOIN b ON a.k = b.k)
 SELECT k, CASE WHEN bk IS NULL THEN 'official_only' WHEN ak IS NULL THEN 'vendor_only' WHEN ds OR dt THEN 'differ' ELSE 'agree' END AS status,
 CASE WHEN ak IS NULL OR bk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ds THEN 'status_code' END, CASE WHEN dt THEN 'total' END) END AS differing, available FROM j""")
def reconcile_sources(t: Tables) -> DataFrame:
    k, total, day = F.col("o_orderkey"), F.round("o_totalprice", 2), F.col("o_orderdate").cast("date")
    official = t.orders.filter(k % 11 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("status_code"), total.alias("total"), day.alias("available"))
    vendor = t.orders.filter(k % 13 != 0).select(
        k.alias("k"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status_code"), F.when(k % 7 != 0, total).alias("total"),
        F.date_add(day, F.when(k % 3 == 0, 2).otherwise(-1)).alias("available"),
    )
    return timeline.reconcile(official, vendor, ["k"], ["status_code", "total"], ["available"])


@query("""WITH p AS (SELECT source, doc_id, lag(doc_id) OVER w AS previous, lag(n_chars) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
 SELECT doc_id, previous, CASE WHEN previous IS NULL THEN 'first' WHEN n < 300 THEN 'unusable' ELSE 'pair' END AS status FROM p""")
def predecessor_pairs(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", "n_chars")
    before = ordered.with_previous(rows, ["doc_id"], ["doc_id", "n_chars"], ["previous", "n"], ["source"])
    return before.select("doc_id", "previous", F.when(F.col("previous").isNull(), "first").when(F.col("n") < 300, "unusable").otherwise("pair").alias("status"))


@query("""WITH q AS (SELECT c_custkey, c_acctbal AS lo, c_acctbal + 50 AS hi, c_nationkey AS g FROM customer)
 SELECT s.s_suppkey, count(q.c_custkey) AS n, CASE count(q.c_custkey) WHEN 1 THEN 'mapped' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status
 FROM supplier s LEFT JOIN q ON q.g = s.s_nationkey AND s.s_acctbal >= q.lo AND s.s_acctbal < q.hi GROUP BY 1""")
def containment_mapping(t: Tables) -> DataFrame:
    bands = t.customer.select("c_custkey", F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 50).alias("hi"), F.col("c_nationkey").alias("g"))
    inside = (F.col("s_acctbal") >= F.col("lo")) & (F.col("s_acctbal") < F.col("hi"))
    suppliers = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    met = intervals.stabbed(suppliers, "s_acctbal", bands, "lo", "hi", {"s_nationkey": "g"}, inside)
    n = met.groupBy("s_suppkey").agg(F.count("c_custkey").alias("n"))
    return n.withColumn("status", F.when(F.col("n") == 1, "mapped").when(F.col("n") == 0, "missing").otherwise("ambiguous"))


@query("""WITH m AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup')
 SELECT event_id, (SELECT arg_min(value, (q.ts, value)) FROM events q WHERE q.event_type = 'view' AND q.user_id = m.user_id AND q.ts >= m.ts AND q.ts <= m.ts + INTERVAL 1 HOUR) AS entry,
 (SELECT arg_max(value, (q.ts, value)) FROM events q WHERE q.event_type = 'view' AND q.user_id = m.user_id AND q.ts <= m.ts AND q.ts >= m.ts - INTERVAL 30 MINUTE) AS exit FROM m""")
def first_after_last_before(t: Tables) -> DataFrame:
    marks = t.events.filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    quotes = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), "value")
    found = timeline.first_after_last_before(marks, quotes, "user_id", "ts", "at", "value", "1 HOUR", "30 MINUTES")
    return found.select("event_id", "entry", "exit")


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT day, n FROM d WHERE n > 3),
 c AS (SELECT b.day, x.k, b.day - (7 * x.k)::INT AS control FROM b, (VALUES (1), (2), (3), (4)) x(k))
 SELECT c.day, count(d.day) AS controls, round(avg(d.n), 6) AS control_mean FROM c LEFT JOIN d ON d.day = c.control AND d.day NOT IN (SELECT day FROM b) GROUP BY 1 HAVING count(d.day) >= 3""")
def matched_controls(t: Tables) -> DataFrame:
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    busy = days.filter("n > 3").select("day")
    controls = busy.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("control", F.date_sub("day", F.col("k") * 7))
    calm = days.join(busy, "day", "left_anti").select(F.col("day").alias("control"), "n")
    found = controls.join(calm, "control").groupBy("day").agg(F.count("n").alias("controls"), F.round(F.avg("n"), 6).alias("control_mean"))
    return found.filter("controls >= 3")


@query("""SELECT o_orderpriority, count(*) AS orders_, round(avg(CASE WHEN c.c_custkey IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS matched FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) c ON c.c_custkey = o.o_custkey GROUP BY 1""")
def join_coverage(t: Tables) -> DataFrame:
    known = t.customer.filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"), F.lit(1.0).alias("hit"))
    joined = t.orders.select("o_custkey", "o_orderpriority").join(known, "o_custkey", "left")
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("orders_"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("matched"))


@query("""SELECT count(*) FILTER (WHERE o.k IS NOT NULL) AS mapped, count(*) FILTER (WHERE o.k IS NULL) AS outside FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c.c_custkey""")
def identity_resolution(t: Tables) -> DataFrame:
    seen = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("seen")).distinct()
    joined = t.customer.select("c_custkey").join(seen, "c_custkey", "left")
    return joined.agg(F.count_if("seen").alias("mapped"), F.count_if(F.col("seen").isNull()).alias("outside"))


@query("""WITH d AS (SELECT DISTINCT o_orderpriority AS p, o_orderdate::DATE AS day FROM orders), e AS (SELECT p, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
 s AS (SELECT DISTINCT day FROM d), w AS (SELECT max(lo) AS start, min(hi) AS stop FROM e)
 SELECT *, missing = 0 AND start <= stop AS usable FROM (SELECT e.p AS sleeve, w.start, w.stop, (SELECT count(*) FROM s WHERE s.day BETWEEN w.start AND w.stop AND NOT EXISTS (SELECT 1 FROM d WHERE d.p = e.p AND d.day = s.day)) AS missing FROM e, w)""")
def common_window(t: Tables) -> DataFrame:
    days = t.orders.select(F.col("o_orderpriority").alias("sleeve"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    ends = days.groupBy("sleeve").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    shared = ends.agg(F.max("lo").alias("start"), F.min("hi").alias("stop"))  # one row
    holes = timeline.gaps(days, days, "sleeve", "day").join(F.broadcast(shared), F.col("day").between(F.col("start"), F.col("stop")))
    n = holes.groupBy("sleeve").agg(F.count("*").alias("missing"))
    named = ends.select("sleeve").join(n, "sleeve", "left").withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))
    # a sleeve with a gap inside the window fails, as does every sleeve if there is no window
    return named.join(F.broadcast(shared), F.lit(True)).withColumn("usable", (F.col("missing") == 0) & (F.col("start") <= F.col("stop")))


@query("""WITH d AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts + to_hours(event_id % 5 - 2) AS e, ts + to_hours(event_id % 3 - 1) AS a, value AS v FROM events WHERE event_type = 'view'),
 j AS (SELECT d.event_id, max({'e': r.e, 'a': r.a, 'v': r.v}) FILTER (WHERE r.e <= d.ts) AS best, coalesce(bool_or(r.e > d.ts), false) AS ahead FROM d LEFT JOIN r ON r.user_id = d.user_id AND r.a <= d.ts GROUP BY 1)
 SELECT event_id, CASE WHEN NOT ahead THEN best.v END AS rate, CASE WHEN ahead THEN 'future_known' WHEN best IS NULL THEN 'missing' ELSE 'ok' END AS status FROM j""")
def asof_both_axes(t: Tables) -> DataFrame:
    """Revisions take effect and become known at times of their own; a decision with one known ahead fails closed."""
    hours = lambda n: F.make_interval(hours=n.cast("int"))
    decisions = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    revisions = t.events.filter("event_type = 'view'").select(
        "user_id", (F.col("ts") + hours(F.col("event_id") % 5 - 2)).alias("e"), (F.col("ts") + hours(F.col("event_id") % 3 - 1)).alias("a"), "value"
    )
    found = timeline.known_as_of(decisions, revisions, "user_id", "ts", "e", "a", "value", "rate")
    status = F.when(F.col("future_known"), "future_known").when(F.col("rate").isNull(), "missing").otherwise("ok")
    return found.select("event_id", F.when(~F.col("future_known"), F.col("rate")).alias("rate"), status.alias("status"))
