"""Execution arithmetic (X rows): line items stand in for orders, their parts for instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import execution as X
from .registry import Tables, query

KEYS = ("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0 ELSE least(l_quantity, floor(l_tax * 1e6 * 0.1 / (l_extendedprice / l_quantity))) END AS filled FROM lineitem""")
def capped_fill(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return t.lineitem.select(*KEYS, X.capped_fill(F.col("l_quantity"), price, F.col("l_tax") * 1e6, 0.1).alias("filled"))


@query("""WITH v AS (SELECT l_partkey, sum(l_extendedprice) AS adv FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round(0.02 * sqrt(l_extendedprice / adv) * 1e4, 6) AS bps,
 CASE WHEN l_extendedprice / adv > 0.05 THEN 'blocked' WHEN l_extendedprice / adv > 0.01 THEN 'warn' ELSE 'ok' END AS status FROM lineitem JOIN v USING (l_partkey)""")
def sqrt_impact(t: Tables) -> DataFrame:
    adv = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("adv"))
    n, v = F.col("l_extendedprice"), F.col("adv")
    return t.lineitem.join(adv, "l_partkey").select(*KEYS, F.round(X.impact(n, v, F.lit(0.02)) * 1e4, 6).alias("bps"), X.impact_status(n, v).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, round(-(CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END) * l_extendedprice * (l_discount - 0.05) / 100, 6) + 0 AS payment FROM lineitem""")
def funding(t: Tables) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return t.lineitem.select(*KEYS, (F.round(X.funding(side, F.col("l_extendedprice"), (F.col("l_discount") - 0.05) / 100), 6) + 0.0).alias("payment"))


@query("""SELECT o_orderkey, round(round(o_totalprice, 4)::DECIMAL(18,4) * (CASE o_orderstatus WHEN 'F' THEN 0.03 WHEN 'O' THEN 0.05 ELSE 0.01 END)::DECIMAL(9,6) * day(o_orderdate) / (CASE o_orderstatus WHEN 'O' THEN 365 ELSE 360 END) + 1e-8, 4)::DOUBLE AS interest FROM orders""")
def financing_accrual(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    rate = F.when(s == "F", 0.03).when(s == "O", 0.05).otherwise(0.01)
    days = F.dayofmonth("o_orderdate")
    amount = F.round("o_totalprice", 4)
    by_basis = F.when(s == "O", X.accrual(amount, rate, days, 365)).otherwise(X.accrual(amount, rate, days, 360))
    return t.orders.select("o_orderkey", F.round(by_basis.cast("double") + 1e-8, 4).alias("interest"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, least(l_quantity, greatest(coalesce(nullif(l_tax, 0) * 500, 0), 0)) AS granted, l_discount * 300 AS recalled, l_discount FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(granted, 6) AS granted, round(greatest(0, least(recalled, granted)), 6) AS cover, round(granted * l_discount * l_linenumber * 100 * 0.3 / 365, 6) AS fee FROM g""")
def locate_and_recall(t: Tables) -> DataFrame:
    granted = X.locate(F.col("l_quantity"), F.nullif(F.col("l_tax"), F.lit(0.0)) * 500)
    fee = X.borrow_fee(granted, F.col("l_discount"), F.col("l_linenumber") * 100, F.lit(0.3))
    return t.lineitem.select(*KEYS, F.round(granted, 6).alias("granted"), F.round(X.recall(granted, F.col("l_discount") * 300), 6).alias("cover"), F.round(fee, 6).alias("fee"))


@query("""WITH m AS (SELECT l_suppkey, count(*) / 3.0 AS days, nullif(max(l_tax), 0) AS flow, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS sells FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, days / 0.5 AS stressed, flow, sells FROM m)
 SELECT l_suppkey, round(stressed, 6) AS stressed, CASE WHEN flow <= 0.07 AND stressed <= 400 THEN 'ok' WHEN sells > 0.36 THEN 'reduce_only' WHEN flow IS NULL THEN 'unassessable' ELSE 'blocked' END AS status,
 concat_ws(',', CASE WHEN flow IS NULL THEN 'flow missing' END, CASE WHEN stressed > 400 THEN 'days over limit' END, CASE WHEN flow > 0.07 THEN 'flow over limit' END) AS reasons FROM s""")
def crowding_gate(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_suppkey").agg((F.count("*") / 3.0).alias("days"), F.nullif(F.max("l_tax"), F.lit(0.0)).alias("flow"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("sells"))
    stressed = X.stressed_days(F.col("days"), F.lit(0.5))
    status, reasons = X.limits([("days", stressed, 400.0), ("flow", F.col("flow"), 0.07)], F.col("sells") > 0.36)
    return m.select("l_suppkey", F.round(stressed, 6).alias("stressed"), status.alias("status"), reasons.alias("reasons"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS now, (o_orderdate::DATE + (o_orderkey % 20)::INT - 2) AS fn, (o_orderdate::DATE + (o_custkey % 15)::INT) AS lt FROM orders)
 SELECT o_orderkey, CASE WHEN least(fn, lt) - now < 0 THEN 'expired' WHEN least(fn, lt) - now <= 5 THEN 'roll' ELSE 'hold' END AS decision FROM d""")
def roll_decision(t: Tables) -> DataFrame:
    now = F.col("o_orderdate").cast("date")
    notice = F.date_add(now, (F.col("o_orderkey") % 20 - 2).cast("int"))
    last = F.date_add(now, (F.col("o_custkey") % 15).cast("int"))
    return t.orders.select("o_orderkey", X.roll(now, notice, last, 5).alias("decision"))


@query("""WITH p AS (SELECT l_orderkey, min(floor(l_quantity / (1 + l_linenumber % 3)))::BIGINT AS u, 10 AS w, CASE WHEN l_orderkey % 2 = 0 THEN 'FOK' ELSE 'IOC' END AS k, sum((1 + l_linenumber % 3) * CASE l_returnflag WHEN 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS d FROM lineitem GROUP BY l_orderkey)
 SELECT l_orderkey, CASE WHEN d > 250000.001 THEN 0 WHEN k = 'FOK' AND least(u, w) < w THEN 0 ELSE least(u, w) END AS filled FROM p""")
def package_fill(t: Tables) -> DataFrame:
    legs = t.lineitem.select("l_orderkey", "l_quantity", (1 + F.col("l_linenumber") % 3).alias("ratio"), F.lit(10).alias("wanted"), F.when(F.col("l_orderkey") % 2 == 0, "FOK").otherwise("IOC").alias("kind"), F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("debit"))
    return X.package_units(legs, "l_orderkey", "l_quantity", "ratio", "wanted", "kind", "debit", 250000.001)


@query("""WITH c AS (SELECT l_suppkey, l_linenumber % 4 AS scenario, sum(CASE l_returnflag WHEN 'R' THEN -l_extendedprice ELSE l_extendedprice / 4 END) AS p FROM lineitem GROUP BY ALL)
 SELECT l_suppkey, round(CASE WHEN count(*) = 4 THEN greatest(0, -min(p)) END, 2) AS margin, count(*) = 4 AS complete FROM c GROUP BY 1""")
def scenario_margin(t: Tables) -> DataFrame:
    pnl = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") / 4)
    cells = t.lineitem.select("l_suppkey", (F.col("l_linenumber") % 4).alias("scenario"), pnl.alias("pnl"))
    return X.worst_scenario(cells, "l_suppkey", "scenario", "pnl", 4).withColumn("margin", F.round("margin", 2))


@query("""SELECT l_orderkey, l_linenumber, least(greatest(round(round(l_extendedprice, 2)::DECIMAL(18,2) * l_tax::DECIMAL(9,6), 2), 50), 2000)::DOUBLE AS fee FROM lineitem""")
def fee_assessment(t: Tables) -> DataFrame:
    amount = F.round("l_extendedprice", 2)
    return t.lineitem.select(*KEYS, X.fee(amount, F.col("l_tax"), F.lit(50), F.lit(2000)).cast("double").alias("fee"))


@query("""WITH a AS (SELECT l_partkey, l_shipdate::DATE AS e, CASE WHEN l_quantity > 25 THEN 2.0::DOUBLE ELSE 1.0 END AS ratio, l_tax AS dividend FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate::DATE > DATE '1994-01-01'),
 w AS (SELECT *, coalesce(product(ratio) OVER (PARTITION BY l_partkey ORDER BY e RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 1) AS before FROM a),
 s AS (SELECT l_partkey, product(ratio) AS f, sum(dividend * before) AS paid FROM w GROUP BY 1)
 SELECT p_partkey, DATE '1994-01-01' AS "at", p_size::DOUBLE AS shares, p_retailprice AS price, p_size * coalesce(f, 1) AS adjusted_shares, round(p_retailprice / coalesce(f, 1), 6) AS adjusted_price, round(p_size * coalesce(paid, 0), 4) AS cash, 'ok' AS status FROM part LEFT JOIN s ON l_partkey = p_partkey""")
def split_dividend_replay(t: Tables) -> DataFrame:
    """Parts held since a customer's first order; each return of a part is an action on it."""
    holdings = t.part.select("p_partkey", F.lit("1994-01-01").cast("date").alias("at"), F.col("p_size").cast("double").alias("shares"), F.col("p_retailprice").alias("price"))
    actions = t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").cast("date").alias("effective"), F.date_sub(F.col("l_shipdate").cast("date"), 10).alias("announced"),
        F.when(F.col("l_quantity") > 25, 2.0).otherwise(1.0).alias("ratio"), F.col("l_tax").alias("dividend"),
    )
    found = X.replay(holdings, actions, "p_partkey", "at")
    return found.withColumns({"adjusted_price": F.round("adjusted_price", 6), "cash": F.round("cash", 4)})


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN -l_quantity ELSE l_quantity END AS n, l_extendedprice / l_quantity AS s, lag(l_extendedprice / l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(n * 50.0::DOUBLE * (s - b), 4) + 0 AS margin FROM p WHERE b IS NOT NULL""")
def variation_margin(t: Tables) -> DataFrame:
    """Between consecutive trades of a part; the first has no price before it."""
    side = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    before = F.lag(price).over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber"))
    rows = t.lineitem.select(*KEYS, side.alias("n"), price.alias("s"), before.alias("b")).filter("b IS NOT NULL")
    return rows.select(*KEYS, (F.round(X.variation_margin(F.col("n"), 50.0, F.col("b"), F.col("s")), 4) + 0.0).alias("margin"))


@query("""WITH c AS (SELECT p_brand, p_partkey::DOUBLE AS strike, 2000 - p_retailprice AS bid, 2010 - p_retailprice AS ask FROM part), m AS (SELECT *, (bid + ask) / 2 AS mid FROM c),
 s AS (SELECT *, (mid - lag(mid) OVER w) / (strike - lag(strike) OVER w) AS before, (lead(mid) OVER w - mid) / (lead(strike) OVER w - strike) AS after FROM m WINDOW w AS (PARTITION BY p_brand ORDER BY strike))
 SELECT p_brand, strike, bid, ask, bid > ask AS crossed, coalesce(before <= 0, true) AS monotone, coalesce(after >= before - 1e-12, true) AS convex FROM s""")
def chain_checks(t: Tables) -> DataFrame:
    chain = t.part.select("p_brand", F.col("p_partkey").cast("double").alias("strike"), (2000 - F.col("p_retailprice")).alias("bid"), (2010 - F.col("p_retailprice")).alias("ask"))
    return X.chain_checks(chain, ["p_brand"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN (l_returnflag = 'R' AND l_extendedprice > 30000) THEN l_quantity * 100 WHEN l_returnflag <> 'R' AND l_extendedprice < 30000 THEN -l_quantity * 100 ELSE 0 END AS shares,
 CASE WHEN (l_returnflag = 'R' AND l_extendedprice > 30000) THEN -l_quantity * 100 * 30000 WHEN l_returnflag <> 'R' AND l_extendedprice < 30000 THEN l_quantity * 100 * 30000 ELSE 0 END AS cash FROM lineitem""")
def deliverables(t: Tables) -> DataFrame:
    right = F.when(F.col("l_returnflag") == "R", "C").otherwise("P")
    shares, cash = X.deliverable(right, F.col("l_quantity"), F.lit(30000.0), F.col("l_extendedprice"))
    return t.lineitem.select(*KEYS, shares.cast("double").alias("shares"), cash.alias("cash"))


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT o_orderkey, (CASE WHEN o_custkey % 4 = 0 THEN -1 ELSE 1 END * round(o_totalprice * 100))::HUGEINT AS cash, round(coalesce(v, 0) * 100)::HUGEINT AS short,
 day(o_orderdate)::HUGEINT AS d, CASE o_orderstatus WHEN 'F' THEN 360 WHEN 'O' THEN 365 END AS y FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
 c AS (SELECT *, least(greatest(cash, 0), short) AS seg, greatest(cash, 0) - least(greatest(cash, 0), short) AS free, greatest(-cash, 0) AS owed FROM b),
 p AS (SELECT *, (2 * free * 21500 * d + 100 * y) // (200 * y) + (2 * seg * 12500 * d + 100 * y) // (200 * y) - (2 * owed * 56250 * d + 100 * y) // (200 * y) AS micro FROM c)
 SELECT o_orderkey, seg::DOUBLE / 100 AS segregated, free::DOUBLE / 100 AS free, owed::DOUBLE / 100 AS owed, micro::DOUBLE / 1e6 AS payment, CASE WHEN y IS NULL THEN 'halted' ELSE 'accrued' END AS status FROM p""")
def short_collateral(t: Tables) -> DataFrame:
    """An order is a book's cash, its returned items are what the book is short; no schedule covers status P."""
    short = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    cents = lambda x: F.round(x * 100).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")
    cash = (F.when(F.col("o_custkey") % 4 == 0, -1).otherwise(1) * cents(F.col("o_totalprice"))).cast("decimal(18,2)")
    status = F.col("o_orderstatus")
    basis = F.when(status == "F", 360).when(status == "O", 365)
    rates = [F.when(basis.isNotNull(), F.lit(x)) for x in (0.0215, 0.05625, 0.0125)]
    owing = t.orders.join(short, "o_orderkey", "left").withColumn("short", cents(F.coalesce("v", F.lit(0.0))).cast("decimal(18,2)")).withColumn("cash", cash)
    found = X.financing(F.col("cash"), F.col("short"), *rates, F.dayofmonth("o_orderdate"), basis)
    return owing.select("o_orderkey", *((v if k == "status" else v.cast("double")).alias(k) for k, v in found.items()))
