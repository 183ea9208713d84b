"""Window functions (W rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import Tables, query

W_START = Window.unboundedPreceding


def daily(t: Tables) -> DataFrame:
    """Daily totals and simple returns of each priority's orders, the stand-in for a sleeve's series."""
    nav = t.orders.groupBy("o_orderpriority", F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("nav"))
    line = Window.partitionBy("o_orderpriority").orderBy("day")
    return nav.withColumn("r", F.col("nav") / F.lag("nav").over(line) - 1)


DAILY = """n AS (SELECT o_orderpriority, o_orderdate::DATE AS day, sum(o_totalprice) AS nav FROM orders GROUP BY ALL),
 d AS (SELECT *, nav / lag(nav) OVER (PARTITION BY o_orderpriority ORDER BY day) - 1 AS r FROM n)"""


@query(f"WITH {DAILY}, m AS (SELECT *, max(nav) OVER (PARTITION BY o_orderpriority ORDER BY day) AS top FROM d) SELECT o_orderpriority, day, round(top, 2) AS top, round(nav / top - 1, 6) AS drawdown FROM m")
def drawdown_envelope(t: Tables) -> DataFrame:
    line = Window.partitionBy("o_orderpriority").orderBy("day").rowsBetween(W_START, 0)
    top = F.max("nav").over(line)
    return daily(t).select("o_orderpriority", "day", F.round(top, 2).alias("top"), F.round(F.col("nav") / top - 1, 6).alias("drawdown"))


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])', 1) AS levels FROM pages), e AS (SELECT page_id, unnest(levels)::INT AS level, generate_subscripts(levels, 1) AS i FROM h),
 l AS (SELECT *, lag(level, 1, 0) OVER (PARTITION BY page_id ORDER BY i) AS previous FROM e) SELECT page_id, i::INT AS place, previous, level FROM l WHERE level - previous > 1""")
def heading_skip(t: Tables) -> DataFrame:
    levels = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h([1-6])"), 1)).alias("i", "level"))
    line = Window.partitionBy("page_id").orderBy("i")
    level = F.col("level").cast("int")
    found = levels.select("page_id", (F.col("i") + 1).alias("place"), F.lag(level, 1, 0).over(line).alias("previous"), level.alias("level"))
    return found.filter("level - previous > 1")


@query("""SELECT event_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before,
 coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS after FROM events""")
def prefix_suffix_any(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = lambda lo, hi: F.coalesce(F.bool_or(F.col("event_type") == "error").over(line.rowsBetween(lo, hi)), F.lit(False))
    return t.events.select("event_id", seen(W_START, -1).alias("before"), seen(1, Window.unboundedFollowing).alias("after"))


@query("""WITH w AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING)) AS v FROM events) SELECT event_id, v[31] AS upper_median FROM w WHERE len(v) = 60""")
def rolling_upper_median(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-59, 0)
    held = t.events.select("event_id", F.sort_array(F.collect_list("value").over(line)).alias("v"))
    return held.filter(F.size("v") == 60).select("event_id", F.col("v")[30].alias("upper_median"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, value) AS i FROM events),
 s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::DOUBLE AS slow, 0 AS stage FROM events UNION ALL
  SELECT user_id, i, CASE WHEN x > 150 THEN 0 ELSE x END, stage + CASE WHEN x > 150 THEN 1 ELSE 0 END
  FROM (SELECT s.user_id, o.i, s.stage, CASE WHEN o.value > 50 THEN s.slow + o.value ELSE greatest(0, s.slow - o.value) END AS x FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1))
 SELECT user_id, arg_max(slow, i) AS slow, arg_max(stage, i) AS stage FROM s GROUP BY 1""")
def staged_recurrence(t: Tables) -> DataFrame:
    """Slow time grows while a sample is over 50 and shrinks otherwise, never below zero; over 150 the stage goes up by
    one and the time starts anew. Each sample depends on all before it, so a user's samples are folded in order."""
    samples = t.events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))

    def step(state, x):
        slow = F.when(x["value"] > 50, state["slow"] + x["value"]).otherwise(F.greatest(F.lit(0.0), state["slow"] - x["value"]))
        return F.struct(F.when(slow > 150, 0.0).otherwise(slow).alias("slow"), (state["stage"] + F.when(slow > 150, 1).otherwise(0)).alias("stage"))

    start = F.struct(F.lit(0.0).alias("slow"), F.lit(0).alias("stage"))
    return samples.select("user_id", F.aggregate("s", start, step).alias("state")).select("user_id", "state.*")


@query(f"""WITH {DAILY}, f AS (SELECT *, count(*) OVER w AS n, quantile_cont(nav, 0.5) OVER w AS liquidity, lag(nav, 21) OVER p / lag(nav, 252) OVER p - 1 AS momentum, regr_slope(r, b) OVER y AS beta FROM (SELECT *, avg(r) OVER (PARTITION BY day) AS b FROM d)
 WINDOW p AS (PARTITION BY o_orderpriority ORDER BY day), w AS (PARTITION BY o_orderpriority ORDER BY day ROWS 20 PRECEDING), y AS (PARTITION BY o_orderpriority ORDER BY day ROWS 251 PRECEDING))
 SELECT o_orderpriority, day, round(liquidity, 4) AS liquidity, round(momentum, 6) AS momentum, round(beta, 4) AS beta FROM f WHERE n = 21 AND momentum IS NOT NULL""")
def rolling_liquidity_momentum_beta(t: Tables) -> DataFrame:
    line = Window.partitionBy("o_orderpriority").orderBy("day")
    frame = line.rowsBetween(-20, 0)
    beta = F.regr_slope("r", "b").over(line.rowsBetween(-251, 0))  # on the day's return of the book, all priorities alike
    found = daily(t).withColumn("b", F.avg("r").over(Window.partitionBy("day"))).select(
        "o_orderpriority", "day", F.count("*").over(frame).alias("n"), F.round(F.percentile("nav", 0.5).over(frame), 4).alias("liquidity"),
        F.round(F.lag("nav", 21).over(line) / F.lag("nav", 252).over(line) - 1, 6).alias("momentum"),
        F.round(beta, 4).alias("beta"),
    )
    return found.filter("n = 21 AND momentum IS NOT NULL").drop("n")


@query("""SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_totalprice), 6) AS pr FROM orders""")
def cohort_percent_rank(t: Tables) -> DataFrame:
    line = Window.partitionBy(F.trunc("o_orderdate", "month")).orderBy("o_totalprice")
    return t.orders.select("o_orderkey", F.round(F.percent_rank().over(line), 6).alias("pr"))


@query("""WITH q AS (SELECT o_orderkey, ntile(5) OVER w AS fifth, count(*) OVER (PARTITION BY date_trunc('month', o_orderdate)) AS n FROM orders WINDOW w AS (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_totalprice, o_orderkey))
 SELECT o_orderkey, CASE fifth WHEN 5 THEN 'long' ELSE 'short' END AS side FROM q WHERE n >= 25 AND fifth IN (1, 5)""")
def quintile_tails(t: Tables) -> DataFrame:
    """Months of 20 orders or more with five or more in each tail, which 25 orders are needed for."""
    month = F.trunc("o_orderdate", "month")
    found = t.orders.select("o_orderkey", F.ntile(5).over(Window.partitionBy(month).orderBy("o_totalprice", "o_orderkey")).alias("fifth"), F.count("*").over(Window.partitionBy(month)).alias("n"))
    return found.filter("n >= 25 AND fifth IN (1, 5)").select("o_orderkey", F.when(F.col("fifth") == 5, "long").otherwise("short").alias("side"))


@query("""WITH c AS (SELECT conv_id, turn, sha256(text) AS h, lag(turn) OVER w AS p, lag(sha256(text)) OVER w AS ph FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, coalesce(turn = p + 1, turn = 0 OR p IS NULL) AS continuous, coalesce(substr(ph, 1, 12), 'head') AS parent FROM c""")
def chain_continuity(t: Tables) -> DataFrame:
    line = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("turn").over(line)
    parent = F.substring(F.lag(F.sha2("text", 256)).over(line), 1, 12)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.col("turn") == before + 1, F.lit(True)).alias("continuous"), F.coalesce(parent, F.lit("head")).alias("parent"))


@query("""WITH s AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)), o AS (SELECT o_custkey, min(o_orderdate::DATE) AS a, max(o_orderdate::DATE) AS b FROM orders GROUP BY 1)
 SELECT o_custkey, y.i - x.i AS lead_sessions FROM o JOIN s x ON x.day = a JOIN s y ON y.day = b""")
def session_lead(t: Tables) -> DataFrame:
    days = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    # a row for each trading day there ever was: its number is a global count, over few rows
    sessions = days.select("day").distinct().select("day", F.row_number().over(Window.orderBy("day")).cast("long").alias("i"))
    ends = days.groupBy("o_custkey").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    at = lambda c, n: sessions.select(F.col("day").alias(c), F.col("i").alias(n))
    return ends.join(at("a", "x"), "a").join(at("b", "y"), "b").select("o_custkey", (F.col("y") - F.col("x")).alias("lead_sessions"))


@query("""WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, sum(o_totalprice) AS x FROM orders GROUP BY ALL),
 c AS (SELECT p, y, q, sum(x) OVER (PARTITION BY p, y ORDER BY q) AS ytd FROM m) SELECT p, y, q, round(CASE WHEN q = 1 THEN ytd WHEN lag(q) OVER w = q - 1 THEN ytd - lag(ytd) OVER w END, 2) AS amount FROM c WINDOW w AS (PARTITION BY p, y ORDER BY q)""")
def ytd_difference(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.sum("o_totalprice").alias("x"))
    line = Window.partitionBy("p", "y").orderBy("q")
    ytd = by.withColumn("ytd", F.sum("x").over(line.rowsBetween(W_START, 0)))
    own = F.when(F.col("q") == 1, F.col("ytd")).when(F.lag("q").over(line) == F.col("q") - 1, F.col("ytd") - F.lag("ytd").over(line))
    return ytd.select("p", "y", "q", F.round(own, 2).alias("amount"))
