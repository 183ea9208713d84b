"""Statistics (T rows). A sleeve is an order priority; its returns are those of its daily totals."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import stats
from .registry import Tables, query
from .windows import DAILY, daily

#: Daily totals jump by whole orders, so a sleeve's return is the change over the sum of both days' totals, which is
#: between -1 and 1 for any of them.
R = f"""{DAILY}, s AS (SELECT o_orderpriority AS sleeve, day, r / (r + 2) AS r FROM d WHERE r IS NOT NULL)"""


def returns(t: Tables) -> DataFrame:
    r = F.col("r") / (F.col("r") + 2)
    return daily(t).filter("r IS NOT NULL").select(F.col("o_orderpriority").alias("sleeve"), "day", r.alias("r"))


@query(f"WITH {R} SELECT sleeve, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM s GROUP BY 1")
def sharpe_annual(t: Tables) -> DataFrame:
    return returns(t).groupBy("sleeve").agg(F.count("*").alias("n"), F.round(stats.sharpe(F.col("r")), 6).alias("sharpe"))


@query(f"""WITH {R} SELECT sleeve, round(avg(ln(1 + r)), 6) AS growth, round(stddev_samp(r) * sqrt(252), 6) AS vol, round(avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) * sqrt(252), 6) AS sortino,
 round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM s GROUP BY 1""")
def return_stats(t: Tables) -> DataFrame:
    r = F.col("r")
    down = F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(0.0)))
    return returns(t).groupBy("sleeve").agg(
        F.round(F.avg(F.log1p(r)), 6).alias("growth"), F.round(F.stddev_samp(r) * F.sqrt(F.lit(252.0)), 6).alias("vol"),
        F.round(F.avg(r) / down * F.sqrt(F.lit(252.0)), 6).alias("sortino"), F.round(F.avg((r > 0).cast("double")), 6).alias("hit_rate"),
    )


@query(f"""WITH {R}, m AS (SELECT sleeve, avg(r) AS mu FROM s GROUP BY 1), c AS (SELECT sleeve, avg((r - mu) ** 2) AS m2, avg((r - mu) ** 3) AS m3, avg((r - mu) ** 4) AS m4 FROM s JOIN m USING (sleeve) GROUP BY 1)
 SELECT sleeve, round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / m2 ** 2 - 3, 6) AS excess_kurtosis FROM c""")
def moments(t: Tables) -> DataFrame:
    return returns(t).groupBy("sleeve").agg(F.round(F.skewness("r"), 6).alias("skew"), F.round(F.kurtosis("r"), 6).alias("excess_kurtosis"))


@query(f"""WITH {R}, y AS (SELECT DISTINCT year(day)::INT AS left_out FROM s) SELECT left_out, sleeve, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM s, y WHERE year(day) <> left_out GROUP BY ALL""")
def leave_one_year_out(t: Tables) -> DataFrame:
    r = returns(t)
    # sums by year first: leaving a year out is then arithmetic on a few rows, not a copy of the series for each year
    by = r.groupBy("sleeve", F.year("day").alias("y")).agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count("*").alias("n"))
    whole = by.groupBy("sleeve").agg(*(F.sum(c).alias("t" + c) for c in "sqn"))
    years = r.select(F.year("day").alias("left_out")).distinct()
    grid = whole.join(F.broadcast(years), F.lit(True)).join(by.withColumnRenamed("y", "left_out"), ["sleeve", "left_out"], "left")
    part = lambda c: F.col("t" + c) - F.coalesce(c, F.lit(0))
    mean = part("s") / part("n")
    sd = F.sqrt((part("q") - part("n") * mean * mean) / (part("n") - 1))
    return grid.select("left_out", "sleeve", F.round(mean / sd * F.sqrt(F.lit(252.0)), 6).alias("sharpe"))


PAIRS = f"{R}, p AS (SELECT a.sleeve AS a, b.sleeve AS b, a.day, a.r AS x, b.r AS y FROM s a JOIN s b ON a.day = b.day AND a.sleeve < b.sleeve)"


def paired(t: Tables) -> DataFrame:
    r = returns(t)
    other = r.select(F.col("sleeve").alias("b"), "day", F.col("r").alias("y"))
    return r.select(F.col("sleeve").alias("a"), "day", F.col("r").alias("x")).join(other, "day").filter("a < b")


@query(f"WITH {PAIRS} SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS rho FROM p GROUP BY ALL")
def correlation_matrix(t: Tables) -> DataFrame:
    return paired(t).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(stats.correlation(F.col("x"), F.col("y")), 6).alias("rho"))


BOOK = f"{R}, k AS (SELECT day, avg(r) AS book FROM s GROUP BY 1)"


def book(t: Tables) -> DataFrame:
    return returns(t).groupBy("day").agg(F.avg("r").alias("book"))


@query(f"""WITH {BOOK}, q AS (SELECT quantile_cont(book, 0.1) AS cut FROM k) SELECT sleeve, count(*) AS n, round(covar_pop(r, book) / nullif(stddev_pop(r) * stddev_pop(book), 0), 6) AS rho FROM s JOIN k USING (day), q WHERE book <= cut GROUP BY 1 HAVING count(*) > 2""")
def stressed_correlation(t: Tables) -> DataFrame:
    k = book(t)
    cut = k.agg(F.percentile("book", 0.1).alias("cut"))
    bad = k.join(F.broadcast(cut), F.col("book") <= F.col("cut") + 1e-12)
    return returns(t).join(bad, "day").groupBy("sleeve").agg(F.count("*").alias("n"), F.round(stats.correlation(F.col("r"), F.col("book")), 6).alias("rho")).filter("n > 2")


@query(f"""WITH {BOOK}, m AS (SELECT sleeve, avg(r) AS mu FROM s GROUP BY 1) SELECT sleeve, round(avg(0.9 * book + 0.1 * r) / stddev_samp(0.9 * book + 0.1 * r) * sqrt(252) - avg(book) / stddev_samp(book) * sqrt(252), 6) AS delta,
 round(avg(0.9 * book + 0.1 * (r - mu)) / stddev_samp(0.9 * book + 0.1 * (r - mu)) * sqrt(252) - avg(book) / stddev_samp(book) * sqrt(252), 6) AS control FROM s JOIN k USING (day) JOIN m USING (sleeve) GROUP BY 1""")
def book_delta(t: Tables) -> DataFrame:
    """control: the same with the sleeve's mean taken off, which leaves what comes of its risk alone."""
    r = F.col("r")
    mixed = 0.9 * F.col("book") + 0.1 * r
    # taking off a mean shifts the mix's mean and leaves its deviation, so no second pass is needed
    without = (F.avg(mixed) - 0.1 * F.avg(r)) / F.stddev_samp(mixed) * F.sqrt(F.lit(252.0))
    return returns(t).join(book(t), "day").groupBy("sleeve").agg(
        F.round(stats.sharpe(mixed) - stats.sharpe(F.col("book")), 6).alias("delta"), F.round(without - stats.sharpe(F.col("book")), 6).alias("control")
    )


@query(f"""WITH {BOOK}, q AS (SELECT sleeve, quantile_cont(r, 0.05) AS cut FROM s GROUP BY 1)
 SELECT sleeve, round(avg(r) FILTER (WHERE r <= cut + 1e-12), 6) AS shortfall, round(avg(CASE WHEN r < 0 AND book < 0 THEN 1.0 ELSE 0.0 END), 6) AS joint_loss, round(avg(book) FILTER (WHERE r <= cut + 1e-12), 6) AS book_on_those FROM s JOIN q USING (sleeve) JOIN k USING (day) GROUP BY 1""")
def expected_shortfall(t: Tables) -> DataFrame:
    r = returns(t)
    cuts = r.groupBy("sleeve").agg(F.percentile("r", 0.05).alias("cut"))
    tail = F.col("r") <= F.col("cut") + 1e-12
    both = (F.col("r") < 0) & (F.col("book") < 0)
    return r.join(cuts, "sleeve").join(book(t), "day").groupBy("sleeve").agg(
        F.round(F.avg(F.when(tail, F.col("r"))), 6).alias("shortfall"), F.round(F.avg(both.cast("double")), 6).alias("joint_loss"),
        F.round(F.avg(F.when(tail, F.col("book"))), 6).alias("book_on_those"),
    )


@query("""WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS h FROM labels JOIN documents USING (doc_id) GROUP BY 1), z AS (SELECT 1.959963984540054 AS z)
 SELECT source, n, round((h / n + z * z / (2 * n) - z * sqrt(h / n * (1 - h / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS bound FROM c, z""")
def wilson_bound(t: Tables) -> DataFrame:
    c = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("h"))
    return c.select("source", "n", F.round(stats.wilson_lower(F.col("h"), F.col("n")), 6).alias("bound"))


@query("""WITH p AS (SELECT quality = 1 AS truth, n_chars > 1000 AS said FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE said AND NOT truth) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn, count(*) FILTER (WHERE NOT truth AND NOT said) AS tn FROM p)
 SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")
def precision_recall(t: Tables) -> DataFrame:
    truth, said = F.col("quality") == 1, F.col("n_chars") > 1000
    c = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").agg(
        F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn")
    )
    return c.withColumn("precision", F.round(F.expr("try_divide(tp, tp + fp)"), 6)).withColumn("recall", F.round(F.expr("try_divide(tp, tp + fn)"), 6))


@query(f"WITH {R} SELECT sleeve, year(day)::INT AS year, count(*) AS n, round(sum(ln(1 + r)), 6) AS log_return, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM s GROUP BY ALL HAVING count(*) > 2")
def annual_panel(t: Tables) -> DataFrame:
    r = F.col("r")
    return returns(t).groupBy("sleeve", F.year("day").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(F.log1p(r)), 6).alias("log_return"), F.round(stats.sharpe(r), 6).alias("sharpe")).filter("n > 2")


@query(f"""WITH {R}, m AS (SELECT sleeve, avg(r) AS mu, count(*) AS n FROM s GROUP BY 1), e AS (SELECT sleeve, n, mu, r - mu AS e0, lag(r - mu, 1) OVER w AS e1, lag(r - mu, 2) OVER w AS e2, lag(r - mu, 3) OVER w AS e3 FROM s JOIN m USING (sleeve) WINDOW w AS (PARTITION BY sleeve ORDER BY day)),
 g AS (SELECT sleeve, n, mu, sum(e0 * e0) AS g0, sum(e0 * e1) AS g1, sum(e0 * e2) AS g2, sum(e0 * e3) AS g3 FROM e GROUP BY ALL) SELECT sleeve, n, round(mu / (sqrt(g0 + 1.5 * g1 + g2 + 0.5 * g3) / n), 5) AS t FROM g""")
def newey_west_t(t: Tables) -> DataFrame:
    return stats.newey_west_t(returns(t), "sleeve", "day", "r", 3).withColumn("t", F.round("t", 5))


@query("""WITH e AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY value) AS a, rank() OVER (PARTITION BY day ORDER BY user_id) AS b FROM e),
 c AS (SELECT day, corr(a, b) AS ic FROM r GROUP BY 1 HAVING count(*) > 5) SELECT count(*) AS n_obs, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM c""")
def rank_ic(t: Tables) -> DataFrame:
    day = F.col("ts").cast("date")
    place = lambda c: F.rank().over(Window.partitionBy(day).orderBy(c))
    ranks = t.events.select(day.alias("day"), place("value").alias("a"), place("user_id").alias("b"))
    ic = ranks.groupBy("day").agg(stats.correlation(F.col("a"), F.col("b")).alias("ic"), F.count("*").alias("n")).filter("n > 5")
    return ic.agg(
        F.count("*").alias("n_obs"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.avg("ic") / F.stddev_samp("ic"), 6).alias("ic_ir"),
        F.round(F.avg((F.col("ic") > 0).cast("double")), 6).alias("hit_rate"),
    )


@query(f"""WITH {R}, g AS (SELECT sleeve, min(day) AS lo, max(day) AS hi FROM s GROUP BY 1), c AS (SELECT DISTINCT day FROM s)
 SELECT g.sleeve, count(*) AS sessions, count(*) FILTER (WHERE s.r IS NULL) AS inactive, round(avg(coalesce(s.r, 0)), 6) AS mean FROM g JOIN c ON c.day BETWEEN lo AND hi LEFT JOIN s ON s.sleeve = g.sleeve AND s.day = c.day GROUP BY 1""")
def calendar_complete(t: Tables) -> DataFrame:
    r = returns(t)
    ends = r.groupBy("sleeve").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    own = ends.select("sleeve", F.explode(F.sequence("lo", "hi")).alias("day"))  # met by equality, not by a range
    spine = own.join(r.select("day").distinct(), "day").select("sleeve", "day")
    return spine.join(r, ["sleeve", "day"], "left").groupBy("sleeve").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("r").isNull()).alias("inactive"), F.round(F.avg(F.coalesce("r", F.lit(0.0))), 6).alias("mean")
    )


@query("""WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT o_custkey, month, round(x - lag(x) OVER w, 2) AS change FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY month) QUALIFY lag(month) OVER w = (month - INTERVAL 1 MONTH)::DATE""")
def adjacent_release(t: Tables) -> DataFrame:
    m = t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("x"))
    line = Window.partitionBy("o_custkey").orderBy("month")
    found = m.select("o_custkey", "month", F.round(F.col("x") - F.lag("x").over(line), 2).alias("change"), F.lag("month").over(line).alias("before"))
    return found.filter(F.col("before") == F.add_months("month", -1)).drop("before")


@query(f"""WITH {BOOK} SELECT sleeve, round(greatest(-1, least(1, regr_slope(r, book))), 6) AS beta, round(avg(r - greatest(-1, least(1, (SELECT regr_slope(z.r, k.book) FROM s z JOIN k USING (day) WHERE z.sleeve = s.sleeve))) * book), 6) AS hedged FROM s JOIN k USING (day) GROUP BY 1""")
def beta_hedge(t: Tables) -> DataFrame:
    beta = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.regr_slope("r", "book")))
    sums = returns(t).join(book(t), "day").groupBy("sleeve").agg(beta.alias("b"), F.avg("r").alias("r"), F.avg("book").alias("k"))
    return sums.select("sleeve", F.round("b", 6).alias("beta"), F.round(F.col("r") - F.col("b") * F.col("k"), 6).alias("hedged"))


def below(x: str) -> str:
    """DuckDB's share of a standard normal below x, with each term of the series by itself."""
    return f"0.5 + exp(-0.5 * ({x}) * ({x})) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda i: sign({x}) * pow(abs({x}), 2 * i + 1) * exp(i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2))))"


#: The normal quantiles of 1 - 1/5 and 1 - 1/(5e), as there are five priorities.
@query(f"""WITH {R}, m AS (SELECT sleeve, avg(r) AS mu FROM s GROUP BY 1), c AS (SELECT sleeve, count(*) AS n, any_value(mu) / stddev_samp(r) AS sr, avg((r - mu) ** 3) / avg((r - mu) ** 2) ** 1.5 AS skew, avg((r - mu) ** 4) / avg((r - mu) ** 2) ** 2 AS kurt FROM s JOIN m USING (sleeve) GROUP BY 1),
 b AS (SELECT stddev_samp(sr) * ((1 - 0.5772156649015329) * {NormalDist().inv_cdf(0.8)} + 0.5772156649015329 * {NormalDist().inv_cdf(1 - 1 / (5 * math.e))}) AS best FROM c),
 z AS (SELECT sleeve, n, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS p, (sr - best) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS d FROM c, b)
 SELECT sleeve, n, round(CASE WHEN abs(p) > 8 THEN (1 + sign(p)) / 2 ELSE {below("greatest(-8, least(8, p))")} END, 6) AS psr, round(CASE WHEN abs(d) > 8 THEN (1 + sign(d)) / 2 ELSE {below("greatest(-8, least(8, d))")} END, 6) AS dsr FROM z""")
def psr_dsr(t: Tables) -> DataFrame:
    """Probabilistic and deflated Sharpe ratio; the trials are the sleeves."""
    per = returns(t).groupBy("sleeve").agg(
        (F.avg("r") / F.stddev_samp("r")).alias("sr"), F.count("*").alias("n"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt")
    )
    trials = per.agg(F.count("*").alias("k"), F.var_samp("sr").alias("v")).first()  # one row
    best = stats.expected_best(trials.k, trials.v or 0.0)
    args = F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt")
    chance = lambda benchmark: F.round(stats.probabilistic_sharpe(*args, F.lit(benchmark)), 6)
    return per.select("sleeve", "n", chance(0.0).alias("psr"), chance(best).alias("dsr"))


@query(f"""WITH {R}, e AS (SELECT min(day) AS lo, max(day) AS hi FROM s), u AS (SELECT sleeve, least(7, date_diff('day', lo, day) * 8 // (date_diff('day', lo, hi) + 1)) AS block, r FROM s, e),
 q AS (SELECT sleeve, block, sum(r) AS s, sum(r * r) AS q, count(r) AS c FROM u GROUP BY ALL), m AS (SELECT range AS m FROM range(256) WHERE bit_count(range) = 4),
 g AS (SELECT m, sleeve, (m >> block) & 1 = 1 AS inside, sum(s) AS s, sum(q) AS q, sum(c) AS c FROM q, m GROUP BY ALL),
 v AS (SELECT m, sleeve, max(CASE WHEN inside THEN s / c / sqrt(q / c - (s / c) ** 2) END) AS a, max(CASE WHEN NOT inside THEN s / c / sqrt(q / c - (s / c) ** 2) END) AS b FROM g GROUP BY ALL),
 k AS (SELECT *, rank() OVER (PARTITION BY m ORDER BY b) AS place, count(*) OVER (PARTITION BY m) AS n, row_number() OVER (PARTITION BY m ORDER BY a DESC, sleeve DESC) AS best FROM v WHERE a IS NOT NULL AND b IS NOT NULL)
 SELECT round(avg(CASE WHEN n > 1 THEN CASE WHEN 2 * place <= n + 1 THEN 1.0 ELSE 0.0 END END), 6) AS pbo, count(*) AS n_splits FROM k WHERE best = 1""")
def pbo_cscv(t: Tables) -> DataFrame:
    return stats.overfitting(returns(t), "sleeve", "day", "r").withColumn("pbo", F.round("pbo", 6))


@query("""WITH r AS (SELECT o_orderkey, year(o_orderdate) AS cohort, o_orderpriority AS g, o_totalprice AS y, o_custkey::DOUBLE AS a, dayofyear(o_orderdate)::DOUBLE AS b FROM orders),
 w AS (SELECT o_orderkey, cohort, g, y - avg(y) OVER p AS y, a - avg(a) OVER p AS a, b - avg(b) OVER p AS b FROM r WINDOW p AS (PARTITION BY cohort, g)),
 m AS (SELECT cohort, count(*) - count(DISTINCT g) - 2 AS df, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS b_y FROM w GROUP BY 1)
 SELECT o_orderkey, cohort, round(w.y - a * (ay * bb - b_y * ab) / (aa * bb - ab * ab) - b * (b_y * aa - ay * ab) / (aa * bb - ab * ab), 4) AS residual FROM w JOIN m USING (cohort) WHERE df >= 10""")
def ols_residual(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("cohort"), "o_orderpriority", "o_totalprice", F.col("o_custkey").cast("double").alias("x1"), F.dayofyear("o_orderdate").cast("double").alias("x2"))
    found = stats.ols_residual(rows, "cohort", "o_totalprice", ["x1", "x2"], "o_orderpriority", "o_orderkey")
    return found.withColumn("residual", F.round("residual", 4))


@query(f"""WITH {R}, e AS (SELECT sleeve, day, exp(sum(ln(1 + r)) OVER (PARTITION BY sleeve ORDER BY day)) AS equity FROM s), f AS (SELECT sleeve, day, equity, equity / max(equity) OVER (PARTITION BY sleeve ORDER BY day) - 1 AS fall FROM e),
 g AS (SELECT sleeve, count(*) AS n, arg_max(equity, day) AS final_equity, min(fall) AS worst FROM f GROUP BY 1)
 SELECT sleeve, n, round(final_equity, 6) AS final_equity, round(final_equity - 1, 6) AS total_return, round(pow(final_equity, 252.0 / n) - 1, 6) AS cagr, round(worst, 6) AS max_drawdown FROM g""")
def equity_summary(t: Tables) -> DataFrame:
    r = returns(t)
    grown = stats.equity(r, ["sleeve"], ["day"], "r")
    final = r.groupBy("sleeve").agg(F.count("*").alias("n"), (stats.total_return(F.col("r")) + 1).alias("e"))
    worst = stats.max_drawdown(grown, ["sleeve"], ["day"], "equity")
    return final.join(worst, "sleeve").select(
        "sleeve", "n", F.round("e", 6).alias("final_equity"), F.round(F.col("e") - 1, 6).alias("total_return"),
        F.round(F.pow("e", F.lit(252.0) / F.col("n")) - 1, 6).alias("cagr"), F.round("max_drawdown", 6).alias("max_drawdown"),
    )


@query(f"""WITH {R}, k AS (SELECT DISTINCT sleeve FROM s), b AS (SELECT k.sleeve, s.day, avg(s.r) AS whole, avg(CASE WHEN s.sleeve <> k.sleeve THEN s.r END) AS rest FROM k, s GROUP BY ALL),
 e AS (SELECT sleeve, day, exp(sum(ln(1 + whole)) OVER w) AS a, exp(sum(ln(1 + coalesce(rest, 0))) OVER w) AS b FROM b WINDOW w AS (PARTITION BY sleeve ORDER BY day)),
 f AS (SELECT sleeve, a / max(a) OVER w - 1 AS fa, b / max(b) OVER w - 1 AS fb FROM e WINDOW w AS (PARTITION BY sleeve ORDER BY day))
 SELECT sleeve, round(min(fa), 6) AS with_sleeve, round(min(fb), 6) AS without_sleeve, round(min(fa) - min(fb), 6) AS drawdown_delta FROM f GROUP BY 1""")
def drawdown_delta(t: Tables) -> DataFrame:
    """The deepest fall of the book of all sleeves and of the book without each, a day's mean being its return."""
    r = returns(t)
    days = r.groupBy("day").agg(F.sum("r").alias("all"), F.count("r").alias("n"))
    names = r.select("sleeve").distinct()  # a row a sleeve
    own = names.withColumn("one", F.lit(1)).join(days.withColumn("one", F.lit(1)), "one").drop("one").join(r, ["sleeve", "day"], "left")
    there = F.when(F.col("r").isNotNull(), 1).otherwise(0)
    rest = F.coalesce((F.col("all") - F.coalesce("r", F.lit(0.0))) / F.nullif(F.col("n") - there, F.lit(0)), F.lit(0.0))
    books = own.select("sleeve", "day", F.explode(F.create_map(F.lit("with_sleeve"), F.col("all") / F.col("n"), F.lit("without_sleeve"), rest)).alias("book", "b"))
    worst = stats.max_drawdown(stats.equity(books, ["sleeve", "book"], ["day"], "b"), ["sleeve", "book"], ["day"], "equity", "worst")
    wide = worst.groupBy("sleeve").agg(*(F.max(F.when(F.col("book") == x, F.col("worst"))).alias(x) for x in ("with_sleeve", "without_sleeve")))
    return wide.select("sleeve", F.round("with_sleeve", 6).alias("with_sleeve"), F.round("without_sleeve", 6).alias("without_sleeve"), F.round(F.col("with_sleeve") - F.col("without_sleeve"), 6).alias("drawdown_delta"))


@query(f"""WITH {PAIRS}, q AS (SELECT a, b, x, y, row_number() OVER (PARTITION BY a, b ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS n FROM p), z AS (SELECT DISTINCT a, b, n FROM q),
 w AS (SELECT a, b, n, draw, unnest(range(0, (n + 20) // 21)) AS k FROM z, range(2000) AS g(draw)), h AS (SELECT *, ('0x' || substr(sha256('20260816:' || draw || ':' || k), 1, 8))::BIGINT % n AS start FROM w),
 i AS (SELECT a, b, n, draw, k, start, unnest(range(0, 21)) AS j FROM h), c AS (SELECT i.a, i.b, draw, corr(x, y) AS rho FROM i JOIN q ON q.a = i.a AND q.b = i.b AND q.i = (start + j) % i.n WHERE k * 21 + j < i.n GROUP BY ALL)
 SELECT a, b, round(quantile_cont(rho, 0.95), 6) AS bound, count(rho) AS draws FROM c GROUP BY ALL""")
def block_bootstrap(t: Tables) -> DataFrame:
    """Of every pair of sleeves."""
    line = Window.partitionBy("a", "b").orderBy("day")
    numbered = paired(t).select("a", "b", (F.row_number().over(line) - 1).cast("long").alias("i"), "x", "y")  # a row a day
    return stats.bootstrap_bound(numbered, ["a", "b"], "i", "x", "y").withColumn("bound", F.round("bound", 6))


@query("""WITH b AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL), h AS (SELECT unnest([1, 2, 5]) AS horizon),
 f AS (SELECT horizon, user_id, day, v, CASE horizon WHEN 1 THEN lead(v, 1) OVER w WHEN 2 THEN lead(v, 2) OVER w ELSE lead(v, 5) OVER w END - v AS y FROM b, h WINDOW w AS (PARTITION BY horizon, user_id ORDER BY day)),
 k AS (SELECT horizon, day, rank() OVER x + (count(*) OVER (PARTITION BY horizon, day, v) - 1) / 2.0 AS a, rank() OVER z + (count(*) OVER (PARTITION BY horizon, day, y) - 1) / 2.0 AS c FROM f WHERE y IS NOT NULL WINDOW x AS (PARTITION BY horizon, day ORDER BY v), z AS (PARTITION BY horizon, day ORDER BY y)),
 i AS (SELECT horizon, day, corr(a, c) AS ic FROM k GROUP BY ALL HAVING count(*) >= 5), m AS (SELECT horizon, avg(ic) AS mu FROM i GROUP BY 1),
 e AS (SELECT horizon, mu, ic, ic - mu AS e0, lag(ic - mu, 1) OVER w AS e1, lag(ic - mu, 2) OVER w AS e2 FROM i JOIN m USING (horizon) WINDOW w AS (PARTITION BY horizon ORDER BY day))
 SELECT horizon, count(*) AS n_obs, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
 round(any_value(mu) / (sqrt(sum(e0 * e0) + 4.0 / 3 * sum(e0 * e1) + 2.0 / 3 * sum(e0 * e2)) / count(*)), 5) AS t FROM e GROUP BY 1""")
def rank_ic_horizons(t: Tables) -> DataFrame:
    """How a user's total of a day ranks against its change over the user's next 1, 2 and 5 days with events."""
    bars = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    line = Window.partitionBy("user_id").orderBy("day")  # a row a day
    ahead = bars.withColumns({f"y{h}": F.lead("v", h).over(line) - F.col("v") for h in (1, 2, 5)})
    long = ahead.select("day", "v", F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in (1, 2, 5)))))
    ic = stats.rank_correlations(long, ["horizon", "day"], "v", "y", 5)
    summary = ic.groupBy("horizon").agg(
        F.count("ic").alias("n_obs"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.avg("ic") / F.stddev_samp("ic"), 6).alias("ic_ir"),
        F.round(F.avg((F.col("ic") > 0).cast("double")), 6).alias("hit_rate"),
    )
    tested = stats.newey_west_t(ic.filter("ic IS NOT NULL").select("horizon", "day", "ic"), "horizon", "day", "ic", 2)
    return summary.join(tested.select("horizon", F.round("t", 5).alias("t")), "horizon")


@query("""WITH v AS (SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS m, o_orderpriority AS p, sum(o_totalprice) AS v FROM orders GROUP BY ALL), x AS (SELECT o_orderstatus, m, p, v / sum(v) OVER (PARTITION BY o_orderstatus, m) AS w FROM v),
 d AS (SELECT o_orderstatus, m, lag(m) OVER (PARTITION BY o_orderstatus ORDER BY m) AS before FROM (SELECT DISTINCT o_orderstatus, m FROM x)), g AS (SELECT d.*, p FROM d, (SELECT DISTINCT p FROM x)),
 t AS (SELECT g.o_orderstatus, g.m, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS t FROM g LEFT JOIN x a ON a.o_orderstatus = g.o_orderstatus AND a.m = g.m AND a.p = g.p LEFT JOIN x b ON b.o_orderstatus = g.o_orderstatus AND b.m = g.before AND b.p = g.p WHERE g.before IS NOT NULL GROUP BY ALL)
 SELECT o_orderstatus, count(*) AS n, round(avg(t) * 12, 6) AS turnover_annual FROM t GROUP BY 1""")
def annual_turnover(t: Tables) -> DataFrame:
    """Of a book of priorities for each status, weighed anew each month by what was ordered."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")
    v = t.orders.groupBy("o_orderstatus", month, "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    whole = v.groupBy("o_orderstatus", "m").agg(F.sum("v").alias("whole"))
    weights = v.join(whole, ["o_orderstatus", "m"]).withColumn("w", F.col("v") / F.col("whole"))
    by_month = stats.turnover(weights, ["o_orderstatus"], "m", "o_orderpriority", "w")
    return by_month.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("turnover") * 12, 6).alias("turnover_annual"))
