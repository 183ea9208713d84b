"""Statistics of return series, as aggregates wherever a closed form exists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ordered


def sharpe(r: Column, periods: float = 252) -> Column:
    """Annualised mean over sample standard deviation."""
    return F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))


def total_return(r: Column) -> Column:
    return F.exp(F.sum(F.log1p(r))) - 1


def correlation(x: Column, y: Column) -> Column:
    """Null where one side does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def central_moment(r: Column, mean: Column, power: int) -> Column:
    return F.avg(F.pow(r - mean, F.lit(float(power))))


def wilson_lower(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Lower end of the 95 % score interval of a share."""
    p = hits / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - spread) / (1 + z * z / n)


def newey_west_t(rows: DataFrame, group: str, order: str, r: str, lags: int) -> DataFrame:
    """group, n and t: the mean over its standard error with Bartlett weights up to lags (our parameter). Products of
    lagged deviations are summed per lag, so nothing is collected."""
    line = Window.partitionBy(group).orderBy(order)
    means = rows.groupBy(group).agg(F.avg(r).alias("_m"), F.count(r).alias("n"))
    dev = rows.join(means, group).withColumn("_e", F.col(r) - F.col("_m"))
    products = [F.sum(F.col("_e") * F.col(f"_e{k}")).alias(f"_g{k}") for k in range(1, lags + 1)]
    lagged = dev.select(group, "_m", "n", "_e", *(F.lag("_e", k).over(line).alias(f"_e{k}") for k in range(1, lags + 1)))
    sums = lagged.groupBy(group, "_m", "n").agg(F.sum(F.col("_e") * F.col("_e")).alias("_g0"), *products)
    s = F.col("_g0") + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    return sums.select(group, "n", (F.col("_m") / (F.sqrt(s) / F.col("n"))).alias("t"))


def normal_cdf(x: Column) -> Column:
    """The share of a standard normal below x, to some 1e-15: a half and the density times x + x^3/3 + x^5/(3*5) + ...,
    whose terms all have one sign; 0 or 1 more than eight deviations away, null for null or not a number."""

    def of(v: Column) -> Column:
        def add(state: Column, odd: Column) -> Column:
            term = state["term"] * v * v / odd
            return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

        start = F.struct(v.alias("term"), v.alias("sum"))
        series = F.aggregate(F.sequence(F.lit(3), F.lit(241), F.lit(2)), start, add, lambda state: state["sum"])
        inside = 0.5 + series * F.exp(-v * v / 2) / (2 * np.pi) ** 0.5
        return F.when(~F.isnan(v), F.when(v > 8, 1.0).when(v < -8, 0.0).otherwise(inside))

    return F.transform(F.array(x.cast("double")), of)[0]


def probabilistic_sharpe(sr: Column, n: Column, skew: Column, kurtosis: Column, benchmark: Column) -> Column:
    """Probability that the true per-period ratio exceeds benchmark, from plain kurtosis (3 for a normal)."""
    spread = F.sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr)
    return normal_cdf((sr - benchmark) * F.sqrt(n - 1) / spread)


def expected_best(trials: int, variance: float) -> float:
    """The expected largest per-period ratio of so many unskilled trials with this variance; 0 for a single trial."""
    if trials < 2:
        return 0.0
    inverse, euler = NormalDist().inv_cdf, 0.5772156649015329
    return variance**0.5 * ((1 - euler) * inverse(1 - 1 / trials) + euler * inverse(1 - 1 / (trials * np.e)))


def overfitting(rows: DataFrame, config: str, at: str, r: str, blocks: int = 8) -> DataFrame:
    """One row: pbo and n_splits. Time is cut into blocks; for every choice of half of them the configuration that is
    best there is ranked in the rest, and pbo is how often it ranks in the lower half. Null, never 0, for fewer than two
    configurations. Blocks are summed first; the splits work on blocks x configurations numbers."""
    spark = rows.sparkSession
    ends = rows.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    part = F.least(F.lit(blocks - 1), F.floor(F.date_diff(at, "_lo") * blocks / (F.date_diff("_hi", "_lo") + 1))).cast("int")
    sums = rows.join(F.broadcast(ends), F.lit(True)).groupBy(config, part.alias("block")).agg(F.sum(r).alias("_s"), F.sum(F.col(r) * F.col(r)).alias("_q"), F.count(r).alias("_c"))
    splits = [(k, b) for k, half in enumerate(combinations(range(blocks), blocks // 2)) for b in half]
    chosen = spark.createDataFrame(splits, "split int, block int").withColumn("inside", F.lit(True))
    grid = sums.join(F.broadcast(chosen.select("split").distinct()), F.lit(True)).join(F.broadcast(chosen), ["split", "block"], "left")
    inside = F.coalesce("inside", F.lit(False))
    ratio = lambda c: (lambda s, q, n: (s / n) / F.sqrt(q / n - (s / n) * (s / n)))(*(F.sum(F.when(c, F.col(x))) for x in ("_s", "_q", "_c")))
    scored = grid.groupBy("split", config).agg(ratio(inside).alias("a"), ratio(~inside).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    ranked = scored.withColumn("rank", F.rank().over(Window.partitionBy("split").orderBy("b"))).withColumn("n", F.count("*").over(Window.partitionBy("split")))
    best = ranked.groupBy("split").agg(F.max_by(F.struct("rank", "n"), F.struct("a", config)).alias("x"))
    low = F.when(F.col("x.n") > 1, (F.col("x.rank") / (F.col("x.n") + 1) <= 0.5).cast("double"))
    return best.agg(F.avg(low).alias("pbo"), F.count("*").alias("n_splits"))


def ols_residual(rows: DataFrame, cohort: str, y: str, xs: list[str], category: str, key: str, least_df: int = 10, least_distinct: int = 10) -> DataFrame:
    """key, cohort and residual of y on an intercept, xs and the categories, by cohort. Cohorts with fewer than least_df
    degrees of freedom or least_distinct different residuals (to nine places of their spread) are left out; a row with a
    null or not finite number is in no fit.

    The categories' columns are taken out by the means within them, what is left of y and xs makes sums of products for
    each cohort, and only those few numbers are solved in a task; residuals are made where the rows are. Standardised
    columns keep the sums well conditioned; a column that depends on others is given no weight.
    """
    columns = [y, *xs]
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")) for c in columns]
    held = rows.select(key, cohort, category, *(F.col(c).cast("double").alias(c) for c in columns)).filter(reduce(Column.__and__, finite))
    means = held.groupBy(cohort, category).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    inside = held.join(means, [cohort, category]).select(key, cohort, category, *((F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns))
    scale = lambda c: F.greatest(F.sqrt(F.avg(F.col(c) * F.col(c))), F.lit(1e-300))
    scales = inside.groupBy(cohort).agg(F.count("*").alias("_n"), F.count_distinct(category).alias("_groups"), *(scale(c).alias(f"_s_{c}") for c in columns))
    unit = inside.join(scales, cohort).select(key, cohort, "_n", "_groups", *(F.col(f"_s_{c}") for c in columns), *((F.col(c) / F.col(f"_s_{c}")).alias(c) for c in columns))
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"_g_{i}") for i, (a, b) in enumerate(pairs)] + [F.sum(F.col(a) * F.col(y)).alias(f"_h_{i}") for i, a in enumerate(xs)]
    gram = unit.groupBy(cohort, "_n", "_groups").agg(*sums)
    kind = dict(rows.dtypes)[cohort]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            betas, ranks = [], []
            for r in frame.to_dict("records"):
                g = np.zeros((len(xs), len(xs)))
                for i, (a, b) in enumerate(pairs):
                    g[xs.index(a), xs.index(b)] = g[xs.index(b), xs.index(a)] = r[f"_g_{i}"]
                h = np.array([r[f"_h_{i}"] for i in range(len(xs))])
                betas.append((np.linalg.pinv(g, rcond=1e-10, hermitian=True) @ h).tolist())
                ranks.append(int(np.linalg.matrix_rank(g, tol=1e-10 * max(1.0, r["_n"]), hermitian=True)))
            free = frame["_n"] - frame["_groups"] - np.array(ranks, int)
            yield pd.DataFrame({cohort: frame[cohort], "_beta": betas, "_free": free})

    solved = gram.mapInPandas(solve, f"{cohort} {kind}, _beta array<double>, _free long").filter(F.col("_free") >= least_df)
    fit = reduce(Column.__add__, [F.col("_beta")[i] * F.col(x) for i, x in enumerate(xs)])
    found = unit.join(solved, cohort).select(key, cohort, (F.col(y) - fit).alias("_unit"), F.col(f"_s_{y}").alias("_s"))
    varied = found.groupBy(cohort).agg(F.count_distinct(F.round("_unit", 9)).alias("_d")).filter(F.col("_d") >= least_distinct).select(cohort)
    return found.join(varied, cohort, "left_semi").select(key, cohort, (F.col("_unit") * F.col("_s")).alias("residual"))


def max_drawdown(rows: DataFrame, by: list[str], order: list[str], level: str, into: str = "max_drawdown") -> DataFrame:
    """by and into: the deepest fall of level below its highest value so far, as a share of that (0 or below). Rows are
    in the order of order; null levels don't count.

    A stretch of a series is known by its highest and lowest level and its own worst fall; that of two in a row is the
    worse of both and of the later one's lowest level below the earlier one's highest. Stretches are parts of a range
    partition, so a long series is in several tasks.
    """
    laid = ordered.laid(rows.filter(F.col(level).isNotNull()).select(*by, *order, level), by, order)
    inside = Window.partitionBy(ordered.PART, *by).orderBy(ordered.PLACE).rowsBetween(Window.unboundedPreceding, 0)
    falls = laid.withColumn("_fall", F.col(level) / F.max(level).over(inside) - 1)
    parts = falls.groupBy(ordered.PART, *by).agg(F.max(level).alias("_top"), F.min(level).alias("_low"), F.min("_fall").alias("_worst"))
    earlier = Window.partitionBy(*by).orderBy(ordered.PART).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    joined = parts.withColumn("_before", F.max("_top").over(earlier))
    worst = F.least("_worst", F.coalesce(F.col("_low") / F.col("_before") - 1, F.lit(0.0)))
    return joined.groupBy(*by).agg(F.min(worst).alias(into))


def equity(rows: DataFrame, by: list[str], order: list[str], r: str, into: str = "equity") -> DataFrame:
    """rows with into: what 1 has become by each row's return; a null return changes nothing. Returns are above -1."""
    logs = rows.withColumn("_log", F.log1p(r))
    return ordered.running_total(logs, order, "_log", "_total", by).withColumn(into, F.exp("_total")).drop("_log", "_total")


def bootstrap_bound(rows: DataFrame, by: list[str], index: str, a: str, b: str, draws: int = 2000, block: int = 21, seed: int = 20260816, level: float = 0.95) -> DataFrame:
    """by, bound and draws: for each series the level quantile of the correlation of a and b over circular moving-block
    resamples of its length; its rows are numbered by index from 0. A block starts at the first 32 bits of SHA-256 of
    "seed:draw:block" modulo the length, so reruns agree. A resample in which one side does not vary has no correlation.

    The sums of the block from each start are made once, so a draw adds up blocks, not rows, and no row is copied for it.
    Columns are centred and scaled first, which keeps the sums well conditioned.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    scaled = lambda c: (F.coalesce((F.col(c) - F.col("_m" + c)) / F.nullif(F.col("_s" + c), F.lit(0.0)), F.lit(0.0)))
    sizes = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), *(f(F.col(c)).alias(p + c) for p, f in (("_m", F.avg), ("_s", F.stddev_pop)) for c in (a, b))
    ).withColumn("_last", F.col("_n") - (F.ceil(F.col("_n") / block) - 1) * block)
    held = rows.join(sizes, by).select(*by, index, "_n", "_last", F.when(both, scaled(a)).alias("_x"), F.when(both, scaled(b)).alias("_y"))
    at = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_i")).filter("_i < _n")
    x, y = F.col("_x"), F.col("_y")
    terms = {"c": F.when(x.isNotNull(), 1), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    sums = at.groupBy(*by, F.pmod(F.col(index) - F.col("_i"), F.col("_n")).alias("_start")).agg(
        *(F.sum(v).alias("_f" + k) for k, v in terms.items()), *(F.sum(F.when(F.col("_i") < F.col("_last"), v)).alias("_l" + k) for k, v in terms.items())
    )
    each = sizes.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw")).repartition(*by, "_draw")
    blocks = each.select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / block) - 1).cast("int"))).alias("_k"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), "_draw", "_k"), 256)
    start = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.col("_n"))
    # the exploded blocks are small in the shuffle before and large here: neither side is to be broadcast
    picked = blocks.withColumn("_start", start).join(sums.hint("merge"), [*by, "_start"])
    short = (F.col("_k") + 1) * block > F.col("_n")
    per_draw = picked.groupBy(*by, "_draw").agg(*(F.sum(F.when(short, F.col("_l" + k)).otherwise(F.col("_f" + k))).alias("_" + k) for k in terms))
    n, sx, sy = F.col("_c"), F.col("_x"), F.col("_y")
    spread = lambda q, s: F.when(n * q - s * s > 1e-12 * n * q, n * q - s * s)
    rho = (n * F.col("_xy") - sx * sy) / F.sqrt(spread(F.col("_xx"), sx) * spread(F.col("_yy"), sy))
    return per_draw.select(*by, rho.alias("_rho")).groupBy(*by).agg(F.percentile("_rho", level).alias("bound"), F.count("_rho").alias("draws"))


def rank_correlations(rows: DataFrame, by: list[str], x: str, y: str, least: int = 2, into: str = "ic") -> DataFrame:
    """by, n and into: the correlation of the ranks of x and y within each by (ties share their mean rank), for those with
    at least so many rows whose x and y are finite; null where one of them does not vary.

    A value's rank comes from how many rows have it and how many have a smaller one: values are counted first and the
    counts added up over range partitions, so no task holds all rows of a by."""
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf")) for c in (x, y)]
    held = rows.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(finite[0] & finite[1])
    sides = held.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("_side"), F.col(c).alias("_value")) for c in ("_x", "_y")))))
    counts = sides.groupBy(*by, "_side", "_value").agg(F.count("*").alias("_n"))
    upto = ordered.running_total(counts, ["_value"], "_n", "_upto", [*by, "_side"])
    ranks = upto.select(*by, "_side", "_value", (F.col("_upto") - (F.col("_n") - 1) / 2).alias("_rank"))
    for c in ("_x", "_y"):
        held = held.join(ranks.filter(F.col("_side") == c).select(*by, F.col("_value").alias(c), F.col("_rank").alias(f"_r{c}")), [*by, c])
    found = held.groupBy(*by).agg(F.count("*").alias("n"), correlation(F.col("_r_x"), F.col("_r_y")).alias(into))
    return found.filter(F.col("n") >= least)


def turnover(weights: DataFrame, book: list[str], at: str, name: str, weight: str) -> DataFrame:
    """book, at and turnover: half the sum of the names' changes of weight since the book's date before; the first date
    has none. A name that is not there has no weight, so one that comes or goes counts in full.

    Each weight is added at its own date and taken off at the next one, so nothing is joined name by name."""
    dates = weights.select(*book, at).distinct()
    line = Window.partitionBy(*book).orderBy(at)  # a row a date
    placed = dates.withColumns({"_next": F.lead(at).over(line), "_first": F.lag(at).over(line).isNull()})
    held = weights.join(placed, [*book, at]).withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    sides = F.array(F.struct(F.col(at).alias("_t"), F.col("_w").alias("_d")), F.struct(F.col("_next").alias("_t"), (-F.col("_w")).alias("_d")))
    moves = held.select(*book, name, F.inline(sides)).filter("_t IS NOT NULL")
    summed = moves.groupBy(*book, "_t", name).agg(F.sum("_d").alias("_d")).groupBy(*book, "_t").agg((F.sum(F.abs("_d")) / 2).alias("turnover"))
    first = placed.filter("_first").select(*book, F.col(at).alias("_t"))
    return summed.join(first, [*book, "_t"], "left_anti").withColumnRenamed("_t", at)
