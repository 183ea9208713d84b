"""Replays of amended rows, actions of one day, the normal distribution and resampled blocks, against plain Python."""

import hashlib
import math
import statistics
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import execution, governance, stats


def test_state_hash_is_of_the_set_of_lines(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", 3, "y"), ("b", 1, "x"), ("c", 1, "x"), ("c", 2, "x")]
    df = spark.createDataFrame(rows, "g string, i int, line string")

    def states(frame):
        return {r.g: r.state for r in governance.state_hash(frame, ["g"], F.col("line")).collect()}

    def expected(lines):
        digests = [hashlib.sha256((x or "").encode()).hexdigest() for x in lines]
        sums = [sum(int(d[k : k + 15], 16) for d in digests) for k in (0, 15, 30, 45)]
        return hashlib.sha256(":".join(map(str, [len(lines), *sums])).encode()).hexdigest()

    assert states(df) == states(df.orderBy(F.desc("i")).repartition(3)) == {"a": expected(["x", None, "y"]), "b": expected(["x"]), "c": expected(["x", "x"])}
    assert states(df.withColumn("line", F.when(F.col("i") == 3, "z").otherwise(F.col("line"))))["a"] != expected(["x", None, "y"])
    assert states(df.limit(0)) == {}


def test_spans_of_revisions(spark):
    rows = [("a", 0, 1), ("a", 1, 5), ("a", 2, 3), ("b", 0, 2)]  # the third revision was known before the second
    df = spark.createDataFrame(rows, "k string, revision int, known int")
    got = {(r.k, r.revision): r.known_until for r in governance.known_spans(df, ["k"], "revision", "known").collect()}
    assert got == {("a", 0): 3, ("a", 1): 3, ("a", 2): None, ("b", 0): None}


def test_actions_of_one_day(spark):
    """A dividend is of the shares held before the day, in whatever order its actions come."""
    holdings = spark.createDataFrame([("p", date(2024, 1, 1), 10.0, 8.0)], "k string, at date, shares double, price double")
    days = [(date(2024, 2, 1), 2.0, 0.5), (date(2024, 2, 1), 3.0, 0.25), (date(2024, 3, 1), 1.0, 1.0)]
    for order in (days, days[::-1]):
        actions = spark.createDataFrame([("p", d, d, ratio, paid) for d, ratio, paid in order], "k string, effective date, announced date, ratio double, dividend double")
        row = execution.replay(holdings, actions, "k", "at").first()
        assert (row.adjusted_shares, row.cash, row.status) == (60.0, 10 * 0.75 + 60 * 1.0, "ok")


def test_normal_cdf(spark):
    values = [0.0, 1e-300, 0.5, -0.5, 3.0, -6.5, 7.99, -8.0, 8.5, -40.0, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.p for r in df.select(stats.normal_cdf(F.col("x")).alias("p")).collect()]
    want = [statistics.NormalDist().cdf(v) for v in values[:-2]]
    assert got[:-2] == pytest.approx(want, abs=2e-15) and got[-2:] == [None, None]


@pytest.mark.parametrize("n", [1, 2, 7, 21, 22, 50])
def test_bootstrap_of_blocks(spark, n):
    """Against the rows of each resample; a series shorter than a block is cut to its own length, one side may be flat,
    a row without one of its values counts in no sum."""
    rng = np.random.default_rng(n)
    x, y = 100 + rng.normal(size=n), rng.normal(size=n)
    y[1:2] = np.nan
    rows = [(k, i, float(x[i]) if k != "flat" else 4.2, None if np.isnan(y[i]) else float(y[i])) for k in ("one", "flat") for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double")
    got = {r.k: r for r in stats.bootstrap_bound(df, ["k"], "i", "x", "y", draws=60).collect()}
    found = []
    for draw in range(60):
        at = []
        for k in range(-(-n // 21)):
            start = int(hashlib.sha256(f"20260816:{draw}:{k}".encode()).hexdigest()[:8], 16) % n
            at += [(start + j) % n for j in range(21) if k * 21 + j < n]
        u, v = x[at], y[at]
        u, v = u[~np.isnan(v)], v[~np.isnan(v)]
        if len(u) and u.std() > 1e-12 and v.std() > 1e-12:
            found.append(np.corrcoef(u, v)[0, 1])
    assert got["flat"].draws == 0 and got["flat"].bound is None and got["one"].draws == len(found)
    assert got["one"].bound == pytest.approx(np.quantile(found, 0.95) if found else None, abs=1e-9)
