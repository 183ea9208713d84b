"""Quantiles by selection, least squares by sums of products and merged drawdowns against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import selection, stats


@pytest.mark.parametrize("cells,small", [(4096, 50_000), (4, 3), (2, 1)])
def test_quantiles(spark, monkeypatch, cells, small):
    monkeypatch.setattr(selection, "CELLS", cells)
    monkeypatch.setattr(selection, "SMALL", small)
    rng = random.Random(3)
    rows = [(g, x) for g, xs in {"ties": [5.0] * 40 + [6.0], "wide": [rng.gauss(0, 1e6) for _ in range(60)], "one": [3.0], None: [1.0, 2.0], "odd": [1e-300, 1.0, 1e300, -1e300]}.items() for x in xs]
    given = [*rows, ("ties", None), ("ties", math.nan), ("none", None), ("wide", math.inf)]
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: [r[x] for x in at] for r in selection.quantiles(spark.createDataFrame(given, "g string, x double"), ["g"], "x", at).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, values in got.items():
        assert np.allclose(values, np.quantile([x for k, x in rows if k == g], list(at.values())), rtol=1e-12)


def test_many_values(spark):
    df = spark.range(200_000).selectExpr("id % 2 AS g", "hash(id) * 1.0 AS x")
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("p")).collect()}
    got = {r.g: [r.a, r.b, r.c] for r in selection.quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    assert all(np.allclose(got[g], want[g], rtol=1e-12) for g in want) and len(got) == 2


def test_ols(spark):
    rng = np.random.default_rng(1)
    rows = []
    for cohort, n in (("a", 80), ("b", 12), ("c", 60), ("d", 40)):
        for i in range(n):
            x1, x2 = rng.normal(1e6, 3), rng.normal()
            noise = 0.0 if cohort == "d" else rng.normal()
            y = 3 * x1 + noise if cohort != "d" else 1.0
            rows.append((len(rows), cohort, "pqr"[i % 3], float(y), float(x1), float(2 * x1 if cohort == "c" else x2)))
    df = spark.createDataFrame(rows + [(999, "a", "p", None, 1.0, 1.0), (998, "a", "p", math.nan, 1.0, 1.0)], "key long, cohort string, g string, y double, x1 double, x2 double")
    got = {r.key: r.residual for r in stats.ols_residual(df, "cohort", "y", ["x1", "x2"], "g", "key").collect()}
    want = {}
    for cohort in "ac":  # b has too few degrees of freedom, d too few residuals
        own = [r for r in rows if r[1] == cohort]
        x = np.array([[r[2] == "p", r[2] == "q", r[2] == "r", r[4] - 1e6, r[5] - (2e6 if cohort == "c" else 0)] for r in own], float)
        y = np.array([r[3] for r in own]) - 3e6
        beta, *_ = np.linalg.lstsq(x, y, rcond=1e-12)
        want |= {r[0]: v for r, v in zip(own, y - x @ beta)}
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_drawdown(spark):
    rng = random.Random(4)
    series = {k: [math.exp(rng.gauss(0, 1)) for _ in range(n)] for k, n in (("a", 200), ("b", 1), ("c", 30))}
    series["up"] = [1.0, 2.0, 3.0]
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)] + [("a", 500, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r.max_drawdown for r in stats.max_drawdown(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], ["i"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {k: min(v / max(vs[: i + 1]) - 1 for i, v in enumerate(vs)) for k, vs in series.items()}
    assert got == pytest.approx(want)
