"""Sharpe probabilities and the probability of overfitting against plain Python."""

import itertools
import math
import random
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import stats


def test_probabilistic_sharpe(spark):
    rows = [(0.1, 250, -0.5, 4.0, 0.0), (0.05, 60, 0.2, 3.0, 0.08), (-0.2, 30, 1.0, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "sr double, n long, skew double, kurt double, b double")
    got = [r.p for r in df.select(stats.probabilistic_sharpe(*(F.col(c) for c in ("sr", "n", "skew", "kurt", "b"))).alias("p")).collect()]
    want = [NormalDist().cdf((sr - b) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)) for sr, n, skew, kurt, b in rows]
    assert got == pytest.approx(want, abs=1e-12)


def test_expected_best():
    assert stats.expected_best(1, 0.5) == 0.0
    draws = np.random.default_rng(1).normal(0, 0.2, (100_000, 40)).max(1).mean()
    assert stats.expected_best(40, 0.04) == pytest.approx(draws, rel=0.02)


@pytest.mark.parametrize("configs", [2, 5])
def test_overfitting(spark, configs):
    rng = random.Random(configs)
    days = [date(2024, 1, 1) + timedelta(k) for k in range(80)]
    series = {f"c{c}": [rng.gauss(0.01 * c, 1) for _ in days] for c in range(configs)}
    df = spark.createDataFrame([(c, d, x) for c, xs in series.items() for d, x in zip(days, xs)], "c string, day date, r double")
    ratio = lambda xs: float(np.mean(xs) / np.std(xs))
    low = []
    for half in itertools.combinations(range(8), 4):
        inside = {c: ratio([x for k, x in enumerate(xs) if k // 10 in half]) for c, xs in series.items()}
        outside = {c: ratio([x for k, x in enumerate(xs) if k // 10 not in half]) for c, xs in series.items()}
        best = max(inside, key=lambda c: (inside[c], c))
        rank = sum(v < outside[best] for v in outside.values()) + 1
        low.append(rank / (configs + 1) <= 0.5)
    got = stats.overfitting(df, "c", "day", "r").first()
    assert got.n_splits == 70 and got.pbo == pytest.approx(sum(low) / 70)
    assert stats.overfitting(df.filter("c = 'c0'"), "c", "day", "r").first().pbo is None
