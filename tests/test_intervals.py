"""Joins by cells and carried quotes against plain Python, and one key with 10^5 rows on both sides."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import intervals, ordered, timeline


def test_levels_and_cells(spark):
    spans = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (3.0, 900.0), (-5e9, 7e9), (2.0, 1.0), (None, 1.0), (1.0, None)], "a double, b double")
    celled = intervals.with_cells(spans, "a", "b")
    per = {(r.a, r.b): r["count"] for r in celled.groupBy("a", "b").count().collect()}
    assert set(per) == {(0.0, 0.0), (0.0, 1.0), (3.0, 900.0), (-5e9, 7e9)} and max(per.values()) <= 3


@pytest.mark.parametrize("kind", ["double", "timestamp", "date"])
def test_cover_as_brute_force(spark, kind):
    rng = random.Random(1)
    span = lambda: (lambda a, n: (a, a + n))(rng.randint(0, 400), rng.choice([0, 1, 3, 20, 300]))
    needs = [(rng.choice(["a", "b", None]), *span()) for _ in range(150)] + [("a", None, 3), ("a", 5, None), ("b", 7, 9), ("b", 7, 9)]
    quotes = [(rng.choice(["a", "b", None]), *span()) for _ in range(150)] + [("a", None, 9), ("b", 9, 2)]
    shown = {"double": "CAST({} AS DOUBLE)", "timestamp": "timestamp_micros({} * 77)", "date": "date_from_unix_date({})"}[kind]
    frame = lambda rows, a, b: spark.createDataFrame(rows, "k string, x long, y long").select("k", F.expr(shown.format("x")).alias(a), F.expr(shown.format("y")).alias(b), "x", "y")
    got = timeline.cover(frame(needs, "start", "stop"), frame(quotes, "since", "until").drop("x", "y"), "k", ("start", "stop"), ("since", "until")).collect()
    full = lambda *v: None not in v
    want = [(k, x, y, sum(full(k, x, y, a, b) and q == k and a <= x and b >= y and a <= b for q, a, b in quotes)) for k, x, y in needs]
    assert sorted(((r.k, r.x, r.y, r.n_quotes) for r in got), key=str) == sorted(want, key=str)


def test_nearest_quotes_as_brute_force(spark):
    rng = random.Random(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marks = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(60)])) for i in range(120)] * 2
        quotes = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(60)]), rng.choice([1.0, 2.0, 3.0])) for _ in range(80)]
        m = spark.createDataFrame(marks, "id long, k string, s long").select("id", "k", F.expr("timestamp_seconds(s)").alias("at"), "s")
        q = spark.createDataFrame(quotes, "k string, s long, v double").select("k", F.expr("timestamp_seconds(s)").alias("t"), "v")
        got = timeline.first_after_last_before(m, q, "k", "at", "t", "v", "5 SECONDS", "3 SECONDS").collect()

        def one(i, k, s):
            own = [(t, v) for q_, t, v in quotes if k is not None and q_ == k and t is not None and s is not None]
            entry = min((x for x in own if s <= x[0] <= s + 5), default=(None, None))
            left = max((x for x in own if s - 3 <= x[0] <= s), default=(None, None))
            return i, k, s, entry[1], left[1]

        assert sorted(((r.id, r.k, r.s, r.entry, r.exit) for r in got), key=str) == sorted((one(*x) for x in marks), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_busy_key(spark):
    """10^5 needs and 10^5 quotes of one key: no pairs but those that share a cell are made."""
    n = 100_000
    quotes = spark.range(n).selectExpr("'hot' AS k", "timestamp_seconds(id * 10) AS since", "timestamp_seconds(id * 10 + 10) AS until")
    needs = spark.range(n).selectExpr("'hot' AS k", "timestamp_seconds(id * 10 + 2) AS start", "timestamp_seconds(id * 10 + if(id % 4 = 0, 12, 5)) AS stop")
    found = {r.status: r["count"] for r in timeline.cover(needs, quotes, "k", ("start", "stop"), ("since", "until")).groupBy("status").count().collect()}
    assert found == {"covered": n * 3 // 4, "missing": n // 4}
    q = quotes.withColumn("_since", F.col("since")).withColumn("_until", F.col("until")).select(F.col("k").alias("_key"), "_since", "_until")
    met = intervals.stabbed(needs, "start", q, "_since", "_until", {"k": "_key"}, F.lit(True))
    assert met.count() < 4 * n
    marks = needs.select("k", "start")
    near = timeline.first_after_last_before(marks, quotes.select("k", "since", F.lit(1.0).alias("v")), "k", "start", "since", "v", "8 SECONDS", "2 SECONDS")
    assert near.filter("entry = 1 AND exit = 1").count() == n - 1


def test_carried(spark):
    rows = [("a", t, None if t % 3 else t) for t in range(50)] + [("b", 5, None)]
    got = ordered.carried(spark.createDataFrame(rows, "k string, t long, v long").repartition(4), ["t"], "v", "c", ["k"]).collect()
    assert {(r.k, r.t): r.c for r in got} == {(k, t): (t // 3 * 3 if k == "a" else None) for k, t, _ in rows}


def test_days_that_are_missing(spark):
    day = lambda rows: spark.createDataFrame(rows, "k string, n int").select("k", F.expr("date_from_unix_date(n)").alias("day"), "n")
    days = day([("a", 1), ("a", 4), ("b", 2), ("b", 3), ("c", None)])
    got = timeline.gaps(days.drop("n"), day([("x", n) for n in range(6)] + [("x", None)]).drop("n"), "k", "day").selectExpr("k", "unix_date(day) AS n").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("a", 3)]
