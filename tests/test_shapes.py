"""Scales, curves, typed entries and figures without an explanation, on small rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import text as T


def test_scales(spark):
    row = spark.range(1).select(
        S.linear_scale(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(1.0), F.lit(3.0)).alias("flat"), S.linear_scale(F.lit(15.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(2.0)).alias("beyond"),
        S.decades(F.lit(5.0), F.lit(2000.0)).alias("d"), S.decades(F.lit(2.0), F.lit(5.0)).alias("none"), S.decades(F.lit(0.0), F.lit(5.0)).alias("zero"), S.decades(F.lit(1.0), F.lit(1.0)).alias("one"),
        S.smoothstep(F.lit(0.25), F.lit(0.0), F.lit(1.0)).alias("s"), S.smoothstep(F.lit(2.0), F.lit(2.0), F.lit(2.0)).alias("step"), S.signed_percent(F.lit(1234.5)).alias("p"), S.signed_percent(F.lit(-0.5), 1).alias("m"),
    ).first()
    assert (row.flat, row.beyond, row.d, row.none, row.zero, row.one) == (1.0, 3.0, [1, 2, 3], [], [], [0])
    assert (row.s, row.step, row.p, row.m) == (0.15625, 1.0, "+1234.50%", "-0.5%")


def test_breakpoints(spark):
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(10, 5), (0, 0), (20, 25), (10, 7)]))
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 5.0, 10.0, 15.0, 20.0, 99.0)], "x double")
    assert [r.h for r in df.select(S.on_breakpoints(F.col("x"), points).alias("h")).collect()] == pytest.approx([0, 0, 2.5, 7, 16, 25, 25])
    assert df.select(S.on_breakpoints(F.col("x"), F.array().cast("array<struct<x:double,y:double>>")).alias("h")).first().h is None


def test_typed_entries(spark):
    documents = ['{"a": true, "b": false, "c": 1, "d": "true", "e": null, "f": [true], "g": {"h": true}}', "{}", "[true]", "true", "no json", None]
    df = spark.createDataFrame([(x,) for x in documents], "j string")
    assert [r.g for r in df.select(S.boolean_entries(F.col("j")).alias("g")).collect()] == [{"a": True, "b": False}, {}, None, None, None, None]


def test_each_figure_has_its_own_window(spark):
    pad = "." * 50
    texts = [f"withdrawn: 0.83 {pad} and 0.83 again", f"0.83 {pad} RETRACTED 0.83", "0.83", "retracted", "", None, "0.83 retracted 0.83 0.83"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r.s for r in df.select(T.unexplained(r"0\.83", "withdrawn|retracted", 20)(F.col("t")).alias("s")).collect()]
    assert [[(x.start, x.stop) for x in r] for r in got] == [[(71, 75)], [(0, 4)], [(0, 4)], [], [], [], []]
