"""Rank correlation by date, turnover, accounting across profiles, financing bases, forms, labels and sinks, by hand."""

import json
import math
import os
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import execution as X
from plumbline.operators import ledger, stats
from plumbline.streaming import flows


def test_rank_correlations(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), float(x), float(y)) for d in range(3) for x, y in zip(rng.integers(0, 6, 40), rng.integers(0, 9, 40))]
    rows += [(7, 1.0, 2.0), (7, 1.0, 3.0), (8, 1.0, 2.0)]  # x does not vary; one row only
    rows += [(0, None, 1.0), (0, math.nan, 1.0), (1, 5.0, math.inf), (0, -0.0, 4.0)]
    got = {r.day: (r.n, r.ic) for r in stats.rank_correlations(spark.createDataFrame(rows, "day int, x double, y double"), ["day"], "x", "y").collect()}
    frame = pd.DataFrame(rows, columns=["day", "x", "y"]).replace([np.inf], np.nan).dropna()
    ranks = frame.assign(x=frame.groupby("day").x.rank(), y=frame.groupby("day").y.rank())
    for day in range(3):
        part = ranks[ranks.day == day]
        assert got[day][0] == len(part) and abs(got[day][1] - part.x.corr(part.y)) < 1e-12
    assert got[7] == (2, None) and 8 not in got
    assert stats.rank_correlations(spark.createDataFrame([], "day int, x double, y double"), ["day"], "x", "y").collect() == []


def test_turnover(spark):
    rows = [("b", 1, "x", 0.5), ("b", 1, "y", 0.5), ("b", 2, "x", 0.25), ("b", 2, "z", 0.75), ("b", 5, "x", 0.25), ("b", 5, "z", None), ("c", 1, "x", 1.0)]
    got = {(r.book, r.at): r.turnover for r in stats.turnover(spark.createDataFrame(rows, "book string, at int, name string, w double"), ["book"], "at", "name", "w").collect()}
    assert got == {("b", 2): 0.75, ("b", 5): 0.375}


def test_accounting(spark):
    rows = [("t", "p", 1, 1, 1.0), ("t", "p", 1, 2, 9.0), ("t", "q", 1, 3, 9.0), ("t", "q", 2, 4, 3.0), ("t", "q", 3, 6, 5.0), ("t", "q", 3, 5, None)]
    df = spark.createDataFrame(rows, "study string, profile string, id int, at int, v double")
    r = ledger.accounting(df, ["study"], ["profile"], ["id"], ["at"], "v").collect()[0]
    assert (r.records, r.remeasured, r.duplicates, r.identities) == (6, 2, 1, 3) and r.records - r.remeasured - r.duplicates == r.identities
    assert r.variance == 2.0  # of 1 and 3: the first record of id 3 has no value, a later one does not stand in for it
    assert ledger.accounting(df.limit(0), ["study"], ["profile"], ["id"], ["at"], "v").collect() == []


def test_financing(spark):
    rows = [("1000.00", "400.00", 360), ("300.00", "400.00", 365), ("-1000.00", "400.00", 360), ("1000.00", None, 360), ("1000.00", "0.00", None), ("0.00", "5.00", 0)]
    df = spark.createDataFrame([(Decimal(c), s and Decimal(s), b) for c, s, b in rows], "cash decimal(18,2), short decimal(18,2), basis int")
    found = X.financing(F.col("cash"), F.col("short"), F.lit(0.02), F.lit(0.06), F.lit(0.01), F.lit(30), F.col("basis"))
    got = [(r.segregated, r.free, r.owed, r.payment, r.status) for r in df.select(*(v.alias(k) for k, v in found.items())).collect()]
    D = Decimal
    assert got[0] == (D("400.00"), D("600.00"), D("0.00"), D("1.333333"), "accrued")  # 600 x 2 % and 400 x 1 %, 30 of 360 days
    assert got[1] == (D("300.00"), D("0.00"), D("0.00"), D("0.246575"), "accrued")
    assert got[2] == (D("0.00"), D("0.00"), D("1000.00"), D("-5.000000"), "accrued")
    assert [x[3:] for x in got[3:5]] == [(None, "halted")] * 2 and got[5][3] is None


def test_labels_and_forms(spark):
    shown = lambda f, values, kind: [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]
    assert shown(S.money, [1234.5, -2.5, 0.0, math.nan, None, math.inf], "double") == ["$1,235", "$-2", "$0", None, None, None]
    assert shown(S.short_money, [1.5e9, 1e7, 250_400.0, 12.5, 2e9, None], "double") == ["$1.5B", "$10M", "$250k", "$13", "$2B", None]
    assert shown(S.span_of_days, [40, 913, 365, 366, None], "int") == ["40d", "2.5y", "365d", "1.0y", None]
    assert shown(S.tagged_hash, ["sha256:" + "a" * 58 + "bcdefg", None], "string") == ["sha256:aaaaaaaaaaaa...bcdefg", None]
    assert shown(S.escaped, ["<a & b>", "&lt;", "", None], "string") == ["&lt;a &amp; b&gt;", "&amp;lt;", "", None]
    ends = spark.createDataFrame([(0, 0.7, 0.8), (1, None, 0.8), (2, 0.7, math.nan), (3, None, None)], "k int, a double, b double")
    assert [r.x for r in ends.select("k", S.range_label(F.col("a"), F.col("b"), 2, "%").alias("x")).orderBy("k").collect()] == ["0.70 to 0.80%", "0.80%", "0.70%", None]
    assert ends.limit(1).select(S.joined_parts([F.lit("a"), F.lit(""), F.lit(None), F.lit("b")], " / ").alias("x")).collect()[0].x == "a / b"
    forms = [(0, None, " A@b.co "), (1, "  ", "a@b.co"), (2, "Acme", "a@b.co"), (3, "Acme", "bad"), (4, "", "bad"), (5, None, None), (6, None, "a" * 250 + "@b.co")]
    got = spark.createDataFrame(forms, "k int, trap string, address string").select("k", S.intake(F.col("trap"), F.col("address")).alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == ["accepted", "accepted", "dropped", "dropped", "invalid", "invalid", "invalid"]


def test_sinks_in_order(spark, tmp_path):
    rows, taken = spark.createDataFrame([(1,), (2,)], "id int"), []

    def broken(batch, number):
        raise OSError("full")

    store, mail = (lambda b, n: taken.append(("store", n, b.count()))), (lambda b, n: taken.append(("mail", n, b.count())))
    log = flows.json_log(str(tmp_path / "log"))
    flows.first_sink([("store", store), ("mail", mail)], log)(rows, 0)
    flows.first_sink([("store", None), ("mail", mail)], log)(rows, 1)
    assert taken == [("store", 0, 2), ("mail", 1, 2)] and not os.path.exists(tmp_path / "log")
    with pytest.raises(RuntimeError, match="store"):
        flows.first_sink([("store", broken), ("mail", mail)], log)(rows, 2)
    assert len(taken) == 2  # the batch went to no other sink
    for _ in range(2):
        flows.first_sink([("store", None), ("mail", None)], log)(rows, 3)
    files = [p for p in (tmp_path / "log" / "batch=3").iterdir() if p.suffix == ".json"]
    kept = [json.loads(line) for p in files for line in p.read_text().splitlines()]
    assert sorted(kept, key=str) == [{"id": 1, "stored": False}, {"id": 2, "stored": False}]


def test_sinks_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(str(source))
    got = []
    write = flows.first_sink([("mail", None), ("store", lambda b, n: got.extend(r.id for r in b.collect()))], flows.json_log(str(tmp_path / "log")))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 4).parquet(str(source))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == list(range(30))
