"""Published arithmetic, fail-closed rules and edge cases on inline rows."""

import json
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import execution as X
from plumbline.operators import governance as G
from plumbline.operators import ledger, stats, text, timeline


def artifacts() -> list[tuple[str, str]]:
    """Small documents of our own: sound, altered, hashed before their time stamp was put in, without a hash, broken."""
    body = {"schema": "demo/1", "n": 100000, "x": 100000.0, "name": "é", "nested": {"b": [1, None], "a": True}}
    digest = lambda d: "sha256:" + G.sha256_hex(json.dumps(d, sort_keys=True, separators=(",", ":")))
    stamped = body | {"generated_at": "2026-01-01"}
    rows = {
        "sound": body | {"content_hash": digest(body)}, "altered": body | {"n": 1, "content_hash": digest(body)},
        "late_stamp": stamped | {"content_hash": digest(body)}, "unsigned": body, "manifest": body | {"content_hash": "sha256:0"},
    }
    return [*((k, json.dumps(v, ensure_ascii=False)) for k, v in rows.items()), ("broken", '{"a": ')]


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_published_arithmetic(spark):
    lit = lambda x: F.lit(float(x))
    r = one(
        spark, fill=X.capped_fill(lit(100), lit(100), lit(50_000), 0.1), dry=X.capped_fill(lit(100), lit(100), F.lit(None).cast("double"), 0.1),
        small=X.impact(lit(8333.33), lit(5e9), lit(0.008234)) * 1e4, large=X.impact(lit(8_333_333.33), lit(5e9), lit(0.008234)) * 1e4,
        days=X.stressed_days(lit(3), lit(0.5)), deploy=G.deployable(lit(0.2112), lit(0.8818), F.lit(True)), unknown=G.deployable(F.lit(None).cast("double"), lit(0.1), F.lit(True)),
    )
    assert (r.fill, r.dry, r.days, r.deploy, r.unknown) == (50, 0, 6, False, False)
    assert r.small == pytest.approx(0.106, abs=5e-4) and r.large == pytest.approx(3.362, abs=5e-4)
    status, reasons = X.limits([("flow", F.lit(None).cast("double"), 1.0), ("days", F.lit(6.0), 5.0)])
    r = one(spark, status=status, reasons=reasons)
    assert (r.status, r.reasons) == ("unassessable", "flow missing,days over limit")


def test_scalars(spark):
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    r = one(
        spark, a=S.finite(nan), b=S.finite(F.lit(float("inf"))), c=S.midpoint(F.lit(1.0), F.lit(3.0)), d=S.midpoint(nan, F.lit(3.0)), e=S.midpoint(none, none),
        dash=S.plain_dashes(F.lit("a — b–c")), hash=S.short_hash(F.lit("sha256:0123456789abcdef0123456789")), slug=S.slug(F.lit("--Ab c!d--")), title=S.titled(F.lit("net_of_Fees")),
        pad=S.padded(F.lit(7)), wide=S.padded(F.lit(123)), pct=S.signed_percent(F.lit(1.5)), amount=S.compact_amount(F.lit(2_500_000.0)), whole=S.compact_amount(F.lit(3000.0)),
        mail=S.valid_address(F.lit(" A@b.co ")), bad=S.valid_address(F.lit("a@b")), missing=S.valid_address(F.lit(None).cast("string")), cut=S.shortened(F.lit("x" * 21)),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (None, None, 2, 3, None)
    assert (r.dash, r.hash, r.slug, r.title) == ("a - b - c", "0123456789ab...456789", "ab-c-d", "Net Of Fees")
    assert (r.pad, r.wide, r.pct, r.amount, r.whole) == ("07", "123", "+1.50%", "2.5M", "3K")
    assert (r.mail, r.bad, r.missing, r.cut) == (True, False, False, "x" * 16 + "…")


def test_ledgers(spark):
    df = spark.createDataFrame([(k, k % 3, None if k == 4 else float(k)) for k in range(140)], "i int, g int, v double")
    counts = {r.reason: r.n for r in ledger.attrition(df, [("small", F.col("v") < 50), ("odd", F.col("i") % 2 == 1)]).collect()}
    assert sum(counts.values()) == 140 and counts["small"] == 49
    assert ledger.thinned(df.withColumn("g", F.lit(0)), ["g"], [F.col("i")], 24).count() == 24
    top = ledger.top_with_overflow(df, ["g"], [F.desc("v"), F.col("i")], 50).groupBy("g").agg(F.max("rank"), F.max("more")).collect()
    assert {tuple(r) for r in top} == {(0, 47, 0), (1, 47, 0), (2, 46, 0)}
    firsts = ledger.first_records(spark.createDataFrame([("a", 2, 9.0), ("a", 1, 5.0), ("b", 1, 1.0)], "k string, t int, v double"), ["k"], ["t"])
    assert {tuple(r) for r in firsts.collect()} == {("a", 1, 5.0), ("b", 1, 1.0)}


def test_timeline(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(1)), (3, "b", t(5))], "id int, k string, at timestamp_ntz")
    right = spark.createDataFrame([("a", t(2), 1.0), ("a", t(5), 2.0), ("a", t(9), 3.0)], "k string, known timestamp_ntz, v double")
    assert {(r.id, r.x) for r in timeline.as_of(left, right, "k", "at", "known", "v", "x").collect()} == {(1, 2.0), (2, None), (3, None)}
    spans = spark.createDataFrame([("a", 0, 4), ("a", 2, 6), ("a", 8, 9)], "k string, s int, e int")
    assert sorted((r.start, r.stop, r.depth) for r in timeline.sweep(spans, "k", "s", "e").collect()) == [(0, 2, 1), (2, 4, 2), (4, 6, 1), (6, 8, 0), (8, 9, 1)]
    needs = spark.createDataFrame([(1, "a", 1, 3), (2, "a", 3, 4), (3, "a", 7, 9)], "id int, k string, s int, e int")
    quotes = spark.createDataFrame([("a", 0, 4), ("a", 2, 6)], "k string, vf int, vu int")
    assert {(r.id, r.status) for r in timeline.cover(needs, quotes, "k", ("s", "e"), ("vf", "vu")).collect()} == {(1, "covered"), (2, "ambiguous"), (3, "missing")}


def test_statistics(spark):
    rng = np.random.default_rng(1)
    rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(rng.normal(0.001 * (c == "a"), 0.01))) for c in "abc" for k in range(200)]
    df = spark.createDataFrame(rows, "c string, d date, r double")
    r = stats.overfitting(df, "c", "d", "r", 6).first()
    assert r.n_splits == 20 and 0 <= r.pbo <= 1
    assert stats.overfitting(df.filter("c = 'a'"), "c", "d", "r", 6).first().pbo is None
    assert stats.expected_best(1, 1.0) == 0 and stats.expected_best(100, 1.0) == pytest.approx(2.53, abs=0.02)
    x = np.array([v for c, _, v in rows if c == "a"])
    e = x - x.mean()
    s = (e**2).sum() + 2 * sum((1 - k / 4) * (e[k:] * e[:-k]).sum() for k in (1, 2, 3))
    got = {r.c: r.t for r in stats.newey_west_t(df, "c", "d", "r", 3).collect()}
    assert got["a"] == pytest.approx(x.mean() / (np.sqrt(s) / len(x)))


def test_hashes(spark):
    docs = spark.createDataFrame(artifacts(), "name string, raw string")
    got = {r.name: (r.status, r.matches_without_time) for r in G.verify_hashes(docs, ["manifest"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {"sound": "PASS", "altered": "FAIL", "late_stamp": "FAIL", "unsigned": "SKIP", "manifest": "SKIP", "broken": "SKIP"}
    assert got["late_stamp"][1] and not got["altered"][1]


def test_replay_and_chain(spark):
    d = lambda m: dt.date(2024, m, 1)
    held = spark.createDataFrame([("x", d(1), 10.0, 100.0), ("y", d(1), 5.0, 1.0)], "k string, at date, shares double, price double")
    acts = spark.createDataFrame([("x", d(3), d(2), 2.0, 0.0), ("x", d(5), d(6), 1.0, 0.5), ("x", d(1), d(1), 9.0, 9.0)], "k string, effective date, announced date, ratio double, dividend double")
    got = {r.k: (round(r.adjusted_shares, 9), round(r.adjusted_price, 9), r.cash, r.status) for r in X.replay(held, acts, "k", "at").collect()}
    assert got == {"x": (20.0, 50.0, 10.0, "late_action"), "y": (5.0, 1.0, 0.0, "ok")}
    chain = spark.createDataFrame([(100.0, 9.0, 11.0), (110.0, 5.0, 6.0), (130.0, 6.0, 5.0)], "strike double, bid double, ask double")
    rows = {r.strike: (r.crossed, r.monotone, r.convex) for r in X.chain_checks(chain.withColumn("s", F.lit(1)), ["s"]).collect()}
    assert rows == {100.0: (False, True, True), 110.0: (False, True, True), 130.0: (True, True, True)}


def test_texts(spark):
    df = spark.createDataFrame([(1, "a", "one two three four five six"), (2, "a", "one two three four five seven"), (3, "a", None), (4, "b", "")], "d int, s string, t string")
    got = {r.d: r.similarity for r in text.adjacent_similarity(df, "s", "d", "t").collect()}
    assert got == {2: pytest.approx(1 / 3), 3: 0.0}  # a null text has no shingles
    hits = text.context_windows(df, "d", "t", "f[a-z]+", 3).collect()
    assert {(r.start, r.hit, r.context) for r in hits if r.d == 1} == {(14, "four", "ee four fi"), (19, "five", "ur five si")}


def test_repeated_rows_stay_apart(spark):
    needs = spark.createDataFrame([("a", 1, 3), ("a", 1, 3)], "k string, s int, e int")
    quotes = spark.createDataFrame([("a", 0, 5)], "k string, vf int, vu int")
    assert [(r.n_quotes, r.status) for r in timeline.cover(needs, quotes, "k", ("s", "e"), ("vf", "vu")).collect()] == [(1, "covered")] * 2
    held = spark.createDataFrame([("a", 1, 10.0, 6.0)] * 2 + [("b", 1, 10.0, 6.0)], "k string, at int, shares double, price double")
    acts = spark.createDataFrame([("a", 2, 1, 2.0, 1.0), ("a", 3, 1, 3.0, 1.0), ("b", 2, 1, 0.0, 0.0)], "k string, effective int, announced int, ratio double, dividend double")
    got = sorted((r.k, r.adjusted_shares, r.adjusted_price, r.cash, r.status) for r in X.replay(held, acts, "k", "at").collect() if r.k == "a")
    assert got == [("a", 60.0, 1.0, 30.0, "ok")] * 2
    assert [r.status for r in X.replay(held, acts, "k", "at").collect() if r.k == "b"] == ["invalid_ratio"]


def test_known_as_of(spark):
    asked = [("a", t) for t in range(8)] + [("b", 3), ("a", 4)]
    facts = [("a", 1, 3, 10), ("a", 2, 2, 20), ("a", 6, 4, 60), ("a", 2, 5, 21), ("a", None, 1, 9)]
    want = []
    for k, t in asked:
        seen = [f for f in facts if f[0] == k and f[1] is not None and f[1] <= t and f[2] <= t]
        ahead = any(f[0] == k and f[1] is not None and f[2] <= t < f[1] for f in facts)
        want.append((k, t, max(seen, key=lambda f: f[1:])[3] if seen else None, ahead))
    left = spark.createDataFrame(asked, "k string, t int")
    right = spark.createDataFrame(facts, "k string, eff int, avail int, v int")
    got = [tuple(r) for r in timeline.known_as_of(left, right, "k", "t", "eff", "avail", "v", "x").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sweep_of_what_is_available(spark):
    spans = spark.createDataFrame([("a", 0, 4, 2), ("a", 3, 6, None), ("a", 7, 9, 12), ("a", 10, 11, 1), ("a", 10, 11, 1)], "k string, s int, e int, v int")
    rows = spans.collect()
    found = timeline.sweep(spans, "k", "s", "e", "v").withColumn("label", timeline.coverage_label(F.col("depth"), F.col("seen"))).collect()
    assert sorted((r.start, r.stop) for r in found) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7), (7, 9), (9, 10), (10, 11)]
    for r in found:
        over = [x for x in rows if x.s <= r.start and r.stop <= x.e]
        known = [x for x in over if x.v is not None and x.v <= r.start]
        assert (r.depth, r.seen) == (len(over), len(known))
        assert r.label == ("covered" if known else "status_not_yet_available" if over else "no_effective_status")


def test_orders_that_lower_risk_and_packages_with_a_limit(spark):
    lit = lambda x: F.lit(x).cast("double")
    status, reasons = X.limits([("flow", F.lit(None).cast("double"), 1.0), ("days", lit(6), 5.0)], F.lit(True))
    calm, _ = X.limits([("days", lit(4), 5.0)], F.lit(True))
    unknown, _ = X.limits([("days", lit(6), 5.0)], F.lit(None).cast("boolean"))
    r = one(spark, status=status, reasons=reasons, calm=calm, unknown=unknown, fee=X.borrow_fee(lit(100), lit(20), lit(0.05), lit(73)), gain=X.variation_margin(lit(-3), 50, lit(10), lit(9)))
    assert (r.status, r.reasons, r.calm, r.unknown) == ("reduce_only", "flow missing,days over limit", "ok", "blocked")
    assert (r.fee, r.gain) == (pytest.approx(20.0), 150.0)
    legs = spark.createDataFrame([(1, 9.0, 2, 3, "IOC", 5.0), (1, 9.0, 1, 3, "IOC", -4.0), (2, 9.0, 2, 3, "IOC", 5.0), (3, 9.0, 1, 3, "IOC", None), (3, 9.0, 1, 3, "IOC", 1.0)], "p int, size double, ratio int, wanted int, kind string, debit double")
    assert {(r.p, r.filled) for r in X.package_units(legs, "p", "size", "ratio", "wanted", "kind", "debit", 6.0).collect()} == {(1, 3), (2, 0), (3, 0)}


def test_stale_quotes_and_currencies(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("x", 1.0, t(10), "USD"), ("x", 2.0, t(50), "USD"), ("x", 3.0, t(59), "USD"), ("y", 1.0, t(40), "USD"), ("y", 2.0, None, "EUR"), ("z", 1.0, t(40), None)]
    chain = spark.createDataFrame(rows, "s string, strike double, q timestamp_ntz, c string").withColumns({"bid": F.lit(1.0), "ask": F.lit(2.0), "now": F.lit(t(55))})
    got = {(r.s, r.strike): (r.stale, r.one_currency) for r in X.chain_checks(chain, ["s"], "q", "now", 30, "c").collect()}
    assert got == {("x", 1.0): (True, True), ("x", 2.0): (False, True), ("x", 3.0): (True, True), ("y", 1.0): (False, False), ("y", 2.0): (True, False), ("z", 1.0): (False, False)}
