"""Numbers, predecessors and running totals against plain Python, with hot keys, ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.6 else rng.choice("abc"), k, rng.choice([None, 1, 2, 3])) for k in range(500)]
    rng.shuffle(made)
    return made, spark.createDataFrame(made, "k string, t long, v long").repartition(6)


@pytest.fixture(autouse=True)
def parts_stay_apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def groups(made):
    out = {}
    for r in sorted(made, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers_of_keys_and_of_all(rows):
    made, df = rows
    want = sorted(((*r, i + 1) for g in groups(made).values() for i, r in enumerate(g)), key=str)
    assert sorted(map(tuple, ordered.numbered(df, ["t"], ["k"]).collect()), key=str) == want
    got = ordered.numbered(df, [F.col("v").desc_nulls_last(), "t"]).collect()
    assert [r.t for r in sorted(got, key=lambda r: r.number)] == [r[1] for r in sorted(made, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))]


def test_a_hot_key_is_in_several_parts(rows):
    _, df = rows
    laid = ordered.laid(df, ["k"], ["t"])
    assert laid.filter("k = 'hot'").select(ordered.PART).distinct().count() > 1


def test_ties_are_numbered_once_each(spark):
    df = spark.range(0, 300, 1, 5).selectExpr("7 AS k", "1 AS t")
    got = sorted(r.number for r in ordered.numbered(df, ["t"], ["k"], keep=["k"]).collect())
    assert got == list(range(1, 301))
    assert sorted(r.number for r in ordered.numbered(df, ["t"]).collect()) == list(range(1, 301))


def test_previous(rows):
    made, df = rows
    want = sorted(((*r, *((g[i - 1][1], g[i - 1][2]) if i else (None, None))) for g in groups(made).values() for i, r in enumerate(g)), key=str)
    got = ordered.with_previous(df, ["t"], ["t", "v"], ["t0", "v0"], ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_running_total(rows):
    made, df = rows
    want = sorted(((*r, sum(x[2] or 0 for x in g[: i + 1])) for g in groups(made).values() for i, r in enumerate(g)), key=str)
    assert sorted(map(tuple, ordered.running_total(df, ["t"], "v", keys=["k"]).collect()), key=str) == want


def test_empty(spark):
    none = spark.createDataFrame([], "k string, t long, v long")
    assert ordered.numbered(none, ["t"]).collect() == ordered.with_previous(none, ["t"], ["v"], ["v0"], ["k"]).collect() == []


def test_folder_of_a_cluster_must_be_set(spark, monkeypatch):
    from plumbline.operators import shared

    class Context:
        master, applicationId = "spark://somewhere:7077", "x"

    class Session:
        conf, sparkContext = spark.conf, Context

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            shared.folder(Session)


def test_lines_as_sql_on_odd_rows(spark, tmp_path):
    """Null, infinite and NaN places, a nation whose suppliers have none, and very many breakpoints of one nation."""
    import duckdb

    import __spark_entry__ as entry

    rng = random.Random(8)
    odd = [None, float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 2.0]
    suppliers = [(k, rng.choice([1, 2, None]), rng.choice([None, *range(9)])) for k in range(60)] + [(60, 3, None), (None, 4, 1.0), (61, 4, 5.0)]
    suppliers += [(100 + k, 5, odd[k % 7]) for k in range(7)] + [(1000 + k, 6, k * 0.5) for k in range(3000)]
    customers = [(k, rng.choice([1, 2, 3, 4, 5, 7, None]), rng.choice([*odd, rng.uniform(-1, 10)])) for k in range(400)]
    customers += [(1000 + k, 6, rng.uniform(-10, 1600)) for k in range(3000)]
    as_double = lambda rows: [(a, b, None if c is None else float(c)) for a, b, c in rows]
    spark.createDataFrame(as_double(suppliers), "s_suppkey long, s_nationkey int, s_acctbal double").repartition(3).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(as_double(customers), "c_custkey long, c_nationkey int, c_acctbal double").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("supplier", "customer"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duckdb.sql(entry.oracle_sql()["breakpoint_line"]).fetchall()
    got = entry.queries()["breakpoint_line"](spark, str(tmp_path)).collect()
    assert len(want) > 3200
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_lines_have_no_arrays_of_points(spark):
    """A row's work does not grow with the points of its key."""
    points = spark.range(20_000).selectExpr("1 AS k", "id * 1.0D AS x", "id * 2.0D AS y")
    rows = spark.range(20_000).selectExpr("1 AS k", "id + 0.25D AS at")
    found = ordered.on_lines(rows, points, "k", "at", "x", "y", "h")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan and "collect_list" not in plan
    assert found.filter("abs(h - least(2 * at, 39998)) > 1e-9").count() == 0 and found.count() == 20_000


def test_lines_round_as_sql(spark, tmp_path):
    """Heights whose seventh decimal is a 5 and the last."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(0, 1, 0.0), (1, 1, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(3000).selectExpr("id AS c_custkey", "1 AS c_nationkey", "(id * 331 + 0.5D) / 1000000 AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("supplier", "customer"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duckdb.sql(entry.oracle_sql()["breakpoint_line"]).fetchall()
    assert sorted(map(tuple, entry.queries()["breakpoint_line"](spark, str(tmp_path)).collect())) == sorted(want)
