"""Files of every kind read back, and streams against the same rows as a batch."""

import gzip
import json
import os

from pyspark.sql import functions as F

from plumbline.sources import files
from plumbline.streaming import flows


def test_files(spark, tmp_path):
    for name, body in {"b.json": '{"n": 100000.0, "é": 1}', "a.json": '{"n": 2}', "skip.json": "{}", "c.txt": "x"}.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    docs = {r.name: r.raw for r in files.documents(spark, str(tmp_path), skip=("skip.json",)).collect()}
    assert docs == {"a.json": '{"n": 2}', "b.json": '{"n": 100000.0, "é": 1}'}
    assert files.typed(spark, str(tmp_path / "a.json"), "n double").first().n == 2
    found = files.tolerant(spark, {"a": str(tmp_path / "a.json"), "z": str(tmp_path / "z.json")})
    assert found["z"] is None and found["a"].first().n == 2
    assert files.all_or_nothing(spark, {"z": str(tmp_path / "z.json")}) is None
    (tmp_path / "h.head").write_text("Chain head\nseq: 1\nhash: sha256:ab\n\n")
    row = files.colon_pairs(spark, str(tmp_path / "h.head")).first()
    assert row.title == "Chain head" and row.pairs == {"seq": "1", "hash": "sha256:ab"}
    (tmp_path / "i.idx").write_text("k|v\n1|a\n2|\n")
    assert [tuple(r) for r in files.delimited(spark, str(tmp_path / "i.idx"), "k int, v string").collect()] == [(1, "a"), (2, None)]
    with gzip.open(tmp_path / "p.html.gz", "wt") as f:
        f.write("<p>x\ny</p>")
    assert files.pages(spark, str(tmp_path / "p.html.gz")).first().html == "<p>x\ny</p>"
    files.report(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"))
    assert [tuple(r) for r in files.lines(spark, str(tmp_path / "out"), "a int, b string").collect()] == [(1, "x")]
    cached = spark.createDataFrame([("2024-01-01 00:00:30",), ("2023-12-31 23:58:00",)], "at string")
    assert files.fresh(cached, "at", "2024-01-01 00:01:00").count() == 1


def start(spark, tmp_path, rows, schema):
    (tmp_path / "in").mkdir()
    for k, part in enumerate(rows):
        file = tmp_path / "in" / f"{k}.json"
        file.write_text("\n".join(json.dumps(r) for r in part))
        os.utime(file, (1_700_000_000 + 60 * k,) * 2)  # the stream takes files by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))


def finish(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_unique_and_insert(spark, tmp_path):
    rows = [[{"k": "a", "at": "2024-01-01T00:00:00"}, {"k": "a", "at": "2024-01-01T00:00:01"}], [{"k": "b", "at": "2024-01-01T00:00:02"}, {"k": "a", "at": "2024-01-01T00:00:03"}]]
    stream = start(spark, tmp_path, rows, "k string, at timestamp")
    got = finish(flows.unique_rows(stream, ["k"], "at", "1 hour"), "unique_rows", "append", tmp_path)
    assert sorted(r.k for r in got.collect()) == ["a", "b"]
    target = str(tmp_path / "table")
    write = flows.keyed_insert(target, "k")
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    write(batch, 0)
    write(batch, 0)
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 2)]


def test_obligations(spark, tmp_path):
    """Fills before their dues count; a late key is overdue when the watermark has passed its term."""
    at = "2024-01-01T00:%02d:00"
    first = [("a", "fill", 2.0, 1), ("a", "due", 5.0, 0), ("b", "due", 1.0, 0), ("c", "fill", 4.0, 0)]
    then = [("b", "fill", 9.0, 30), ("c", "due", 4.0, 31), ("d", "due", 1.0, 59), ("a", "fill", None, 59)]
    rows = [[{"k": k, "kind": kind, "q": q, "at": at % m} for k, kind, q, m in part] for part in (first, then)]
    for order in (rows, [x[::-1] for x in rows]):
        where = tmp_path / str(order is rows)
        where.mkdir()
        stream = start(spark, where, order, "k string, kind string, q double, at timestamp")
        got = finish(flows.obligations(stream, "k", "kind", "q", "at", "0 seconds", 600), "obligations", "update", where).collect()
        last = {}
        for r in got:
            last.setdefault(r.k, []).append((r.open, r.status))
        assert set(last["b"]) <= {(1.0, "open"), (0.0, "settled"), (1.0, "overdue")} and (0.0, "settled") in last["b"]
        assert last["a"][-1][0] == 3.0 and (3.0, "overdue") in last["a"]
        assert last["c"][-1] == (0.0, "settled") and (1.0, "open") in last["d"]


def test_chain_heads(spark, tmp_path):
    rows = [[{"k": "a", "n": 2, "b": "x", "d": "y"}, {"k": "a", "n": 1, "b": None, "d": "x"}, {"k": "b", "n": 1, "b": None, "d": "p"}, {"k": "b", "n": 2, "b": "other", "d": "q"}]]
    got = finish(flows.chain_heads(start(spark, tmp_path, rows, "k string, n long, b string, d string"), "k", "n", "b", "d"), "heads", "update", tmp_path)
    assert sorted(map(tuple, got.collect())) == [("a", 2, "y", 0), ("b", 1, "p", 1)]


def test_latest_for(spark, tmp_path):
    rows = [[{"k": "a", "v": 1, "at": "2024-01-01T00:00:00"}, {"k": "a", "v": 2, "at": "2024-01-01T00:00:05"}], [{"k": "b", "v": 3, "at": "2024-01-01T01:00:00"}]]
    got = finish(flows.latest_for(start(spark, tmp_path, rows, "k string, v long, at timestamp"), "k", "v", "at", "0 seconds", 60), "latest", "update", tmp_path).collect()
    seen = {(r.k, r.v, r.live) for r in got}
    assert ("b", 3, True) in seen and ("a", None, False) in seen and ("a", 2, True) in seen


def test_windows_and_late(spark, tmp_path):
    rows = [[{"k": "a", "at": f"2024-01-01T00:{m:02d}:00", "v": 1.0} for m in (0, 1, 6)], [{"k": "a", "at": "2024-01-01T01:00:00", "v": 1.0}]]
    stream = start(spark, tmp_path, rows, "k string, at timestamp, v double")
    got = finish(flows.windowed(stream, "at", "10 minutes", "5 minutes", ["k"], "v"), "windowed", "append", tmp_path)
    assert sorted((r.start.minute, r.n) for r in got.collect()) == [(0, 2), (5, 1)]
    df = spark.createDataFrame([(1, 2, 1), (2, 2, 3), (3, 2, None)], "id int, ex int, known int")
    on_time, late = flows.split_late(df, "ex", "known")
    assert [r.id for r in on_time.collect()] == [1] and sorted(r.id for r in late.select(F.col("id")).collect()) == [2, 3]
