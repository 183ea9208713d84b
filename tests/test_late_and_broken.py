"""Late rows, facts known in time, broken files and altered artifacts."""

import glob
import json
import os

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.sources import artifacts, files
from plumbline.streaming import flows, late


def batches(spark, folder, parts, schema):
    folder.mkdir()
    for k, part in enumerate(parts):
        file = folder / f"{k}.json"
        file.write_text("\n".join(json.dumps(r) for r in part))
        os.utime(file, (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_late_rows_have_their_own_table(spark, tmp_path):
    at = lambda m: f"2024-01-01T00:{m:02d}:00"
    parts = [
        [{"id": 1, "k": "a", "at": at(0)}, {"id": 2, "k": "b", "at": at(30)}],
        [{"id": 3, "k": "a", "at": at(5)}, {"id": 4, "k": "a", "at": at(25)}, {"id": 5, "k": "c", "at": None}],
        [{"id": 6, "k": "a", "at": at(2)}, {"id": 7, "k": "b", "at": at(59)}],
        [{"id": 8, "k": "c", "at": at(31)}, {"id": 9, "k": "b", "at": at(58)}],
    ]
    stream = batches(spark, tmp_path / "in", parts, "id long, k string, at timestamp")
    marked = late.with_late_rows(stream, "k", "at", "10 minutes")
    sink = late.side_outputs(str(tmp_path / "good"), str(tmp_path / "late"))
    marked.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    good = {r.id for r in spark.read.parquet(str(tmp_path / "good")).collect()}
    behind = {r.id: r.late_so_far for r in spark.read.parquet(str(tmp_path / "late")).collect()}
    assert behind == {3: 1, 6: 2, 8: 1}  # the marks of the batches are 0:20, 0:20 and 0:49
    assert good == set(range(1, 10)) - set(behind)


def test_facts_known_later_never_join(spark, tmp_path):
    at = lambda h, m=0: f"2024-01-01T{h:02d}:{m:02d}:00"
    decisions = [[{"d": 1, "k": "a", "decided": at(1)}], [{"d": 2, "k": "a", "decided": at(2)}, {"d": 3, "k": "b", "decided": at(2)}], [{"d": 4, "k": "a", "decided": at(9)}], [{"d": 5, "k": "z", "decided": at(20)}]]
    facts = [[{"f": 1, "k": "a", "known": at(0, 30)}], [{"f": 2, "k": "a", "known": at(1, 30)}, {"f": 3, "k": "b", "known": at(2, 1)}, {"f": 4, "k": "a", "known": at(2)}], [{"f": 5, "k": "a", "known": at(8, 59)}], [{"f": 6, "k": "z", "known": at(20, 1)}]]
    d = batches(spark, tmp_path / "d", decisions, "d long, k string, decided timestamp")
    f = batches(spark, tmp_path / "f", facts, "f long, k string, known timestamp")
    joined = late.known_by(d, f, "k", "decided", "known", "1 HOUR", "0 seconds")
    q = joined.writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.d, r.f) for r in spark.table("gate").collect()} == {(1, 1), (2, 2), (2, 4), (4, 5)}
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) > held[-1] and held[-1] <= 3  # what no row can reach any more is gone


def test_settled_obligations_hold_no_state(spark, tmp_path):
    row = lambda k, kind, q, m: {"k": k, "kind": kind, "q": q, "at": f"2024-01-01T00:{m:02d}:00"}
    stream = batches(spark, tmp_path / "in", [[row("a", "due", 1.0, 0), row("b", "due", 2.0, 0)], [row("a", "fill", 1.0, 1)], [row("b", "fill", 1.0, 2)]], "k string, kind string, q double, at timestamp")
    out = flows.obligations(stream, "k", "kind", "q", "at", "1 hour", 600)
    q = out.writeStream.format("memory").queryName("settled").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal == 1


SCHEMA = StructType([StructField("n", LongType()), StructField("s", StringType())])


def test_broken_documents(spark, tmp_path):
    for name, body in {"a.json": '{"n": 1, "s": "x"}', "b.json": '{"n": 2,', "c.json": '{"n": 3}', "d.json": '{"n": "three"}'}.items():
        (tmp_path / name).write_text(body)
    rows, rejects = files.quarantined(spark, str(tmp_path), SCHEMA)
    assert sorted((r.file, r.n) for r in rows.collect()) == [("a.json", 1), ("c.json", 3)]
    assert sorted((r.file, r.reason, r.raw.strip()) for r in rejects.collect()) == [("b.json", "not_json", '{"n": 2,'), ("d.json", "not_of_schema", '{"n": "three"}')]
    assert files.whole_or_none(spark, str(tmp_path), SCHEMA, ["a.json"]) is None
    assert files.whole_or_none(spark, str(tmp_path), SCHEMA, ["a.json", "c.json"], "[ac].json").count() == 2
    assert files.whole_or_none(spark, str(tmp_path), SCHEMA, ["a.json", "z.json"], "[ac].json") is None
    paths = {x: str(tmp_path / f"{x}.json") for x in "abz"}
    found = files.tolerant(spark, paths)
    assert found["a"].first().n == 1 and found["b"] is None and found["z"] is None
    assert files.all_or_nothing(spark, paths) is None and files.all_or_nothing(spark, {"a": paths["a"]}) is not None


def test_broken_parquet(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 5).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        os.rename(glob.glob(str(tmp_path / f"w{k}/*.parquet"))[0], tmp_path / f"in{k}.parquet")
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        os.rename(tmp_path / f"in{k}.parquet", folder / f"{k}.parquet")
    os.rename(glob.glob(str(tmp_path / "none/*.parquet"))[0], folder / "empty.parquet")
    whole = (folder / "1.parquet").read_bytes()
    (folder / "1.parquet").write_bytes(whole[: len(whole) // 2])
    (folder / "short.parquet").write_bytes(b"PAR1")
    rows, rejects = files.readable_parquet(spark, str(folder), StructType([StructField("id", LongType())]))
    assert sorted(r.id for r in rows.collect()) == [*range(5), *range(20, 25)]
    assert sorted(map(tuple, rejects.collect())) == [("1.parquet", "no_footer"), ("short.parquet", "too_short")]


def test_artifacts(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).selectExpr("id", "id * 2 AS twice")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    artifacts.write(df, one)
    artifacts.write(df, two)
    manifest = lambda path: [r.value for r in spark.read.text(f"{path}/manifest").collect()]
    assert manifest(one) == manifest(two) and len(manifest(one)) == 4
    assert artifacts.read(spark, one).count() == 100
    part = sorted(glob.glob(f"{one}/parts/part-*.parquet"))
    body = bytearray(open(part[1], "rb").read())
    body[10] ^= 1
    with open(part[1], "wb") as f:
        f.write(body)
    for x in part[1:3]:  # the local file system's own checksums
        os.remove(os.path.join(os.path.dirname(x), f".{os.path.basename(x)}.crc"))
    os.remove(part[2])
    with pytest.raises(artifacts.Altered, match="part 1 altered, part 2 missing"):
        artifacts.read(spark, one)
    artifacts.write(df, one)
    assert artifacts.read(spark, one).count() == 100
