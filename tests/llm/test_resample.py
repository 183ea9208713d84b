"""Importance resampling against plain Python, the tournament tree against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from plumbline.llm import queries, resample, workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), words + [a + " " + b for a, b in zip(words, words[1:])]


def brute(docs, target, per_cent=25, least=20, seed=7, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_features(text)[1]))
    for text in target:
        t.update(map(bucket, plain_features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows, can = [], []
    for doc_id, text in docs:
        words, found = plain_features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        row = [doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        rows.append(row)
        if words >= least:
            can.append(row)
    can.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(can[: per_cent * len(can) // 100]):
        row[4] = k + 1
    return sorted((tuple(r) for r in rows), key=str)


ODD = ["", None, "a", "A-b c", "Ünï cödé ÄB", "x" * 70_000 + " y", "\x00\x7f", "a  b\tc", "日本 語", "1 2 3", "[]", "é"]


def test_features():
    for texts in (ODD, ODD[::-1], ["", ""], [], ["tail"], ["a", "b"]):
        words, bucket, text = resample.features(pa.array(texts, pa.string()))
        for k, x in enumerate(texts):
            n, want = plain_features(x)
            assert words[k] == n
            assert sorted(bucket[text == k].tolist()) == sorted(zlib.crc32(f.encode()) for f in want), x
    words, bucket, text = resample.features(pa.array(ODD, pa.string()).slice(3, 2))
    assert sorted(bucket[text == 1].tolist()) == sorted(zlib.crc32(f.encode()) for f in plain_features(ODD[4])[1])


def test_slices_of_a_batch():
    texts = [f"Text {k} of " + "words " * k for k in range(300)] + ODD
    whole = pa.array(texts, pa.string())
    for at in range(0, len(texts), 37):
        words, _, _ = resample.features(whole.slice(at, 37))
        assert words.tolist() == [plain_features(x)[0] for x in texts[at : at + 37]]


def test_tournament():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randint(0, 30), rng.randint(0, 3)) for _ in range(rng.choice([0, 1, 7, 40]))) for _ in range(k)]
        got = [x for run, a, b in resample.Tournament(runs).slices() for x in runs[run][a:b]]
        assert got == sorted(x for r in runs for x in r)


def test_query_over_the_smallest_table(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").collect()]
    got = sorted(map(tuple, queries.op12_importance_draw(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(docs, [r.text for r in read("benchmark").collect()])


@pytest.mark.parametrize("run_rows,range_rows", [(7, 5), (1000, 50), (1 << 18, 1 << 18)])
def test_runs_ranges_and_ties(spark, monkeypatch, run_rows, range_rows):
    """Small runs and ranges; a third of all rows one row, a third one text, null ids."""
    monkeypatch.setattr(resample, "RUN_ROWS", run_rows)
    monkeypatch.setattr(resample, "RANGE_ROWS", range_rows)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "ö", "7"]) + str(rng.randint(0, 9)) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(120)] + [(500, "Same words " * 20)] * 60 + [(1000 + i, "same text " * 12) for i in range(60)]
    docs += [(None, "same text " * 12)] * 30 + [(3, x) for x in ODD]
    target = [text(30) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, eligible string").repartition(5)
    for per_cent in (25, 60, 100):
        got = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), per_cent)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, per_cent)


def test_split_of_a_crowded_score(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 10)
    rows = spark.range(0, 400, 1, 4).selectExpr("CASE WHEN id < 200 THEN 9 WHEN id < 260 THEN NULL ELSE id END AS doc_id", "5L AS n_features", "1L AS weight", "77L AS score", "true AS eligible")
    rows = workspace.stage(rows, "scores")
    bounds = resample._bounds([(77, 400)], rows)
    runs = rows.mapInArrow(resample._cut_runs(spark.sparkContext.broadcast(bounds)), "range long, run long, n long, cells binary")
    sizes = [r["sum(n)"] for r in runs.groupBy("range").sum("n").collect()]
    assert sum(sizes) == 400 and max(sizes) <= 40
    ranked = resample.draw(rows, 100).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 401))
    assert [r.doc_id for r in ranked] == [9] * 200 + list(range(260, 400)) + [None] * 60


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none.select("text")).collect() == []
    some = spark.createDataFrame([(1, "a b " * 10), (2, None)], "doc_id long, text string")
    assert [r.rank for r in resample.resample(some, none.select("text")).collect()] == [None, None]
