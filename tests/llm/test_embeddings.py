"""Links against all cosines, recall on random neighbours at the threshold, components against a search."""

import numpy as np
import pytest

from plumbline.llm import embeddings as E
from plumbline.llm import graph


def brute(rows, least=0.9):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v / np.sqrt((v**2).sum()) for _, v in good])
    near = (x @ x.T >= least) if len(good) else np.zeros((0, 0), bool)
    comp = list(range(len(good)))
    for i in range(len(good)):
        stack, seen = [i], {i}
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = min(good[j][0] for j in seen)
    return sorted((k, int(near[i].sum()) - 1, comp[i], comp[i] == k) for i, (k, _) in enumerate(good))


def collect(df):
    return [tuple(r) for r in E.near_duplicates(df).collect()]


def test_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, (centre + rng.standard_normal(16) * rng.choice([0.05, 0.3, 0.5])).astype("f4").tolist()) for k in range(25)]
    rows += [(1000 + k, rows[3][1]) for k in range(40)] + [(1100, [2 * x for x in rows[3][1]]), (rows[0][0], rows[0][1])]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] * 16), (None, rows[3][1])]
    df = spark.createDataFrame([(k, v, 1, 2.0) for k, v in rows + bad], "vec_id long, embedding array<float>, label int, id double")
    want = brute(rows) + [(k, 0, k, True) for k, _ in bad if k] + [(None, 0, None, False)]
    for piece in (1024, 7):
        monkeypatch.setattr(E, "PIECE", piece)
        assert sorted(collect(df), key=str) == sorted(want, key=str)
    assert collect(df.limit(0)) == []


def test_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((1500, 64))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9005 * x + np.sqrt(1 - 0.9005**2) * side
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {tuple(r) for r in E.pairs(df).collect()}
    assert len({(k, k + 1500) for k in range(1500)} & got) >= 1495


@pytest.mark.parametrize("vectors", [50_000, 1_000_000, 100_000_000])
def test_recall_at_any_size(vectors):
    """The share of pairs at the threshold that have a filter in common does not fall as the codes grow with the table."""
    rng = np.random.default_rng(6)
    n = 600
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((n, 64))
    side -= (side * x).sum(1, keepdims=True) * x
    y = 0.9005 * x + np.sqrt(1 - 0.9005**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    codes = E.Codes.made(64, vectors)
    both = [bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(codes.decode(x), codes.decode(y))]
    assert np.mean(both) >= 0.985


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(collect(df)) == brute(rows)


@pytest.mark.parametrize("n", [2, 40])
def test_components(spark, n):
    chain = [(k + 1, k) for k in range(n)] + [(100, 101), (7, 7), (None, 3), (100, 101)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}
