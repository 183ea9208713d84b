"""Scores against counts kept in dictionaries, and the mixture against the uniform share."""

import math
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10


def check(rows, got, mixture):
    one, two, ctx = Counter(), Counter(), Counter()
    for d, t in rows:
        if fold(d):
            words = split(t)
            one.update(words)
            for a, b in zip([0, *words], words):
                two[a, b] += 1
                ctx[a] += 1
    n, v = sum(one.values()), len(one)
    want = {}
    for d, t in rows:
        words = split(t)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        score = 0.0
        for a, b in zip([0, *words], words):
            w = mixture.weights[int(math.log2(ctx[a])) + 1 if ctx[a] else 0]
            score += math.log10(w[0] * (two[a, b] / ctx[a] if ctx[a] else 0) + w[1] * one[b] / max(1, n) + w[2] / (v + 1))
        want[d, t] = fold(d) == 0, len(words), sum(one[w] > 0 for w in words), n, base, score
    assert len(got) == len(rows)
    keyed = {}
    for r in got:
        keyed.setdefault(r.doc_id, []).append(r)
    for (d, t), w in want.items():
        assert any(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4]) and r.score == pytest.approx(w[5])
            for r in keyed[d]
        ), (d, w, keyed[d])


@pytest.fixture
def fitted(monkeypatch):
    made = []
    fit = lm.Mixture.fit.__func__

    def kept(cls, *a, **b):
        made.append(fit(cls, *a, **b))
        return made[-1]

    monkeypatch.setattr(lm.Mixture, "fit", classmethod(kept))
    return made


def test_scores(spark, fitted, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 60_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(None, None), (1001, ""), (1002, " \x0b\n "), (1003, "ÄB ab AB\x85x"), (1004, "the " * 60_000), (1005, "a b"), (1005, "a b")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double")
    got = lm.score(df).collect()
    check(docs, got, fitted[0])
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert (abs(fitted[0].weights.sum(1) - 1) < 1e-9).all()


def test_empty(spark, fitted):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df).collect() == []
    only = [(d, "x y") for d in range(300) if fold(d) == 0]
    check(only, lm.score(spark.createDataFrame(only, "doc_id long, text string")).collect(), fitted[-1])
