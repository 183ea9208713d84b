"""Classes against all pairs, the similarity against its definition, signatures against the similarity."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from plumbline.llm import minhash as M


def weights(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    return {k: 1 + np.log(n) for k, n in Counter(runs).items()}


def similarity(x, y):
    keys = {*x, *y}
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in x.keys() & y.keys())


def made(rng, n):
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=25)
    docs = []
    while len(docs) < n:
        base = rng.choices(words, k=rng.randint(6, 90))
        if rng.random() < 0.4:
            base = passage + base[:40]
        for _ in range(rng.choice([1, 1, 1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    return docs[:n]


def brute(rows):
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ws = [(d, w) for d, t in rows if (w := weights(t))]
    sets = [set(w) for _, w in ws]
    for i in range(len(ws)):
        for j in range(i):
            n, m = len(sets[i]), len(sets[j])
            if len(sets[i] & sets[j]) > 0.5 * min(n, m) and similarity(ws[i][1], ws[j][1]) >= 0.8 - 1e-9:
                a, b = root(ws[i][0]), root(ws[j][0])
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in parent}


def test_similarity_and_signatures():
    rng = random.Random(1)
    docs = made(rng, 60) + ["a b a b a b a b a b a b c", "a b a b a b a b c", "x", "", "x y"]
    text, h, w, _ = M.shingles(pa.array(docs))
    first = M.signatures(text, h, w, len(docs), 2000)
    cut = lambda k: (h[text == k], w[text == k])
    for i, j in [(k, k + 1) for k in range(60)] + [(60, 61), (60, 60)]:
        want = similarity(weights(docs[i]), weights(docs[j]))
        assert abs(M.probability_jaccard(*cut(i), *cut(j)) - want) < 1e-9
        if want:
            assert abs((first[i] == first[j]).mean() - want) < 0.05
    assert (first[63] == 0).all() and len(set(first[62].tolist())) == 1


def test_classes(spark, monkeypatch):
    rng = random.Random(2)
    texts = made(rng, 350)
    rows = list(enumerate(texts)) + [(600 + k, texts[7].upper() + "!") for k in range(50)]
    rows += [(700, ""), (701, None), (702, " ."), (703, "one two"), (704, "One two?"), (705, "word " * 30_000), (7, texts[7])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows] + [(None, texts[7], 1)], "doc_id long, text string, id int")
    want = brute(dict(rows).items())
    for few in (8, 3):
        monkeypatch.setattr(M, "FEW", few)
        out = M.near_duplicates(df).collect()
        assert len(out) == len(rows) + 1
        assert {r.doc_id: r.class_id for r in out} == want | {None: None}
        assert all(r.kept == (r.doc_id == r.class_id and r.doc_id is not None) for r in out)
    assert M.near_duplicates(df.limit(0)).collect() == []


def test_crowded_bucket(spark):
    """A chain of near copies, each like its neighbours only, in one bucket and in no other together."""
    rng = random.Random(3)
    words, texts = [f"v{k}" for k in range(200)], []
    for _ in range(40):
        texts.append(" ".join(words))
        words = words[18:] + [f"v{rng.randrange(10**9)}" for _ in range(18)]
    order = rng.sample(range(40), 40)
    rows = [(order[k], t) for k, t in enumerate(texts)]
    assert set(brute(rows).values()) == {0}
    df = spark.createDataFrame(rows, "id long, text string")
    rows = [(k, [5] + [100 * (k + 1) + b for b in range(1, M.BANDS)], bytearray(M.BANDS * M.ROWS)) for k in range(40)]
    classes = spark.createDataFrame(rows, "id long, bands array<long>, registers binary")
    _, components = M.links(classes, df)
    assert {r.node: r.component for r in components.collect()} == dict.fromkeys(range(40), 0)


def test_enough_registers():
    """Pairs at 0.8 that agree on fewer registers than asked for are as rare as stated."""
    k = M.enough(0.8)
    draws = np.random.default_rng(5).binomial(M.BANDS * M.ROWS, 0.8, 2_000_000)
    assert 50 <= k <= 60 and (draws < k).sum() <= 5
    assert M.enough(1.0) == M.BANDS * M.ROWS


def test_one_hub_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 3)
    base = [f"c{k}" for k in range(120)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(40)]
    texts += [" ".join(base[60:] + [f"y{k}{j}" for j in range(60)]) for k in range(5)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rare_pairs(spark, monkeypatch):
    texts = made(random.Random(4), 200)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = spark.createDataFrame([(k, k) for k in range(200)], "id long, component long")
    got = {(r.a, r.b) for r in M.rare_pairs(members, df).collect()}
    ws = [weights(t) for t in texts]
    want = {(i, j) for j in range(200) for i in range(j) if ws[i].keys() & ws[j].keys() and similarity(ws[i], ws[j]) >= 0.8}
    assert want and want <= got and len(got) < 4000
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert {(r.a, r.b) for r in M.rare_pairs(members, df).collect()} == got


def test_rare_pairs_of_a_cluster(spark):
    """Copies of one text with edits: all pairs at 0.8 or more are there, most of those clearly below are not; also where
    shingles come twice."""
    rng = random.Random(7)
    base, texts = [f"b{k}" for k in range(150)], []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 9])):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(copy + (copy[:12] if k % 10 == 0 else [])))
    ws = [weights(t) for t in texts]
    members = spark.createDataFrame([(k, k) for k in range(60)], "id long, component long")
    got = {(r.a, r.b) for r in M.rare_pairs(members, spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    s = {(i, j): similarity(ws[i], ws[j]) for j in range(60) for i in range(j)}
    assert {p for p, x in s.items() if x >= 0.8} <= got and 100 < len([p for p, x in s.items() if x >= 0.8])
    below = [p for p, x in s.items() if x < 0.7 and p[0] % 10 and p[1] % 10]
    assert len(below) > 100 and len([p for p in below if p in got]) < 0.1 * len(below)
