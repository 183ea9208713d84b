"""Tiling against a plain search for the longest common runs, and matches against tiling every pair."""

import random
import re

from plumbline.llm import decontaminate as D


def brute(a, b, least):
    used_a, used_b, tiles = [0] * len(a), [0] * len(b), []
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and not used_a[p + n] and not used_b[q + n]:
                    n += 1
                if n > best[2]:
                    best = (p, q, n)
        if best[2] < least:
            return tiles
        p, q, n = best
        used_a[p : p + n] = used_b[q : q + n] = [1] * n
        tiles.append(best)


def test_tiles():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            b = b[:5] + a[10:] + b[5:9] + a[:10]
        assert D.tile(a, b, 3) == brute(a, b, 3), (a, b)


def test_tiles_of_repeated_tokens():
    assert D.tile([1] * 200, [1] * 8000, 5) == [(0, 0, 200)]
    assert D.tile([1] * 300 + [2] + [1] * 300, [1] * 8000, 5) == [(0, 0, 300), (301, 300, 300)]
    assert D.tile([1, 2] * 2000, [1, 2] * 1000 + [3] + [1, 2] * 1000, 5) == [(0, 0, 2000), (2000, 2001, 2000)]


WORDS = [f"w{i}" for i in range(500)]


def test_matches(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(3, 40)))) for i in range(30)] + [(30, None), (None, "a b c d e f"), (31, "a b"), (32, WORDS[3] + "!"), (33, "?")]
    docs = []
    for d in range(120):
        words = rng.choices(WORDS, k=rng.randint(0, 80))
        if d % 2:
            parts = items[d % 30][1].split()
            half = len(parts) // 2
            words[5:5] = parts if d % 4 == 1 else parts[half:] + ["x"] + parts[:half] if d % 8 == 3 else parts[:half]
        docs.append((d, ("! " if d % 3 else " ").join(words).upper(), 1))
    docs += [(None, None, 1), (200, "", 1), (1, docs[1][1], 1), (300, "z " * 30_000 + docs[1][1] + " z" * 9, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    number = {}
    split = lambda t: [number.setdefault(w, len(number)) for w in re.findall(r"[a-z0-9]+", (t or "").lower())]
    want = []
    for d, t, _ in docs:
        for i, u in items:
            if i is not None and u and (tiles := D.tile(split(u), split(t)[-200:], min(5, len(split(u))))):
                want.append((d, i, sum(x[2] for x in tiles), len(split(u)), len(tiles)))
    assert any(x[3] < 5 for x in want)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for size in (D.BLOCK_BYTES, 1500):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = D.matches(df, bench, ["doc_id", "item_id"]).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    shares = {(r.doc_id, r.text): r.coverage for r in D.coverage(df, bench).collect()}
    assert shares == {(d, t): max([x[2] / x[3] for x in want if x[0] == d], default=0) for d, t, _ in docs}
    assert len([x for x in want if x[2] / x[3] >= 0.5]) == D.contaminated(df, bench, ["doc_id"]).count()
    assert D.contaminated(df.limit(0), bench, ["doc_id"]).count() == 0
    assert D.coverage(df, bench.limit(0)).filter("coverage > 0").count() == 0
