"""The whole query against a second implementation in plain Python: voters counted by loops, expectation-maximisation
written from its formulas, the regression solved one coefficient at a time."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def votes(text):
    """Every vote of a text: terms that are there, and that are there twice and often enough."""
    text = text or ""
    words = re.findall(r"[^\W\d_]+", text.lower())
    times = defaultdict(int)
    for w in words:
        times[w] += 1
        for n in (4, 5, 6):
            if len(w) >= n:
                times[w[:n] + "*"] += 1
    for name, pattern in (("#!", "[!]"), ("#?", "[?]"), ("#caps", r"\b[A-Z]{3,}\b")):
        if re.search(pattern, text):
            times[name] = len(re.findall(pattern, text))
    out = set(times)
    out |= {f"{t}~1" for t, n in times.items() if n >= 2 and n >= 0.004 * len(words)}
    out |= {f"{t}~2" for t, n in times.items() if n >= 2 and n >= 0.012 * len(words)}
    return out


def row_of(text, names):
    """1 for each voter that votes; the last three look at all words of the lexicon together."""
    there, bases = votes(text), {n.split("~")[0] for n in names}
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    hits = sum(bool({w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)} & bases) for w in words)
    return [float(n in there) for n in names] + [float(hits >= 2 and hits >= s * len(words)) for s in (0.005, 0.01, 0.015)]


def label_posterior(x, of):
    rows, voters = x.shape
    post, power = [min(0.98, max(0.02, sum(r) / 3)) for r in x], np.ones(voters)
    for k in range(40):
        q = np.array(post)
        prior = min(0.99, max(0.01, sum(q * of) / sum(of)))
        good, bad = np.empty(voters), np.empty(voters)
        for j in range(voters):
            good[j] = min(1 - 1e-5, max(1e-5, (sum((1 - q) * of * x[:, j]) + 0.05) / (sum((1 - q) * of) + 1)))
            bad[j] = min(1 - 1e-5, max(1e-5, (sum(q * of * x[:, j]) + 0.5) / (sum(q * of) + 1)))
        if k % 10 == 9:
            left = np.array([x[i] - q[i] * bad - (1 - q[i]) * good for i in range(rows)])
            norm = [math.sqrt(sum(of * left[:, j] ** 2) / sum(of)) + 1e-9 for j in range(voters)]
            for j in range(voters):
                with_j = [(of * left[:, j] * left[:, i]).sum() / sum(of) / norm[i] / norm[j] for i in range(voters)]
                power[j] = 1 / (1 + sum(r for i, r in enumerate(with_j) if i != j and r > 0.3))
        post = []
        for i in range(rows):
            evidence = sum(power * np.where(x[i] > 0, np.log(bad / good), np.log((1 - bad) / (1 - good))))
            z = math.log(prior / (1 - prior)) + evidence
            post.append(1 / (1 + math.exp(-min(40, max(-40, z)))))
    return np.array(post)


def regression(x, target, of):
    """Coefficients and bias, each in turn moved to where its own slope is nil, until none moves."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge, z = np.zeros(x.shape[1]), [1.0] * (x.shape[1] - 1) + [1e-3], np.zeros(len(x))
    for _ in range(20_000):
        moved = 0.0
        for j in range(len(w)):
            p = 1 / (1 + np.exp(-z))
            slope = (of * (p - target) * x[:, j]).sum() + ridge[j] * w[j]
            # the curve of a logistic is at most a quarter, so this step never goes too far
            step = slope / max((of * np.maximum(p * (1 - p), 0.02) * x[:, j]).sum() + ridge[j], 1e-9)
            w[j] -= step
            z -= step * x[:, j]
            moved = max(moved, abs(step))
        if moved < 1e-9:
            break
    p = 1 / (1 + np.exp(-z))
    slopes = x.T @ (of * (p - target)) + np.array(ridge) * w
    assert np.abs(slopes).max() < 1e-6  # the problem is strictly convex: this is its only solution
    return w


def test_against_plain_python(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    texts = dict(zip(docs["doc_id"], docs["text"]))
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    known = {d: t for d, t in zip(labels["doc_id"], labels["toxic"]) if t is not None and d in texts and zlib.crc32(str(d).encode()) % 4 != 2}
    ids = sorted(known)
    assert len(texts) == len(docs["doc_id"]) and 0 < sum(known.values()) < 2000 and len(ids) < 4000  # so all of them are the sample
    n, bad = defaultdict(int), defaultdict(int)
    for d in ids:
        for v in votes(texts[d]):
            n[v] += 1
            bad[v] += known[d]
    n1 = sum(known.values())
    n0 = len(ids) - n1
    p = n1 / (n1 + n0)
    surprise = {v: (bad[v] - p * n[v]) / math.sqrt(n[v] * p * (1 - p)) for v in n}
    pure = {v for v in n if n[v] >= 4 and (bad[v] / n1) / (bad[v] / n1 + (n[v] - bad[v]) / n0) >= 0.9 and surprise[v] >= 5}
    names = sorted(pure, key=lambda v: (-surprise[v], v))[:300]
    x = np.array([row_of(texts[d], names) for d in ids])
    of = np.ones(len(ids))  # the sample is all that may be learned from, so no class weighs more
    w = regression(x, label_posterior(x, of), of)
    want = {}
    for d, text in texts.items():
        z = w[-1] + sum(a * b for a, b in zip(w[:-1], row_of(text, names)))
        want[d] = 1 / (1 + math.exp(-z))
    got = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(got) == len(want) and len(names) > 5
    assert max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6
    assert all(r.predicted == int(want[r.doc_id] >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
