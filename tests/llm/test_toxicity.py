"""Held-out accuracy on the driver's labels, the label model on votes of known origin, and edge cases."""

import numpy as np

from plumbline.llm import toxicity as T
from plumbline.llm.queries import QUERIES


def test_label_model():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.15
    rates = [(0.001, 0.5), (0.002, 0.4), (0.001, 0.3), (0.01, 0.3), (0.002, 0.6)]
    votes = np.stack([rng.random(4000) < np.where(y, b, a) for a, b in rates], 1).astype(float)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]])  # copies of a voter
    model = T.LabelModel.fit(votes)
    assert np.allclose(model.hit[1][:5], [b for _, b in rates], atol=0.1)
    assert model.weight[0] < 0.5 and model.weight[1] > 0.9
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, sf_dir).collect()
    test = [(r.predicted, labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(p and t for p, t, _ in test)
    assert hits / sum(t for _, t, _ in test) > 0.88 and hits / sum(p for p, _, _ in test) > 0.95  # some labels are noise
    assert all(0 <= s <= 1 for _, _, s in test) and 0.2 < len(test) / sum(r.doc_id in labels for r in rows) < 0.3


def test_edges(spark):
    docs = [(i, f"fine words here {i}" + " vile" * (i % 3 == 0), "l") for i in range(90)]
    docs += [(None, None, "l"), (500, "", "l"), (501, "ok " * 40_000 + "vile", "l"), (3, docs[3][1], "l"), (3, docs[3][1], "l")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 1, 1), (7, 1, None), (3, 1, 1)], "doc_id long, quality int, toxic int"
    )
    model = T.train(df, labels)
    out = T.score(df, model).collect()
    assert len(out) == len(docs)
    assert all((r.score >= T.CUT) == ("vile" in (r.text or "")) for r in out)
    assert all(abs(model.scorer()(r.text) - r.score) < 1e-12 for r in out)
    assert T.score(df.limit(0), model).collect() == []
    flat = T.train(df, labels.limit(0))
    assert {r.score < T.CUT for r in T.score(df, flat).collect()} == {True}
    assert not any(r.doc_id in T_HELD for r in T.sample(df, labels).collect())


import zlib  # noqa: E402

T_HELD = {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_class_weights():
    """Classes count as they do among all learnable rows, and the mean over the sample is one."""
    sampled, known = {0: 2000, 1: 2000}, {0: 97_000, 1: 3000}
    w = T.class_weights(sampled, known)
    assert abs(sum(w[c] * sampled[c] for c in w) - 4000) < 1e-9
    assert abs(w[1] * sampled[1] / 4000 - 0.03) < 1e-12
    assert T.class_weights({0: 30, 1: 10}, {0: 30, 1: 10}) == {0: 1.0, 1: 1.0}
