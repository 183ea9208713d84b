"""Cases that all operators meet: short slices, clashing column names, folders of a cluster."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, embeddings, licenses, lm, minhash, pii, prefix_trie, resample, secrets, token_files, toxicity, warc, workspace
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.tokens import NOT_WORD, runs, tokenise

#: Names that the operators use inside, as columns of the input.
CLASHES = (
    "id", "key", "_key", "kinds", "_kinds", "pairs", "_pairs", "text_key", "trigram", "found", "kind", "clause", "count", "class_id", "component", "n", "high", "low", "bands",
    "registers", "ids", "decoded", "coverage", "item_id", "covered", "tiles", "score", "weight", "rank", "eligible", "part", "before", "n_tokens", "start", "i", "d", "k1", "total",
    "_part", "_place", "number", "_n", "_first", "payload", "offset", "url_", "sequence", "licenses", "pii", "held_out", "vector", "good",
)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_runs_of_slices_with_few_tokens(k):
    for n in range(8):
        for cut in range(n + 1):
            texts = [" ".join(f"w{j}" for j in range(cut)), None, " ".join(f"w{j}" for j in range(cut, n))]
            tokens = tokenise(pa.array(texts, pa.string()), NOT_WORD)
            h, text = runs(tokens, k)
            sizes = [cut, 0, n - cut]
            assert text.tolist() == [t for t, size in enumerate(sizes) for _ in range(size - k + 1)]
            short, of = runs(tokens, k, short=True)
            assert of.tolist() == [t for t, size in enumerate(sizes) for _ in range(size - k + 1 if size >= k else min(size, 1))]
            again = runs(tokenise(pa.array([texts[2], "more words to come after it"]), NOT_WORD), k)
            assert np.array_equal(h[text == 2], again[0][again[1] == 0])


@pytest.mark.parametrize("text", ["a b", "a b c", "one", "x" * 3_000_000 + " y z", ""])
def test_one_short_text(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect()] == [(1, 1, True)]
    items = spark.createDataFrame([(7, "a b"), (8, "a b c d e f")], "item_id long, text string")
    found = decontaminate.contaminated(docs, items, ["doc_id"]).collect()
    assert [r.item_id for r in found] == ([7] if text.startswith("a b") else [])
    assert decontaminate.coverage(docs, items).first().coverage == (1.0 if text.startswith("a b") else 0.0)


def test_last_slice_of_one_short_text(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('this is the text number ', id, ' of many that are not alike ', id * 7) AS text")
    docs = docs.unionByName(spark.createDataFrame([(500, "hello world")], "doc_id long, text string")).coalesce(1)
    assert minhash.near_duplicates(docs).filter("kept").count() == 501


def with_clashes(df):
    return df.withColumns({c: F.lit(f"kept {c}") for c in CLASHES if c not in df.columns})


def test_extra_columns_with_names_of_ours(spark):
    texts = ["password=abcdefgh12 and mail a.b@c.example.com", "", None, "one two three four five six seven", "Permission is hereby granted"]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = with_clashes(plain)
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    shared = bpe.load(spark, tokenizer_path())

    def kept_all(out, replaced=()):
        got = out.collect()
        assert len(got) == len(texts)
        for c in CLASHES:
            if c not in replaced:
                assert all(r[c] == f"kept {c}" for r in got), c
        return got

    hits = kept_all(secrets.scan(docs), ["found"])
    assert sum(len(r.found) for r in hits) == 1
    changed = kept_all(pii.pseudonymise(docs, "s"), ["pii"])
    assert sum(sum(r.pii.values()) for r in changed) == 1
    kept_all(pii.pseudonymise(docs, "s", counts=None))
    kept_all(licenses.scan(docs), ["sequence", "licenses"])
    kept_all(decontaminate.coverage(docs, bench), ["coverage"])
    kept_all(bpe.round_trip(docs, shared), ["ids", "decoded"])
    kept_all(toxicity.score(docs, toxicity.train(docs, labels)), ["score"])

    same = lambda f: sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
    assert same(minhash.near_duplicates)
    assert same(lambda d: decontaminate.contaminated(d, bench, ["doc_id"]))
    assert same(lm.score)
    assert same(lambda d: resample.resample(d, bench))

    def files(d):
        path = workspace.new_path(spark, "tokens")
        token_files.write(d, path, tokenizer_path())
        return token_files.read(spark, path)

    assert same(files)
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(str, embeddings.near_duplicates(with_clashes(vectors)).collect())) == sorted(map(str, embeddings.near_duplicates(vectors).collect()))
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert sorted(map(str, prefix_trie.prefix_nodes(with_clashes(talk)).collect())) == sorted(map(str, prefix_trie.prefix_nodes(talk).collect()))
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>" * 50), (2, None, "<p>" * 50), (3, "x", None)], "page_id long, url string, html string")
    assert sorted(map(str, warc.round_trip(with_clashes(pages)).collect())) == sorted(map(str, warc.round_trip(pages).collect()))


def test_a_cluster_must_name_a_shared_folder(spark):
    class Context:
        master, applicationId = "yarn", "x"

    class Session:
        conf, sparkContext = spark.conf, Context

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            workspace.shared_dir(Session)
