"""The pipeline's stages, one after the other, against brute-force versions on a small table."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from plumbline.llm import decontaminate, toxicity
from plumbline.llm.queries import tokenizer_path

from .test_minhash import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with cases of our own."""
    src, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("sf")
    docs, bench = spark.read.parquet(f"{src}/documents.parquet"), spark.read.parquet(f"{src}/benchmark.parquet")
    base = docs.filter("n_chars BETWEEN 400 AND 2000").orderBy("doc_id").first()
    item = bench.filter("length(text) > 120").orderBy("item_id").first().text
    words = base.text.split()
    mine = [
        (9000, base.text), (9001, base.text.replace(" ", "  ") + "!"), (9002, " ".join(words[:40] + ["zzz"] + words[40:])), (9003, None), (9004, ""), (9004, ""),
        (9005, "before it " + item + " after it"), (9006, "mail a.b@c.example.com or +1 (555) 555-0101 now please"), (None, "no id at all but several words here"),
    ]
    extra = spark.createDataFrame([(d, t, "en", "own", len(t or "")) for d, t in mine], docs.schema)
    docs.unionByName(extra).write.parquet(str(out / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{src}/{name}.parquet").write.parquet(str(out / f"{name}.parquet"))
    return str(out)


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, folder):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    docs = read("documents")
    start = rows(docs)
    score = toxicity.train(docs, read("labels")).scorer()
    clean = P.drop_toxic(spark, docs, folder).cache()
    assert clean.columns == docs.columns
    assert sorted(rows(clean), key=str) == sorted([(d, t) for d, t in start if score(t) < toxicity.CUT], key=str)

    classes = brute([(d, t) for d, t in dict(rows(clean)).items() if d is not None])
    single = P.drop_near_copies(spark, clean, folder).cache()
    want = {d for d, c in classes.items() if d == c} | {None}
    assert single.columns == docs.columns and sorted(map(str, (d for d, _ in rows(single)))) == sorted(map(str, want))
    assert not {9000, 9001, 9002} & want

    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in read("benchmark").collect()]
    number = {}
    ids = lambda ws: [number.setdefault(w, len(number)) for w in ws]
    grams = [{tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items]

    def share(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return max([sum(x[2] for x in decontaminate.tile(ids(i), ids(w))) / len(i) for i, g in zip(items, grams) if g & mine], default=0)

    free = P.drop_contaminated(spark, single, folder).cache()
    assert free.columns == docs.columns
    assert sorted(rows(free), key=str) == sorted([(d, t) for d, t in rows(single) if share(t) < decontaminate.SHARE], key=str)
    assert 9005 not in dict(rows(free)) and 9006 in dict(rows(free))

    hidden = P.replace_personal(spark, free, folder).cache()
    assert hidden.columns == docs.columns and hidden.count() == free.count()
    text = dict(rows(hidden))[9006]
    assert "a.b@c" not in text and "555-0101" not in text and text.endswith(" now please")
    assert hidden.filter(F.col("n_chars") != F.length("text")).count() == 0

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    n = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in rows(hidden)}
    assert {r.doc_id: r.n_tokens for r in P.encode_and_decode(spark, hidden, folder).collect()} == n
    assert P.run(spark, folder).count() == hidden.count()


def test_empty_and_clashing(spark, folder, tmp_path):
    """Empty tables, and columns with the names that the stages use themselves."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = str(tmp_path)
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert P.run(spark, none).collect() == []
    clash = docs.limit(20).select("*", *(F.lit(7).alias(c) for c in ("score", "coverage", "id", "class_id", "kept", "ids", "pii")))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, clash, folder)
        assert out.columns == clash.columns, name
        assert all(r.score == r.coverage == r.id == r.kept == 7 for r in out.collect()), name
    assert P.STAGES[-1][1](spark, clash, folder).count() == 20


def test_copies_under_a_repeated_id(spark):
    """Rows, not ids, are kept or dropped; rows without an id stay, of repeated rows one."""
    a, b = "one two three four five six seven eight nine ten", "quite another text that is nowhere near the first one here"
    given = [(1, a), (2, b), (2, a), (3, a + " "), (4, ""), (4, ""), (4, None), (None, a), (None, a), (5, b)]
    docs = spark.createDataFrame([(d, t, "kept") for d, t in given], "doc_id long, text string, row string")
    out = P.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, a), (2, b), (4, ""), (4, None), (None, a), (None, a)]
    assert sorted(rows(out), key=str) == sorted(want, key=str)
    assert rows(P.drop_near_copies(spark, docs.limit(0), "")) == []
