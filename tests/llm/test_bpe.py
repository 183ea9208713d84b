"""The encoder against the tokenizers library, and the round trip through the offset table."""

import random

import pyarrow as pa
import pytest

from plumbline.llm import bpe
from plumbline.llm.queries import tokenizer_path

TEXTS = [
    "", " ", "\n\t", "Hello, World!", "don't we'll 'S 'T I'M", "naïve CAFÉ café", "12345 6.7", "日本語テキスト", "a\x1cb\x1d c", "x\x85y z　w",
    "aaaa aaaaaaaaaaaa", "ΣΑΣ ς", "İstanbul ǅ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "🙂🙂 🙃", "́x", "ß ẞ ﬁ", "a" * 5000, "the" * 3000, "﻿x​x",
    "... --- !!!???", "</w>", "ĠĠ", "\x00\x01",
]


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        tables = bpe.Tables(f.read())
    return bpe.Encoder(tables), bpe.Decoder(tables.names), Tokenizer.from_file(tokenizer_path())


def test_same_as_library(pair):
    encoder, decoder, library = pair
    rng = random.Random(1)
    texts = list(TEXTS)
    names = [x.replace("</w>", "") for x in decoder.names.to_pylist()[:4000]]
    for _ in range(3000):
        texts.append("".join(rng.choice("abcdeinorst'eé ß1.!") for _ in range(rng.randint(1, 40))))
        texts.append("".join(rng.choice("ab") for _ in range(rng.randint(1, 30))))
        texts.append("".join(rng.choices(names, k=rng.randint(1, 4)))[:60])
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text)
        assert got == want, text
        assert decoder.decode(got) == library.decode(want, skip_special_tokens=False), text


def test_batches_are_as_single_texts(pair):
    encoder, decoder, library = pair
    texts = [*TEXTS, None, "the <|endoftext|> end", *("word%d Wörter, the the" % (k % 7) for k in range(50))]
    got = encoder.encode_all(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got.to_pylist() == want
    assert decoder.decode_all(got).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]
    assert encoder.encode_all(pa.array([], pa.string())).to_pylist() == []
    assert decoder.decode_all(pa.array([None, [], [5]], pa.list_(pa.int32()))).to_pylist() == ["", "", library.decode([5])]
    assert encoder.encode_all(pa.array(texts, pa.string()).slice(3, 5)).to_pylist() == want[3:8]


def test_forgotten_pieces(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHARS", 10)
    words = ["alpha", "beta", "gamma", "delta"] * 3
    want = pair[2].encode(" ".join(words), add_special_tokens=False).ids
    assert pair[0].encode_all(pa.array([" ".join(words)])).to_pylist() == [want]


def test_query_is_as_the_library(spark):
    """All columns of the query over the whole smallest table."""
    import hashlib

    from tokenizers import Tokenizer

    from plumbline.llm import queries

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    library = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        want[doc_id] = len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))
    assert got == want


def test_frames(spark, pair):
    from pyspark.sql import functions as F

    shared = bpe.load(spark, tokenizer_path())
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the end"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, shared), shared).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.text): r.ids for r in out} == {(d, t): pair[0].encode(t) for d, t in rows}
    assert all(r.decoded == pair[1].decode(r.ids) for r in out)
    assert bpe.encode(df.limit(0), shared).collect() == []
