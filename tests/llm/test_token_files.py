"""Token files against the tokenizers library, read back as wholes and in part."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.llm import queries, token_files, workspace
from plumbline.llm.queries import tokenizer_path

from .test_bpe import TEXTS


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(rows, library):
    """doc_id, start, n_tokens and crc32, by plain Python."""
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_stretches_as_the_library(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = token_files.Library(f.read())
    rng = random.Random(3)
    texts = [*TEXTS, None, "don't. 'S it's,we'll", "Été.É,x É.", "ä.ö:Ü ä. Å, x.́y", "foo<|endoftext|>bar.<|startoftext|>", "a.<|endoftext|>", "ſ ŉ ª º µ"]
    texts += ["".join(rng.choice("abcÉéßÆÅÄ'.,:!?st \n\t12  \x1c\x85İσΣ́<|>") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for _ in range(2):  # the second time from memory
        ids, ends = own.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    ids, ends = own.encode(pa.array(texts, pa.string()).slice(2, 3))
    assert ids[ends[0] : ends[1]].tolist() == library.encode(texts[2], add_special_tokens=False).ids
    assert own.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_forgotten(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 2)
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = token_files.Library(f.read())
    for text in ("alpha beta gamma delta", "gamma beta epsilon", "alpha"):
        assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_over_the_smallest_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_token_files(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == expected(sorted((r.doc_id, r.text) for r in docs), library)


@pytest.mark.parametrize("dictionary", [True, False])
def test_odd_rows_and_parts(spark, library, dictionary):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "the end"), (None, None), (7, "x" * 200_000)] + [(5, "same row")] * 40
    docs = spark.createDataFrame([(*r, "c", 9) for r in rows], "doc_id long, text string, ids string, part int")
    path = workspace.new_path(spark, "tokens")
    token_files.write(docs, path, tokenizer_path(), layout=token_files.Layout(dictionary=dictionary))
    got = token_files.with_crc(token_files.read(spark, path)).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == [None, None] + sorted(r[0] for r in rows if r[0] is not None)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    one = lambda r: expected([r], library)[0][2:]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((r[0], *one(r)) for r in rows), key=key)


def test_selective_reads(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('some words ', 20) AS text")
    path = workspace.new_path(spark, "tokens")
    token_files.write(docs, path, tokenizer_path(), layout=token_files.Layout(page_rows=50))
    places = token_files.read(spark, path, ("n_tokens",))
    assert "ids" not in places._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    some = token_files.read(spark, path, first=1000, last=1002)
    assert "GreaterThanOrEqual(doc_id,1000)" in some._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.start, r.n_tokens) for r in some.orderBy("doc_id").collect()] == [(i, i * 41, 41) for i in (1000, 1001, 1002)]
    file = places.inputFiles()[0].removeprefix("file://")
    column = pq.ParquetFile(file).metadata.row_group(0).column(4)
    assert column.path_in_schema == "ids.list.element" and column.has_offset_index and column.has_column_index
    assert any("DICTIONARY" in x for x in column.encodings)


def test_deltas(spark):
    path = workspace.new_path(spark, "tokens")
    docs = spark.range(10).selectExpr("id AS doc_id", "'a b c' AS text")
    token_files.write(docs, path, tokenizer_path(), layout=token_files.Layout(dictionary=False))
    file = token_files.read(spark, path).inputFiles()[0].removeprefix("file://")
    assert "DELTA_BINARY_PACKED" in pq.ParquetFile(file).metadata.row_group(0).column(4).encodings


def test_empty_table(spark):
    path = workspace.new_path(spark, "tokens")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path())
    assert token_files.with_crc(token_files.read(spark, path)).collect() == []


def test_marks_after_letters(library):
    """Words with any marks behind them are asked of the model as words; what they become is as the library says."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = token_files.Library(f.read())
    rng = random.Random(11)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = ["".join(rng.choice([*marks, *marks, *"abstéßÀÿ×÷19  ", "\u0338", "\u0301", "\u0345", "'s", "'ll", "<|endoftext|>"]) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += [a + m + b for m in marks for a in ("a", "É", "a\u0301", "1", "'t") for b in ("", "b", "\u0338", "'s", "1", "|endoftext|>")]
    ids, ends = own.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text

    asked = []

    class Counting:
        def encode_batch_fast(self, odd, **options):
            asked.extend(odd)
            return library.encode_batch_fast(odd, **options)

    own.whole = Counting()
    own.encode(pa.array(["that*** the&&& on%%% und### a$$$ é=x (b)"]))
    assert sorted(asked) == ["###", "$$$", "%%%", "&&&", "(b", ")", "***", "=x"]


def test_words_in_use_stay_known(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 6)
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = token_files.Library(f.read())
    asked, ask = [], own._word
    monkeypatch.setattr(own, "_word", lambda word: asked.append(word) or ask(word))
    for k in range(12):
        own.encode(pa.array([f"alpha {'bcdefghijklm'[k] * 3} {'bcdefghijklm'[k] * 4}"]))
    assert asked.count("alpha") == 1 and len(asked) == 25
    assert len(own.known) + len(own.older) <= 8
