"""Token ids in Parquet files: one row a document with a list column of ids, for training jobs that read parts of them.

Rows lie in ascending order of the document's id, over all files. Ids are bit-packed numbers of a dictionary page, or
deltas; row groups and pages have set sizes, and the writer adds column and offset indexes, so a reader that asks for a
range of documents skips the pages of others, and one that asks for places and lengths reads no ids at all. A small
index holds for each part how many tokens come before it, so the place of a document is known without a pass over others.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import workspace
from .tokens import slices, text_slices

#: Bytes of text that are split at once, texts of a slice, and stretches that a worker remembers.
SLICE_BYTES, SLICE_TEXTS, REMEMBERED = 4 << 20, 20_000, 300_000
#: Tokens of which digests are made at once.
SLICE_TOKENS = 1_000_000

#: Stretches whose pieces are the same with a space after the letters: the tokenizer parts letters from marks itself.
#: Apostrophes, which may begin a piece with letters, and the marks of special tokens are none of these.
_MARKED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~])"
#: Lower-case letters that no normal form changes: such a stretch is one piece.
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")


@dataclass(frozen=True)
class Layout:
    """How files are written. dictionary: ids as numbers of a dictionary, which suits few distinct ids; else deltas of
    binary-packed numbers. row_group, page: bytes; page_rows: rows of a page at most, so a page index tells few rows
    apart; codec: what pages are packed with."""

    dictionary: bool = True
    row_group: int = 64 << 20
    page: int = 256 << 10
    page_rows: int = 1_000
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.codec,
            "parquet.writer.version": "PARQUET_2_0",  # deltas for numbers without a dictionary
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": str(self.dictionary).lower(),
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.block.size": str(self.row_group),
            "parquet.page.size": str(self.page),
            "parquet.page.row.count.limit": str(self.page_rows),
        }


class Library:
    """The tokenizers library, asked once for each distinct stretch of a slice between ASCII white space, which the
    tokenizer drops: a stretch has the same tokens wherever it stands. Stretches of plain letters are pieces of their own
    and go straight to the library's model; all others go through its whole encoding."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        shown = sorted(pre_tokenizers.ByteLevel.alphabet())  # the letters that stand for bytes: those with a sign first
        plain = [b for b in range(256) if chr(b) in shown]
        rest = iter(sorted(set(shown) - {chr(b) for b in plain}))
        self.letter = {b: chr(b) if b in plain else next(rest) for b in range(256)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # those not met since known was begun anew, forgotten at the next time

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.letter[b] for b in word.encode()])
        return array("i", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch as bytes of 32-bit numbers."""
        if len(self.known) > REMEMBERED // 3:
            self.known, self.older = {}, self.known
        known, lower = self.known, list(map(str.lower, stretches))
        made = list(map(known.get, lower))
        odd = []
        for k, ids in enumerate(made):
            if ids is None:
                low = lower[k]
                ids = known.get(low) or self.older.get(low)  # known: two spellings of a slice
                if ids is None:
                    if not _LETTERS.fullmatch(low):
                        odd.append(k)
                        continue
                    ids = self._word(low)
                made[k] = known[low] = ids
        if odd:
            for k, x in zip(odd, self.whole.encode_batch_fast([stretches[k] for k in odd], add_special_tokens=False)):
                made[k] = array("i", x.ids).tobytes()
        return made

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and, at last, end). A null text is an empty one."""
        texts = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), _MARKED, r"\1 \2")
        chunks = pc.ascii_split_whitespace(texts)
        ends = chunks.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(chunks.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        made = self._stretches(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat = np.frombuffer(b"".join(made), np.int32)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], size.cumsum()])), pa.array(flat)).take(coded.indices)
        return lists.values.to_numpy(), lists.offsets.to_numpy()[ends - ends[0]]


_HELD: dict[int, Library] = {}


def _library(definition: Broadcast) -> Library:
    """A worker's own, made once."""
    key = zlib.crc32(definition.value.encode())
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Library(definition.value)
    return _HELD[key]


def _encoded(definition: Broadcast, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        library = _library(definition)
        for batch in text_slices(batches, "text", SLICE_BYTES, SLICE_TEXTS):
            ids, ends = library.encode(batch.column("text"))
            rows = batch.num_rows
            spread = np.full(len(ids) + rows, end, np.int32)  # each text's ids and the end
            own = np.ones(len(spread), bool)
            own[ends[1:] + np.arange(rows)] = False
            spread[own] = ids
            upto = ends + np.arange(rows + 1)
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(spread))
            cols = [batch.column("doc_id"), pa.array(np.full(rows, part, np.int32)), pa.array(before + upto[:-1]), pa.array(np.diff(upto)), lists]
            before += int(upto[-1])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "before", "n_tokens", "ids"])

    return run


SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 1, layout: Layout = Layout()) -> None:
    """Writes the token ids of each row of docs (doc_id, text), the id end after them, under path: tables tokens, in the
    order of doc_id, and index. tokenizer: the file of a tokenizer of the library, on the driver.

    Null ids come first; rows that share an id are in the order of their texts' hashes, and repeated rows all stay. Null
    and empty texts have only the end. Further columns are left out. Texts are dealt out by ranges of (doc_id, hash, row),
    so an id that very many rows have is in several parts.
    """
    spark = docs.sparkSession
    workspace.small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2])
    dealt.mapInArrow(_encoded(definition, end), SCHEMA).write.options(**layout.options()).parquet(f"{path}/tokens")
    held = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    # one row a part: few enough for one task at any size
    held.select("part", "tokens", "docs", F.coalesce(F.sum("tokens").over(_earlier()), F.lit(0)).alias("start")).write.parquet(f"{path}/index")


def _earlier():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("n_tokens", "ids"), first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start (tokens of all documents before it) and columns of what write() put under path, of the documents
    from id first to id last where given. Without ids among columns no ids are read; first and last reach the files'
    statistics and page indexes. The index, a row for each part, is broadcast."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    index = spark.read.parquet(f"{path}/index").select("part", F.col("start").alias("part_start"))
    return rows.join(F.broadcast(index), "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), *columns)


def with_crc(tokens: DataFrame, ids: str = "ids", into: str = "ids_crc32") -> DataFrame:
    """tokens with column into in place of ids: the unsigned crc32 of the ids as little-endian 32-bit numbers."""
    keep = [c for c in tokens.columns if c not in (ids, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n = pc.fill_null(pc.list_value_length(whole.column(ids)), 0).to_numpy().astype(np.int64)
            for batch in slices(whole, n, SLICE_TOKENS):
                lists = pc.fill_null(batch.column(ids), pa.scalar([], batch.column(ids).type))
                flat = lists.flatten().to_numpy().astype("<u4")
                ends = lists.offsets.to_numpy().astype(np.int64)
                ends = ends - ends[0]
                digests = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(digests, pa.int64())], [*keep, into])

    return tokens.mapInArrow(run, tokens.select(*keep).schema.add(into, LongType()))
