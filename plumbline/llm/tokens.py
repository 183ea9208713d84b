"""Tokens of a batch of texts as numbers, for the operators that count or compare runs of words inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What is not a letter or digit of any script parts words.
NOT_WORD = r"[^\p{L}\p{N}]+"
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(batch: pa.RecordBatch, weights: np.ndarray, most: int, rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of rows rows at most, of which each weighs no more than most or is one row."""
    upto = np.concatenate([[0], weights.cumsum()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Returns freed memory to the system. A Python worker outlives its tasks and would keep what the largest of them
    took, while other workers of the executor need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Pieces of some most bytes of text: what tokens and shingles take, about 100 bytes for each of text, is bounded but
    for a single text that is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        yield from slices(batch, sizes, most, rows)
        give_back()


@dataclass
class Tokens:
    """offsets: where each text's tokens begin and, at last, end; words: a number for each token; distinct: the hash of
    each numbered word."""

    offsets: np.ndarray
    words: np.ndarray
    distinct: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return self.distinct[self.words]

    def hashes_of(self, text: int) -> list[int]:
        return self.distinct[self.words[self.offsets[text] : self.offsets[text + 1]]].tolist()

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def hashed(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), U64, len(words))


def tokenise(texts: pa.Array, separators: str | None = None, lower: bool = True) -> Tokens:
    """Words between ASCII white space, or between matches of separators. lower: in lower case. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if separators:
        texts = pc.replace_substring_regex(texts, separators, " ")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    held = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # at the ends of texts
    kept = np.concatenate([[0], np.cumsum(held)])
    coded = pc.dictionary_encode(flat.filter(pa.array(held)))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return Tokens(kept[ends], coded.indices.to_numpy().astype(np.int64), hashed(coded.dictionary))


def runs(tokens: Tokens, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of k tokens and the text that it is in. Texts of fewer tokens have none or, with short, one
    of all their tokens if there are any."""
    h = mix(tokens.hashes)
    text, n = tokens.text_of(), len(h)
    left = tokens.offsets[1:][text] - np.arange(n)  # tokens from here to the end of the text
    total, weight = np.zeros(n, U64), 1
    for j in range(min(k, n)):  # no text is longer than all of them
        moved = np.zeros(n, U64)
        moved[: n - j] = h[j:]
        total += np.where(left > j, moved * U64(weight % 2**64), U64(0))
        weight = weight * 0x9E3779B97F4A7C15 % 2**64
    keep = left >= k
    if short:
        sizes = np.diff(tokens.offsets)
        keep |= (left == sizes[text]) & (sizes[text] < k)
    return mix(total[keep]), text[keep]
