"""Benchmark decontamination by greedy string tiling.

Seeds, the hashes of every run of least tokens, join documents with benchmark items. For each pair that shares one the
longest common runs that do not overlap earlier ones are marked again and again, found by Karp-Rabin hashes of falling
length, until only runs shorter than least are left. Tiles may lie in any order, so passages whose sentences were
reordered are caught. A document is contaminated if its tiles cover enough of an item's tokens.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from . import workspace
from .tokens import NOT_WORD, Tokens, runs, text_slices, tokenise

#: Tokens of a tile, share of an item's tokens that tiles must cover.
LEAST, SHARE = 5, 0.5
#: Bytes of benchmark text that are broadcast at once; its tokens and seeds take some ten times as much.
BLOCK_BYTES = 4 << 20

_MOD = (1 << 61) - 1
_BASE = 0x1F3A5C79B


def _rolling(seq: list[int], size: int) -> list[int]:
    """The Karp-Rabin hash of each run of size tokens, each from the one before."""
    if len(seq) < size:
        return []
    top, h = pow(_BASE, size - 1, _MOD), 0
    for x in seq[:size]:
        h = (h * _BASE + x) % _MOD
    out = [h]
    for k in range(size, len(seq)):
        h = ((h - seq[k - size] * top) * _BASE + seq[k]) % _MOD
        out.append(h)
    return out


def _free(marked: bytearray) -> Iterator[tuple[int, int]]:
    """The stretches of unmarked tokens."""
    start = None
    for k, m in enumerate([*marked, 1]):
        if m and start is not None:
            yield start, k
            start = None
        elif not m and start is None:
            start = k


def _places(seq: list[int], used: bytearray, size: int) -> dict[int, list[int]]:
    """Where the runs of size unmarked tokens begin, by their hashes."""
    places = defaultdict(list)
    for lo, hi in _free(used):
        for k, h in enumerate(_rolling(seq[lo:hi], size)):
            places[h].append(lo + k)
    return places


def _shared(a: list[int], b: list[int], used_a: bytearray, used_b: bytearray, size: int) -> bool:
    """Whether a and b have a common run of size unmarked tokens."""
    places = _places(a, used_a, size)
    for h, starts in _places(b, used_b, size).items():
        for q in starts[:1]:
            if any(a[p : p + size] == b[q : q + size] for p in places.get(h, ())):
                return True
    return False


def _mark(a: list[int], b: list[int], used_a: bytearray, used_b: bytearray, size: int) -> list[tuple[int, int, int]]:
    """Marks common runs of size tokens, none longer being left, and returns them. A place in b that is taken, or was
    marked meanwhile, is never looked at again, so repeated tokens make no pairs of places."""
    tiles = []
    waiting = {h: starts[::-1] for h, starts in _places(b, used_b, size).items()}
    for p, h in sorted((p, h) for h, starts in _places(a, used_a, size).items() for p in starts):
        if used_a[p] or used_a[p + size - 1]:
            continue
        starts, others = waiting.get(h, []), []
        while starts:
            q = starts.pop()
            if used_b[q] or used_b[q + size - 1]:
                continue
            if a[p : p + size] == b[q : q + size]:
                used_a[p : p + size] = used_b[q : q + size] = b"\x01" * size
                tiles.append((p, q, size))
                break
            others.append(q)  # another run with the same hash
        starts.extend(reversed(others))
    return tiles


def tile(a: list[int], b: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in a, start in b, tokens) of the tiles of a (an item) and b (a stretch of a document): the longest common
    run first, then the longest of what is unmarked in both, the leftmost in a and then in b where they tie."""
    used_a, used_b = bytearray(len(a)), bytearray(len(b))
    tiles = []
    most = min(len(a), len(b))
    while most >= least:
        low, high = least, most
        while low <= high:  # a common run of some size has common runs of every smaller one
            middle = (low + high + 1) // 2
            if _shared(a, b, used_a, used_b, middle):
                low = middle + 1
            else:
                high = middle - 1
        if high < least:
            break
        tiles += _mark(a, b, used_a, used_b, high)
        most = high
    return tiles


class Items:
    """A block of benchmark items with its seeds, sorted for look-up: for each size of a seed the hashes and items. An
    item of fewer than least tokens has one seed, all of them."""

    def __init__(self, ids: list, texts: list[str | None], least: int):
        tokens = tokenise(pa.array(texts, pa.string()), NOT_WORD)
        self.ids = ids
        cut = np.split(tokens.hashes, tokens.offsets[1:-1]) if ids else []
        self.tokens = [x.tolist() for x in cut]
        sizes = np.diff(tokens.offsets)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, least + 1):
            seeds, item = runs(tokens, size)
            if size < least:
                short = sizes[item] == size
                seeds, item = seeds[short], item[short]
            if len(seeds):
                order = np.argsort(seeds, kind="stable")
                self.seeds[size] = seeds[order], item[order]

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]], int]]:
        """(number of the text, number of the item, tiles, tokens of the item) of the pairs that share a seed."""
        tokens = tokenise(texts, NOT_WORD)
        for size, (known, items) in self.seeds.items():
            yield from self._matches(tokens, size, known, items)

    def _matches(self, tokens: Tokens, size: int, known: np.ndarray, items: np.ndarray):
        seeds, text = runs(tokens, size)
        if not len(seeds):
            return
        low = np.searchsorted(known, seeds)
        hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == seeds)
        high = np.searchsorted(known, seeds[hit], side="right")
        first = np.searchsorted(text, np.arange(len(tokens.offsets)))  # where a text's runs begin
        places = defaultdict(list)
        for k, lo, hi in zip(hit.tolist(), low[hit].tolist(), high.tolist()):
            t = int(text[k])
            for item in set(items[lo:hi].tolist()):
                places[t, item].append(k - first[t])
        for (t, item), starts in places.items():
            # tokens outside a shared run can be in no tile: only the shared stretches of a long text are tiled
            whole, pieces, end = tokens.hashes_of(t), [], -1
            for s in starts:
                if s > end:
                    pieces.append(-1 - len(pieces))  # in no item, so that no tile goes across
                    pieces += whole[s : s + size]
                else:
                    pieces += whole[end : s + size]
                end = s + size
            yield t, item, tile(self.tokens[item], pieces, size), len(self.tokens[item])


def _matched(shared, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in text_slices(batches, text, rows=1000):
            rows = [
                (t, items.ids[i], sum(x[2] for x in tiles), n, len(tiles))
                for t, i, tiles, n in items.matches(batch.column(text))
                if tiles
            ]
            cols = [list(x) for x in zip(*rows)] or [[]] * 5
            new = [pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])]
            held = batch.select(keep).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns, *new], [*keep, "item_id", "covered", "item_tokens", "tiles"])

    return run


def _covered(shared, keep: list[str], text: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in text_slices(batches, text, rows=1000):
            most = batch.column(into).to_numpy(zero_copy_only=False).copy()
            for t, _, tiles, n in items.matches(batch.column(text)):
                most[t] = max(most[t], sum(x[2] for x in tiles) / n)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(most)], [*keep, into])

    return run


def blocks(benchmark: DataFrame, least: int = LEAST) -> Iterator:
    """The benchmark (item_id, text), a stated query set, as broadcast blocks of some BLOCK_BYTES of text; each is one
    more step over the documents, so its size is no limit. Items with a null id or text are left out."""
    spark = benchmark.sparkSession
    workspace.small_batches(spark)
    asked = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    held = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-held // BLOCK_BYTES) or 1
    for block in range(count):
        part = sorted(asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect())
        yield spark.sparkContext.broadcast(Items([r.item_id for r in part], [r.text for r in part], least))


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", least: int = LEAST) -> DataFrame:
    """keep's columns, item_id, covered, item_tokens and tiles for each pair of a row of docs and an item that share a
    run of least tokens or, if the item has fewer, all of its tokens in a row. Tokens are lower-cased runs of letters and
    digits.

    An item without tokens matches nothing, nor does a null or empty text; repeated rows match each. Columns of docs with
    the names of the new ones are replaced.
    """
    keep = [c for c in keep if c not in ("item_id", "covered", "item_tokens", "tiles")]
    schema = docs.select(*keep).schema.add("item_id", LongType())
    for name in ("covered", "item_tokens", "tiles"):
        schema = schema.add(name, IntegerType())
    source = docs.select(*dict.fromkeys([*keep, text]))
    return reduce(DataFrame.unionByName, [source.mapInArrow(_matched(b, keep, text), schema) for b in blocks(benchmark, least)])


def coverage(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "coverage", least: int = LEAST) -> DataFrame:
    """docs with column into: the largest share of an item's tokens that the tiles of the row's text cover, 0 where it
    matches none. A column of that name is replaced. Nothing is shuffled."""
    keep = [c for c in docs.columns if c != into]
    out = docs.select(*keep).withColumn(into, F.lit(0.0))
    for shared in blocks(benchmark, least):
        out = out.mapInArrow(_covered(shared, keep, text, into), out.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], share: float = SHARE) -> DataFrame:
    """The pairs of matches() whose tiles cover at least share of the item, with that coverage."""
    found = matches(docs, benchmark, keep).withColumn("coverage", F.col("covered") / F.col("item_tokens"))
    return found.filter(F.col("coverage") >= share)
