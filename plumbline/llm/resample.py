"""Importance resampling of documents towards a target's distribution of hashed word features.

Every text's one- and two-word features are counted in hash buckets, of the corpus and of the target; a bucket's gain is
the scaled logarithm of how much likelier the target makes it, and a document weighs the mean gain of its features. With
a Gumbel number added to each weight the highest scores are a draw without replacement. The draw is exact: a histogram
of the scores tells the lowest one that is drawn; the rows from there up are written as sorted runs, one or more a
partition, cut into ranges of the order; each range's runs are merged by a tournament tree, with ranks that start where
the ranges before it end, and the merge stops when the draw is complete.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace
from .tokens import U64, mix, text_slices

#: Buckets of features, least words of an eligible document, hundredths of the eligible ones that are drawn.
BUCKETS, LEAST_WORDS, PER_CENT, SEED = 10_000, 20, 25, 7
#: Rows of a sorted run and of a range that one merge yields, at most.
RUN_ROWS, RANGE_ROWS = 1 << 18, 1 << 18

#: The bytes of words, after A-Z are lowered: digits, a-z and all of letters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # what a byte adds, as crc is linear


def _moved(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The map op, the images of 32 bits, of each of x."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), op[bit], np.uint32(0))
    return out


@lru_cache(4096)
def _after(length: int) -> np.ndarray:
    """4 x 256: what each byte of a checksum becomes when length more bytes follow."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    op, power, left = bits, (bits >> np.uint32(8)) ^ _STEP[bits & np.uint32(255)], length
    while left:
        if left & 1:
            op = _moved(power, op)
        power = _moved(power, power)
        left >>= 1
    return np.stack([_moved(op, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, the bucket of each feature, the text that it is in). A null text has none. A pair's checksum
    is put together from those of its words, so only distinct words are looked at one by one."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))  # not cast: a slice that is cast to long offsets is lowered wrongly
    n = len(texts)
    none = np.zeros(0, np.int64)
    if not n or not (held := pc.sum(pc.binary_length(texts)).as_py()):
        return np.zeros(n, np.int64), none, none
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < held]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(n, np.int64), none, none
    text = np.searchsorted(ends, starts, side="right") - 1
    place = np.append(inside.cumsum()[starts] - 1, inside.sum()).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(data[inside])])
    coded = pc.dictionary_encode(words)
    word, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    behind = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))
    lengths, kind = np.unique(np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1, return_inverse=True)
    tables = np.stack([_after(int(x)) for x in lengths])
    pair = np.flatnonzero(text[1:] == text[:-1])
    left, right = alone[word[pair]], word[pair + 1]
    both = behind[right]
    for k in range(4):
        both = both ^ tables[kind[right], k, left >> np.uint32(8 * k) & np.uint32(255)]
    buckets = np.concatenate([alone[word], both]).astype(np.int64)
    return np.bincount(text, minlength=n), buckets, np.concatenate([text, text[pair]])


def _bucket_counts(batches: Iterator[pa.RecordBatch], buckets: int = BUCKETS) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in text_slices(batches, rows=20_000):
        total += np.bincount(features(batch.column("text"))[1] % buckets, minlength=buckets)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows of texts (text) each bucket has; each task adds up its own, so a row for a bucket and
    task is moved, and a number for a bucket comes to the driver."""
    made = texts.select("text").mapInArrow(lambda b: _bucket_counts(b, buckets), "bucket long, n long")
    found = made.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the logarithm of how much likelier the target makes each bucket, with one more of each."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Thousands of a Gumbel number for each id, the same in every run; a null id is an empty string."""
    made = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in doc_ids)
    return np.array([math.floor(-1000 * math.log(-math.log((int(x[:8], 16) + 0.5) / 4294967296))) for x in made], np.int64)


def _scored(shared, least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in text_slices(batches, rows=20_000):
            words, bucket, text = features(batch.column("text"))
            n = np.bincount(text, minlength=batch.num_rows)
            total = np.bincount(text, gain[bucket % len(gain)], batch.num_rows).astype(np.int64)  # whole numbers, so exact
            weight = total // np.maximum(n, 1)
            score = weight + gumbel(batch.column("doc_id").to_pylist(), seed)
            cols = [batch.column("doc_id"), *map(pa.array, (n, weight, score, words >= least))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_features", "weight", "score", "eligible"])

    return run


def scored(docs: DataFrame, gain: np.ndarray, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and eligible (whether it has least words) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scored(shared, least, seed), "doc_id long, n_features long, weight long, score long, eligible boolean"
    )


class Tournament:
    """A tree of losers over sorted runs of keys. Each inner node keeps the run that lost there; the run with the least
    head has won all its matches, and after it gave keys only its own path is played again."""

    END = (math.inf,)

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.head = [r[0] if r else self.END for r in runs] + [self.END] * (self.leaves - len(runs))
        self.at = [0] * len(runs)
        self.loser = [0] * self.leaves
        level = list(range(self.leaves))
        while len(level) > 1:
            half = len(level) // 2
            for k in range(half):
                a, b = level[2 * k], level[2 * k + 1]
                if self.head[b] < self.head[a]:
                    a, b = b, a
                self.loser[half + k] = b
                level[k] = a
            del level[half:]
        self.winner = level[0]

    def slices(self) -> Iterator[tuple[int, int, int]]:
        """(run, start, stop): stretches of the runs in the order of their keys; each goes on until another run's head is
        less."""
        while self.head[self.winner] is not self.END:
            w = self.winner
            leaf = self.leaves + w
            bar, node = self.END, leaf >> 1
            while node:
                bar = min(bar, self.head[self.loser[node]])
                node >>= 1
            run, start = self.runs[w], self.at[w]
            stop = max(start + 1, bisect_right(run, bar, lo=start))
            yield w, start, stop
            self.at[w] = stop
            self.head[w] = run[stop] if stop < len(run) else self.END
            node = leaf >> 1
            while node:
                if self.head[self.loser[node]] < self.head[w]:
                    self.loser[node], w = w, self.loser[node]
                node >>= 1
            self.winner = w


#: The rows of a run: the order (highest score, null ids last, smaller id, then any order of repeated rows), and the rest.
_KEY, _REST = 4, 2


def _key(run: np.ndarray, k: int) -> tuple:
    return tuple(run[:_KEY, k].tolist())


def _cut_runs(bounds):
    """Sorted runs of candidates, cut at the bounds of the ranges: (range, run, rows, cells)."""

    def made(rows: list[np.ndarray], run: int) -> Iterator[pa.RecordBatch]:
        m = np.concatenate(rows, axis=1)
        m = m[:, np.lexsort(m[:_KEY][::-1])]
        cuts = [0, *(bisect_left(range(m.shape[1]), b, key=lambda k: _key(m, k)) for b in bounds.value), m.shape[1]]
        for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                cells = m[:, a:b].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([run], pa.int64()), pa.array([b - a], pa.int64()), pa.array([cells], pa.binary())],
                    ["range", "run", "n", "cells"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, rows, seen, number = TaskContext.get().partitionId(), [], 0, 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, RUN_ROWS):
                batch = whole.slice(at, RUN_ROWS)
                long = lambda c: pc.fill_null(batch.column(c), 0).to_numpy().astype(np.int64)
                null = pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
                spread = mix(np.arange(seen, seen + batch.num_rows).astype(U64) + U64(part << 40)).view(np.int64)
                seen += batch.num_rows
                held.append(np.stack([-long("score"), null, long("doc_id"), spread, long("n_features"), long("weight")]))
                rows += batch.num_rows
                if rows >= RUN_ROWS:
                    yield from made(held, part << 20 | number)
                    held, rows, number = [], 0, number + 1
        if held and rows:
            yield from made(held, part << 20 | number)

    return run


def _merged(shared):
    """The rows of each range in order, ranked until the draw is complete. Rows come sorted by range and run."""

    def rows_of(runs: list[np.ndarray], start: int, drawn: int) -> pa.RecordBatch:
        tree = Tournament([list(zip(*r[:_KEY].tolist())) for r in runs])
        total, wanted, taken, pieces, rests = sum(r.shape[1] for r in runs), drawn - start, 0, [], [0] * len(runs)
        if wanted > 0:
            for run, a, b in tree.slices():
                b = min(b, a + wanted - taken)
                pieces.append(runs[run][:, a:b])
                rests[run] = b
                taken += b - a
                if taken == wanted:
                    break
        pieces += [r[:, a:] for r, a in zip(runs, rests)]  # not drawn, so in no order
        m = np.concatenate(pieces, axis=1)
        place = np.arange(total)
        rank = pa.array(start + 1 + place, mask=place >= taken)
        cols = [pa.array(m[2], mask=m[1] > 0), pa.array(m[4]), pa.array(m[5]), pa.array(-m[0]), rank]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_features", "weight", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, drawn = shared.value
        now, runs = None, []
        for batch in batches:
            for number, cells in zip(batch.column("range").to_pylist(), batch.column("cells").to_pylist()):
                if runs and number != now:
                    yield rows_of(runs, starts[now], drawn)
                    runs = []
                now = number
                runs.append(np.frombuffer(cells, np.int64).reshape(_KEY + _REST, -1))
        if runs:
            yield rows_of(runs, starts[now], drawn)

    return run


def _bounds(histogram: list[tuple[int, int]], candidates: DataFrame) -> list[tuple]:
    """The first key of each range but the first: ranges of whole scores with RANGE_ROWS rows or fewer; a score with more
    rows is cut at quantiles of its ids, and where an id fills several, by the spread of its rows."""
    bounds, held = [], 0
    crowded = {s: -(-n // RANGE_ROWS) for s, n in histogram if n > RANGE_ROWS}
    inner: dict[int, list[tuple]] = {}
    if crowded:
        most = max(crowded.values())
        at = [k / (4 * most) for k in range(1, 4 * most)]
        rows = candidates.filter(F.col("score").isin(*crowded)).groupBy("score")
        for r in rows.agg(F.percentile_approx("doc_id", at, 10_000).alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect():
            cuts = []
            for i in sorted(set(r.ids or ())):
                same = sum(x == i for x in r.ids)
                cuts += [(-r.score, 0, i, -(1 << 63) + (k << 64) // same) for k in range(same)]
            nulls = -(-r.nulls // RANGE_ROWS)
            inner[r.score] = cuts + [(-r.score, 1, 0, -(1 << 63) + (k << 64) // nulls) for k in range(nulls)]
    lowest = (0, 0, -(1 << 63), -(1 << 63))
    for s, n in histogram:  # from the highest score down
        if held and held + n > RANGE_ROWS:
            bounds.append((-s, *lowest[1:]))
            held = 0
        bounds += inner.get(s, [])
        held = RANGE_ROWS if s in crowded else held + n
    return bounds


def draw(scored: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of scored, a written table: the floor of per_cent hundredths
    of the eligible rows with the highest scores are ranked from 1, ties by the smaller doc_id (null last); of repeated
    rows any comes first. The others' rank is null.

    The histogram and the ranges' counts that come to the driver are a number for each score, which are thousands of
    logarithms and so few, and for each RANGE_ROWS rows.
    """
    spark = scored.sparkSession
    eligible = scored.filter("eligible")
    histogram = sorted(((r.score, r.n) for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = sum(n for _, n in histogram) * per_cent // 100
    columns = "doc_id", "n_features", "weight", "score"
    unranked = lambda df: df.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not drawn:
        return unranked(scored)
    above, upto = 0, 0
    while above < drawn:
        above += histogram[upto][1]
        upto += 1
    cut = histogram[upto - 1][0]
    candidates = eligible.filter(F.col("score") >= cut)
    bounds = spark.sparkContext.broadcast(_bounds(histogram[:upto], candidates))
    runs = workspace.stage(candidates.select(*columns).mapInArrow(_cut_runs(bounds), "range long, run long, n long, cells binary"), "runs")
    starts, total = {}, 0
    for r in runs.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").toLocalIterator():
        starts[r.range] = total
        total += r.n
    shared = spark.sparkContext.broadcast((starts, drawn))
    dealt = runs.repartition("range").sortWithinPartitions("range", "run")
    ranked = dealt.mapInArrow(_merged(shared), "doc_id long, n_features long, weight long, score long, rank long")
    return unranked(scored.filter(~F.col("eligible") | (F.col("score") < cut))).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (see draw()) of each row of docs (doc_id, text), drawn towards target
    (text). Null and empty texts have no features and the weight 0; documents of fewer than least words are never drawn.
    Repeated rows are drawn each; further columns are left out. Empty tables give what their counts of 0 give."""
    workspace.small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return draw(workspace.stage(scored(docs, gain, least, seed), "scores"), per_cent)
