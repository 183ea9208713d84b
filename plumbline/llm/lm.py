"""Language-model scoring by deleted interpolation.

The probability of a token after its predecessor mixes the maximum-likelihood estimates of bigram and unigram with a
uniform share; the weights depend on the bucket of the predecessor's count and are learned by expectation-maximisation
on counts that were held out from the estimates.

Counts are exchanged in blocks: a block of texts sends its distinct words and bigrams, as 64-bit hashes with counts, to
the parts of the hash space, sorted and packed; a part adds the counts of all blocks and sends each block the totals of
what it asked for. So no row of the shuffle stands for a single token, frequent words are added up before they move,
and no vocabulary goes to the driver: only histograms of bounded size do. Blocks are written to the shared folder, so a
lost executor costs no more than its tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workspace
from .tokens import U64, mix, tokenise

#: The hashes of a text's end, which is a token, and of its start, which only precedes.
END, START = U64(0x656E64), U64(0x7374617274)
#: Pseudo-count of the base score.
ADD = 0.1
#: Texts and, about, characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 20_000, 8_000_000
#: Keys of all blocks that a part of the hash space adds up, about.
PART_KEYS = 1_500_000
#: Width of the histograms' cells as a power of ten, and how far down they go.
CELL, LOWEST = 0.04, 12.0
BUCKETS = 40


def remainder(doc_id: Column, parts: int = 10) -> Column:
    """crc32 of the id as text, modulo parts; a null id's text is empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def pack(values: np.ndarray) -> bytes:
    """Numbers packed by their bytes of equal weight, which compress well when sorted differences or small counts."""
    raw = values.astype("<u8")
    return pa.compress(raw.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(raw) else b""


def unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U64)
    raw = np.frombuffer(pa.decompress(blob, n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n), dtype=U64)


BLOCK_SCHEMA = (
    "block string, doc_ids array<long>, folds array<int>, ends array<long>, words binary, n_words int, distinct binary, "
    "held_at binary, held_codes binary, held_n binary, n_held int"
)
BLOCK_ARROW = pa.schema([
    ("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("folds", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())),
    ("words", pa.binary()), ("n_words", pa.int32()), ("distinct", pa.binary()),
    ("held_at", pa.binary()), ("held_codes", pa.binary()), ("held_n", pa.binary()), ("n_held", pa.int32()),
])
KEY_SCHEMA = "block string, kind string, part int, n int, hashes binary, train binary, rest binary"
KEY_ARROW = pa.schema([
    ("block", pa.string()), ("kind", pa.string()), ("part", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()),
    ("train", pa.binary()), ("rest", pa.binary()),
])


class Block:
    """A block's texts as numbers: words, with the most frequent first, up to the end and start at last; tokens that
    are words or ends; pairs of neighbours in the order of their hashes."""

    def __init__(self, folds: np.ndarray, ends: np.ndarray, words: np.ndarray, distinct: np.ndarray, held_fold: int):
        self.folds, self.ends, self.words, self.distinct = folds, ends, words, distinct
        n = len(distinct)
        begins = np.concatenate([[0], ends[:-1]])
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[begins] = n - 1
        codes, pair_of = np.unique(before * n + words, return_inverse=True)
        hashes = mix(distinct[codes // n] * U64(0x9E3779B97F4A7C15) + distinct[codes % n])
        order = np.argsort(hashes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.codes, self.hashes, self.pair_of, self.begins = codes[order], hashes[order], place[pair_of], begins
        fold = np.repeat(folds, ends - begins)
        self.train, self.rest = fold != 0, (fold != 0) & (fold != held_fold)
        # as a context the start counts once for each text
        self.train0, self.rest0 = folds != 0, (folds != 0) & (folds != held_fold)

    @classmethod
    def of(cls, row: dict, held_fold: int) -> Block:
        ends = np.array(row["ends"], np.int64)
        words = unpack(row["words"], int(ends[-1])).astype(np.int64)
        distinct = unpack(row["distinct"], row["n_words"])
        return cls(np.array(row["folds"], np.int64), ends, words, distinct, held_fold)

    def word_counts(self, name: str) -> np.ndarray:
        counts = np.bincount(self.words, getattr(self, name), len(self.distinct)).astype(np.int64)
        counts[-1] = getattr(self, name + "0").sum()
        return counts

    def pair_counts(self, name: str) -> np.ndarray:
        return np.bincount(self.pair_of, getattr(self, name), len(self.codes)).astype(np.int64)

    def keys(self, block: str, parts: int) -> Iterator[dict]:
        """The counts of words and pairs by parts of the hash space."""
        order = np.argsort(self.distinct)
        for kind, hashes, train, rest in (
            ("word", self.distinct[order], self.word_counts("train")[order], self.word_counts("rest")[order]),
            ("pair", self.hashes, self.pair_counts("train"), self.pair_counts("rest")),
        ):
            cuts = np.searchsorted(hashes >> U64(32), (np.arange(parts + 1, dtype=U64) << U64(32)) // U64(parts)).tolist()
            for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if hi > lo:
                    yield {
                        "block": block, "kind": kind, "part": part, "n": hi - lo, "hashes": pack_sorted(hashes[lo:hi]),
                        "train": pack(train[lo:hi]), "rest": pack(rest[lo:hi]),
                    }


def _block(frame: pa.Table, held_fold: int) -> dict:
    tokens = tokenise(frame["text"].combine_chunks(), lower=False)
    sizes = np.diff(tokens.offsets) + 1
    ends = np.cumsum(sizes)
    often = np.argsort(-np.bincount(tokens.words, minlength=len(tokens.distinct)), kind="stable")
    rank = np.empty_like(often)
    rank[often] = np.arange(len(often))
    distinct = np.concatenate([mix(tokens.distinct)[often], [END, START]]).astype(U64)
    words = np.full(ends[-1], len(distinct) - 2, np.int64)
    inner = np.ones(len(words), bool)
    inner[ends - 1] = False
    words[inner] = rank[tokens.words]
    folds = frame["fold"].to_numpy().astype(np.int64)
    made = Block(folds, ends, words, distinct, held_fold)
    held = made.pair_counts("train") - made.pair_counts("rest")
    at = np.flatnonzero(held)
    return {
        "block": uuid.uuid4().hex, "doc_ids": frame["doc_id"].to_pylist(), "folds": folds.tolist(), "ends": ends.tolist(),
        "words": pack(words), "n_words": len(distinct), "distinct": pack(distinct),
        "held_at": pack_sorted(at), "held_codes": pack(made.codes[at]), "held_n": pack(held[at]), "n_held": len(at),
    }


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of BLOCK_ROWS rows or, but for a last text that is longer, BLOCK_CHARS bytes of text at most."""
    held, size, rows = [], 0, 0
    for batch in batches:
        texts = batch.column("text")
        lengths = np.cumsum([0] + [len(x) for x in texts.cast(pa.binary()).to_pylist()])
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(lengths, lengths[at] + BLOCK_CHARS - size, side="right") - 1 - at
            step = int(min(max(room, 0 if held else 1), batch.num_rows - at, BLOCK_ROWS - rows))
            if step:
                held.append(batch.slice(at, step))
                size, rows, at = size + int(lengths[at + step] - lengths[at]), rows + step, at + step
            if at < batch.num_rows or rows >= BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(held_fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cut(batches):
            yield pa.RecordBatch.from_pylist([_block(table, held_fold)], schema=BLOCK_ARROW)

    return run


def _sent(parts: int, held_fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            made = Block.of(row, held_fold)
            yield pa.RecordBatch.from_pylist(list(made.keys(row["block"], parts)), schema=KEY_ARROW)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other, as a row is a whole block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """The totals of a part's keys over all blocks, for each block in the order of its keys. The first row also has the
    number of distinct words and the sum of the words' counts, without the start, in training."""
    keys = [unpack_sorted(b, n) for b, n in zip(frame["hashes"], frame["n"])]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = {}
    for name in ("train", "rest"):
        counts = np.concatenate([unpack(b, n) for b, n in zip(frame[name], frame["n"])]).astype(float)
        totals[name] = np.bincount(at, counts, len(distinct)).astype(np.int64)
    cuts = np.cumsum([0] + frame["n"].tolist())
    word = frame["kind"].iloc[0] == "word"
    real = distinct != START
    stat = lambda x: [int(x)] + [0] * (len(frame) - 1)
    out = frame[["block", "kind", "part", "n"]].copy()
    for name in ("train", "rest"):
        out[name] = [pack(totals[name][at[lo:hi]]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        out["sum_" + name] = stat(totals[name][real].sum() if word else 0)
        out["distinct_" + name] = stat((totals[name][real] > 0).sum() if word else 0)
    return out


TOTAL_SCHEMA = (
    "block string, kind string, part int, n int, train binary, sum_train long, distinct_train long, "
    "rest binary, sum_rest long, distinct_rest long"
)


def bucket(counts: np.ndarray) -> np.ndarray:
    """Of a context: 0 if it was never seen, else one more than the whole part of the logarithm to base 2."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(int) + 1, BUCKETS - 1), 0)


@dataclass
class Mixture:
    """Weights of bigram, unigram and uniform share, for each bucket of the context's count."""

    weights: np.ndarray
    tokens: int
    distinct: int

    def probability(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[bucket(context)]
        two = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
        return w[:, 0] * two + w[:, 1] * (word / max(1, self.tokens)) + w[:, 2] / (self.distinct + 1)

    @classmethod
    def fit(cls, cells: pd.DataFrame, tokens: int, distinct: int, uniform: float, rounds: int = 60) -> Mixture:
        """cells: bucket, two and one (which cell of the estimates, -1 for none), n. A bucket without held-out tokens
        takes the weights of all tokens together."""
        start = np.array([0.5, 0.4, 0.1])
        size = lambda c: np.where(c < 0, 0.0, 10.0 ** (-(np.maximum(c, 0) + 0.5) * CELL))
        est = np.stack([size(cells["two"].to_numpy()), size(cells["one"].to_numpy()), np.full(len(cells), uniform)], 1)
        n, of = cells["n"].to_numpy(float), cells["bucket"].to_numpy()

        def learn(mask: np.ndarray) -> np.ndarray:
            w, e, m = start, est[mask], n[mask][:, None]
            for _ in range(rounds):
                share = w * e
                share = share / share.sum(1, keepdims=True) * m
                w = (share.sum(0) + 1e-3) / (m.sum() + 3e-3)
            return w

        common = learn(np.ones(len(n), bool)) if len(n) else start
        weights = np.tile(common, (BUCKETS, 1))
        for b in np.unique(of):
            weights[b] = learn(of == b)
        weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context has no bigrams
        return cls(weights, tokens, distinct)


def _replied(row: dict, name: str, kind: str) -> np.ndarray:
    """The totals of a block's words or pairs in the order of their hashes."""
    parts = {x["part"]: x for x in row["totals"] if x["kind"] == kind}
    return np.concatenate([unpack(parts[p][name], parts[p]["n"]) for p in sorted(parts)]).astype(np.int64)


def _word_totals(row: dict, name: str) -> np.ndarray:
    distinct = unpack(row["distinct"], row["n_words"])
    out = np.empty(len(distinct), np.int64)
    out[np.argsort(distinct)] = _replied(row, name, "word")
    return out


def _histogram(totals: dict):
    cell = lambda p: np.where(p > 0, np.minimum(-np.log10(np.maximum(p, 1e-300)), LOWEST) / CELL, -1.0).astype(int)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(frames):
            words, n = _word_totals(row, "rest"), row["n_held"]
            at, codes, held = unpack_sorted(row["held_at"], n), unpack(row["held_codes"], n), unpack(row["held_n"], n)
            pair, codes = _replied(row, "rest", "pair")[at.astype(np.int64)], codes.astype(np.int64)
            context, word = words[codes // len(words)], words[codes % len(words)]
            two = cell(np.divide(pair, context, out=np.zeros(n), where=context > 0))
            one = cell(word / max(1, totals["sum_rest"]))
            found, where = np.unique((bucket(context) * 1000 + two + 1) * 1000 + one + 1, return_inverse=True)
            counts = np.bincount(where, held.astype(float), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["code", "n"])

    return run


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORE_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])


def _scores(shared, totals: dict, held_fold: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture: Mixture = shared.value
        whole, distinct = totals["sum_train"], totals["distinct_train"]
        for row in _rows(frames):
            made = Block.of(row, held_fold)
            words, n = _word_totals(row, "train"), len(made.distinct)
            context, word = words[made.codes // n], words[made.codes % n]
            log_p = np.log10(mixture.probability(_replied(row, "train", "pair"), context, word))
            base = np.log10((words + ADD) / (whole + ADD * (distinct + 1)))
            add = lambda x: np.add.reduceat(x, made.begins)
            cols = [
                pa.array(row["doc_ids"], pa.int64()), pa.array(made.folds == 0), pa.array(made.ends - made.begins),
                pa.array(add((words[made.words] > 0).astype(np.int64))), pa.array(np.full(len(made.ends), whole)),
                pa.array(add(base[made.words])), pa.array(add(log_p[made.pair_of])),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=SCORE_ARROW)

    return run


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_fold: int = 9) -> DataFrame:
    """For each row of docs SCORE_SCHEMA: base_score is the log10 probability of its tokens by add-ADD unigrams, score
    that by the interpolated bigrams; both learn from all rows whose remainder of the id is not 0, and the mixture
    weights from the counts of the rows with remainder held_fold against estimates without these.

    Tokens are the words between ASCII white space with A to Z in lower case, then one end, which is a token; words are
    counted by 64-bit hashes. A null text counts as empty and has only its end. Repeated rows count each. Without any
    row to learn from the score is that of the uniform share. doc_id must be an integer.
    """
    spark = docs.sparkSession
    workspace.small_batches(spark)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.translate(F.coalesce(F.col(text), F.lit("")), upper, lower).alias("text"),
        remainder(F.col(doc_id)).alias("fold"),
    )
    # the words of all texts, about, to choose the number of parts by
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(8, int(size / 8 / PART_KEYS) + 1)
    blocks = workspace.stage(source.mapInArrow(_blocks(held_fold), BLOCK_SCHEMA), "lm-blocks")
    texts = "block", "folds", "ends", "words", "n_words", "distinct"
    sent = blocks.select(*texts).mapInArrow(_sent(parts, held_fold), KEY_SCHEMA)
    replies = workspace.stage(sent.groupBy("kind", "part").applyInPandas(_add_up, TOTAL_SCHEMA), "lm-totals")
    names = ["sum_train", "sum_rest", "distinct_train", "distinct_rest"]
    totals = {k: int(v or 0) for k, v in replies.agg(*(F.sum(n).alias(n) for n in names)).first().asDict().items()}
    gathered = lambda name: replies.groupBy("block").agg(
        F.collect_list(F.struct("kind", "part", "n", name)).alias("totals")
    )
    held = blocks.select("block", "n_words", "distinct", "held_at", "held_codes", "held_n", "n_held")
    cells = held.join(gathered("rest"), "block").drop("block").mapInArrow(_histogram(totals), "code long, n long")
    cells = cells.groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    code = cells["code"].to_numpy(np.int64)
    cells = pd.DataFrame({"bucket": code // 1_000_000, "two": code // 1000 % 1000 - 1, "one": code % 1000 - 1, "n": cells["n"]})
    mixture = Mixture.fit(cells, totals["sum_train"], totals["distinct_train"], 1 / (totals["distinct_rest"] + 1))
    shared = spark.sparkContext.broadcast(mixture)
    full = blocks.select(*texts, "doc_ids").join(gathered("train"), "block").drop("block")
    return full.mapInArrow(_scores(shared, totals, held_fold), SCORE_SCHEMA)
