"""Near-duplicate vectors by spherical-cap filters.

A vector, turned at random, is cut into blocks; each block has a random code, and a filter is one code word of each
block. A vector is in every filter whose direction exceeds a threshold, which list decoding finds from the blocks' own
scores. Vectors that share a filter are compared by their exact cosine. Equal vectors stand for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, workspace

LEAST = 0.9
#: Filters that a pair at the least cosine shares, about. The caps get smaller as the codes grow with the table, and a
#: vector's share of filters in common with a neighbour with them, so a vector is in more filters of a larger table.
SHARED = 14.0
#: Filters that a vector is in, about, at least.
FILTERS_OF_VECTOR = 40
#: A vector far from the code words exceeds few thresholds or none: it takes the next best filters, up to this share of
#: what others are in.
FEWEST = 0.9
#: Bytes of the scores of the vectors that are decoded at once.
SCORE_BYTES = 64 << 20
#: Vectors of a filter, about, if they were spread evenly; the codes grow with the table so that this stays.
VECTORS_OF_FILTER = 8
BLOCKS = 2
#: Vectors that are compared in one piece; a filter with more is cut into pieces, and pieces are compared in pairs.
PIECE = 1024
SEED = 20_240_101


def _coordinate(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A grid, and the share of random unit vectors whose first coordinate is at least that."""
    u = np.linspace(-1, 1, 200_001)
    density = (1 - u**2) ** ((dim - 3) / 2) if dim > 3 else np.ones(len(u))
    return u, density[::-1].cumsum()[::-1] / density.sum()


def cap_of(dim: int, share: float) -> float:
    """The least cosine with a direction of the random vectors that make up share."""
    u, above = _coordinate(dim)
    return float(u[min(np.searchsorted(-above, -share), len(u) - 1)])


def in_both(dim: int, cap: float, cosine: float) -> float:
    """How often a random direction within cap of a vector is within cap of another one that has this cosine with it."""
    u, above = _coordinate(dim)
    x = np.linspace(cap, 1, 2001)[:-1]
    weight = (1 - x**2) ** ((dim - 3) / 2)
    rest, beyond = _coordinate(dim - 1)
    need = (cap - cosine * x) / (np.sqrt(1 - cosine**2) * np.sqrt(1 - x**2))
    return float((weight * np.interp(need, rest, beyond, left=1.0, right=0.0)).sum() / weight.sum())


@dataclass
class Codes:
    """words[b]: the unit code words of block b; turn: a random rotation; threshold: of the sum of a vector's scores."""

    turn: np.ndarray
    words: list[np.ndarray]
    threshold: float
    fewest: int

    @classmethod
    def made(cls, dim: int, vectors: int, least: float = LEAST, seed: int = SEED) -> Codes:
        rng = np.random.default_rng(seed)
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        blocks = min(BLOCKS, dim)
        of_vector = float(FILTERS_OF_VECTOR)
        while True:
            filters = max(4096, vectors * of_vector / VECTORS_OF_FILTER)
            size = int(np.ceil(filters ** (1 / blocks)))
            cap = cap_of(dim, min(1.0, of_vector / size**blocks))
            if dim <= 4 or of_vector * in_both(dim, cap, least) >= SHARED or of_vector > size**blocks / 4:
                break
            of_vector *= 1.1
        words = []
        for part in np.array_split(np.arange(dim), blocks):
            w = rng.standard_normal((size, len(part)))
            words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
        # a filter's direction has the norm of a word of each block
        return cls(turn, words, float(cap * np.sqrt(blocks)), int(FEWEST * of_vector))

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        """Each block's scores of unit vectors (rows)."""
        turned, at, out = unit @ self.turn, 0, []
        for w in self.words:
            out.append(turned[:, at : at + w.shape[1]] @ w.T)
            at += w.shape[1]
        return out

    def decode(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        """For each unit vector the numbers of all filters that it exceeds the threshold of, or of its fewest best ones
        if those are more."""
        scores = self.scores(unit)
        tops = [s.max(1) for s in scores]
        for k in range(len(unit)):
            of_vector, rests = [s[k] for s in scores], [sum(t[k] for t in tops[b + 1 :]) for b in range(len(tops))]
            threshold = self.threshold
            sums, numbers = self._above(of_vector, rests, threshold)
            while len(sums) < self.fewest:
                threshold -= 0.05
                sums, numbers = self._above(of_vector, rests, threshold)
            if threshold < self.threshold:
                numbers = numbers[np.argpartition(-sums, self.fewest - 1)[: self.fewest]]
            yield numbers

    def _above(self, scores: list[np.ndarray], rests: list[float], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Sums of scores, and numbers, of the filters at threshold or above. A block's words are tried only if the best
        words of the blocks after it could still make up the rest."""
        sums, numbers = np.zeros(1), np.zeros(1, np.int64)
        for s, rest in zip(scores, rests):
            word = np.flatnonzero(s + sums.max(initial=-np.inf) + rest >= threshold)
            total = np.add.outer(sums, s[word])
            at, of = np.nonzero(total + rest >= threshold)
            sums, numbers = total[at, of], numbers[at] * len(s) + word[of]
        return sums, numbers


def usable(vector: Column) -> Column:
    """Whether all components are finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _filters(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: Codes = shared.value
        rows = max(1, SCORE_BYTES // (8 * sum(len(w) for w in codes.words)))
        for frame in frames:
            for at in range(0, len(frame), rows):
                part = frame[at : at + rows]
                x = np.stack(part["vector"].to_numpy()).astype(float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = list(codes.decode(x))
                n = [len(f) for f in found]
                ids = np.repeat(part["id"].to_numpy(), n)
                yield pd.DataFrame({"filter": np.concatenate(found), "id": ids})

    return run


def _compared(least: float):
    def near(a_ids, a, b_ids, b, same: bool) -> pd.DataFrame:
        i, j = np.nonzero(a @ b.T >= least)
        keep = a_ids[i] < b_ids[j] if same else a_ids[i] != b_ids[j]
        x, y = a_ids[i[keep]], b_ids[j[keep]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    def unit(part: pd.DataFrame) -> np.ndarray:
        x = np.stack(part["vector"].to_numpy()).astype(float)
        return x / np.sqrt((x**2).sum(1, keepdims=True))

    def group(part: pd.DataFrame) -> pd.DataFrame:
        lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
        left = part[part["piece"] == lo]
        if lo == hi:
            x, ids = unit(left), left["id"].to_numpy()
            return near(ids, x, ids, x, True)
        right = part[part["piece"] == hi]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return near(left["id"].to_numpy(), unit(left), right["id"].to_numpy(), unit(right), False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by filter and piece; the last group of a batch may go on in the next."""
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            key = frame[["filter", "lo", "hi"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            found = [group(frame.iloc[x:y]) for x, y in zip(starts[:-1], starts[1:]) if y - x > 1]
            held = frame.iloc[starts[-1] :]
            if found:
                yield pd.concat(found).drop_duplicates()
        if held is not None and len(held) > 1:
            yield group(held)

    return run


def pairs(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b), a < b: the ids of the pairs of vectors (id long, vector array) that share a filter and have at least the
    cosine least in double precision. The ids must be distinct, the vectors usable and of one length."""
    spark = vectors.sparkSession
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.min(F.size("vector")).alias("low")).first()
    if not shape.n:
        return spark.createDataFrame([], "a long, b long")
    if shape.dim != shape.low:
        raise ValueError(f"vectors of {shape.low} to {shape.dim} components")
    shared = spark.sparkContext.broadcast(Codes.made(shape.dim, shape.n, least))
    found = workspace.stage(vectors.mapInPandas(_filters(shared), "filter long, id long"), "filters")
    # a filter with one vector has no pairs; one with many is cut into pieces
    sizes = found.groupBy("filter").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = workspace.stage(sizes, "filter-sizes")  # written, so that Spark can split a filter of very many vectors
    cut = F.ceil(F.col("n") / PIECE).cast("int")
    placed = found.join(sizes, "filter").withColumn("pieces", cut).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    sent = placed.select("filter", "id", "piece", other).select(
        "filter", "id", "piece", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi")
    )
    rows = sent.join(vectors, "id").repartition("filter", "lo", "hi").sortWithinPartitions("filter", "lo", "hi")
    return rows.mapInPandas(_compared(least), "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per row of df: key, n_links, component_id, kept.

    Two rows are linked if their vectors' cosine is least or more; n_links counts the other rows linked with a row,
    component_id is the smallest key reachable by links, kept whether that is the row's own. Equal vectors make one
    class, so copies are counted but not paired. Rows whose vector is null, zero or has null or non-finite components,
    or whose key is null, link with nothing and are their own component. Repeated rows are copies of each other. Vectors
    must have one length: those of several are an error. Further columns are left out.
    """
    workspace.small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    good = F.coalesce(usable(F.col("vector")) & F.col("key").isNotNull(), F.lit(False))
    classes = rows.filter(good).groupBy("vector").agg(F.min("key").alias("id"), F.count("*").alias("n"))
    classes = workspace.stage(classes, "vector-classes")
    linked = workspace.stage(pairs(classes.select("id", "vector"), least), "vector-pairs")
    both = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    smallest = graph.components(linked)
    named = (
        classes.join(others.withColumnRenamed("a", "id"), "id", "left")
        .join(smallest.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "vector",
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    alone = rows.filter(~good).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    joined = rows.filter(good).join(named, "vector", "left").select("key", "n_links", "component_id").unionByName(alone)
    component = F.col("component_id")
    return joined.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
