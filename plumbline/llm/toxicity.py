"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (word beginnings, their share of a text's words, marks of style), found
on a bounded sample of labelled rows. A generative model of their votes, fitted by expectation-maximisation without
labels, estimates how often each votes on toxic and on other texts and which voters are correlated, whose evidence is
then shared. A linear classifier is trained on the posterior labels of that model and scores every whole text. No label,
language, source or id is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workspace
from .tokens import give_back

#: Bound of the sample of labelled rows that voters, label model and classifier are fitted on, chosen by a hash of the
#: id. The driver gets the names of the voters and each row's votes.
MAX_SAMPLE = 4_000
#: Voters, at most; documents of the sample that a term must be in; share of toxic ones among them, the classes weighed
#: alike; standard deviations by which their number exceeds what chance gives a term that says nothing.
MAX_VOTERS, SUPPORT, PURITY, SURPRISE = 300, 4, 0.9, 5.0
#: Texts with a score of at least this count as toxic.
CUT = 0.3
#: Lengths of the word beginnings that are terms besides the words.
HEADS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Marks of style are terms too.
STYLE = {"#!": re.compile("[!]"), "#?": re.compile("[?]"), "#caps": re.compile(r"\b[A-Z]{3,}\b")}
#: A term votes when it is there at all, and again when it is there twice or more and makes up these shares of the words.
SHARES = (0.004, 0.012)
#: Voters for all terms of the lexicon together: the shares of the words that they make up.
TOTALS = (0.005, 0.01, 0.015)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether labels of the row must not be learned from: crc32 of the id as text, modulo parts, is part. A null id's
    text is empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def parts_of(word: str) -> list[str]:
    """A word in lower case and its beginnings, which end in *."""
    return [word, *(word[:n] + "*" for n in HEADS if len(word) >= n)]


def votes_of(counts: dict[str, int], words: int) -> list[str]:
    """The votes of the terms with these counts in a text of so many words: name, name~1, name~2."""
    found = []
    for term, n in counts.items():
        found.append(term)
        if n > 1:
            found += [f"{term}~{k}" for k, share in enumerate(SHARES, 1) if n >= share * words]
    return found


def terms_of(text: str) -> list[str]:
    """The votes of all terms of a whole text."""
    words, counts = WORD.findall(text.lower()), Counter()
    for word, n in Counter(words).items():
        for part in parts_of(word):
            counts[part] += n
    counts.update({k: n for k, p in STYLE.items() if (n := len(p.findall(text)))})
    return votes_of(counts, len(words))


class Lexicon:
    """The votes of chosen voters on whole texts, with the terms of each word kept."""

    def __init__(self, names: list[str]):
        self.names = [*names, *(f"@{k}" for k in range(len(TOTALS)))]
        self.place = {name: k for k, name in enumerate(self.names)}
        self.bases = {n.partition("~")[0] for n in names}
        self.words: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        """The numbers of the voters that vote."""
        text, known, counts, hits = text or "", self.words, {}, 0
        words = WORD.findall(text.lower())
        for word in words:
            terms = known.get(word)
            if terms is None:
                if len(known) > 100_000:
                    known.clear()
                terms = known[word] = tuple(t for t in parts_of(word) if t in self.bases)
            if terms:
                hits += 1
                for t in terms:
                    counts[t] = counts.get(t, 0) + 1
        for name, pattern in STYLE.items():
            if name in self.bases and (n := len(pattern.findall(text))):
                counts[name] = n
        votes = [self.place[v] for v in votes_of(counts, len(words)) if v in self.place]
        return votes + [self.place[f"@{k}"] for k, share in enumerate(TOTALS) if hits > 1 and hits >= share * len(words)]


def _explode_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), 100):
            part = frame[at : at + 100]
            rows = [(t, y) for x, y in zip(part["text"], part["toxic"]) for t in terms_of(x)]
            yield pd.DataFrame(rows, columns=["term", "toxic"])


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labelled rows that may be learned from. Rows with a null id or label are left out; of
    several for one id, toxic if any is."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, text and toxic of at most most learnable rows, a half of them toxic if there are enough: toxic ones are
    few, and voters need them. class_weights() makes up for the share that a class has in the sample."""
    known = learnable(labels)
    order = F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")
    picked = known.filter("toxic = 1").orderBy(*order).limit(most // 2).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(most - most // 2)
    )
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def class_weights(sampled: dict[int, int], known: dict[int, int]) -> dict[int, float]:
    """The weight of a sampled row of each class, so that the classes count as they do among all learnable rows whatever
    the size of the table; the mean over the sample is one."""
    n, total = sum(sampled.values()), sum(known[c] for c in sampled)
    return {c: known[c] / total * n / sampled[c] for c in sampled}


@dataclass
class LabelModel:
    """Votes are conditionally independent given the class but for groups of correlated voters: voter j's evidence
    counts with weight[j], the inverse of the size of what moves with it."""

    prior: float
    hit: np.ndarray  # 2 x voters: how often it votes on the class
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.hit[1] / self.hit[0]) * self.weight
        off = np.log((1 - self.hit[1]) / (1 - self.hit[0])) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @classmethod
    def fit(cls, votes: np.ndarray, row_weight: np.ndarray | None = None, rounds: int = 40) -> LabelModel:
        """Expectation-maximisation from the start that texts with several votes are toxic. votes: rows x voters, 0 or 1;
        row_weight: for how many rows each counts, one by default."""
        n, m = votes.shape
        of = np.ones(n) if row_weight is None else row_weight
        post = np.clip(votes.sum(1) / 3, 0.02, 0.98)
        weight = np.ones(m)
        for k in range(rounds):
            on, off = post * of, (1 - post) * of
            prior = float(np.clip(on.sum() / of.sum(), 0.01, 0.99))
            hit = np.stack([(off @ votes + 0.05) / (off.sum() + 1), (on @ votes + 0.5) / (on.sum() + 1)])
            hit = np.clip(hit, 1e-5, 1 - 1e-5)
            if k % 10 == 9:  # what the classes leave unexplained is correlation between voters
                left = votes - (post[:, None] * hit[1] + (1 - post[:, None]) * hit[0])
                scale = np.sqrt((of[:, None] * left**2).sum(0) / of.sum()) + 1e-9
                r = (of[:, None] * left / scale).T @ (left / scale) / of.sum()
                np.fill_diagonal(r, 0)
                weight = 1 / (1 + np.where(r > 0.3, r, 0).sum(1))
            model = cls(prior, hit, weight)
            post = model.posterior(votes)
        return model


@dataclass
class Classifier:
    """score = sigmoid(bias + weights of the voters that vote on the text)."""

    names: list[str]
    bias: float
    weights: np.ndarray

    def scorer(self) -> Callable[[str | None], float]:
        lexicon, weights = Lexicon(self.names), self.weights.tolist()

        def score(text: str | None) -> float:
            z = self.bias + sum([weights[k] for k in sorted(lexicon(text))])
            return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))

        return score


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """The coefficients, the bias last, of a logistic regression on targets from 0 to 1: Newton's method with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - target)) + penalty * w
        curve = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_SAMPLE) -> Classifier:
    """Voters, label model and classifier from the bounded sample. Without labelled rows of both classes, or without
    voters, every text gets the same low score."""
    workspace.small_batches(docs.sparkSession)
    picked = workspace.stage(sample(docs, labels, most), "toxicity-sample")
    counts = {int(r.toxic): r["count"] for r in picked.groupBy("toxic").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return Classifier([], -3.0, np.zeros(len(TOTALS)))
    known = {int(r.toxic): r["count"] for r in learnable(labels).groupBy("toxic").count().collect()}
    weight_of = class_weights(counts, known)
    p = n1 / (n1 + n0)
    n, bad = F.col("n"), F.col("bad")
    purity = (bad / n1) / (bad / n1 + (n - bad) / n0)
    voters = (
        picked.select("text", "toxic")
        .mapInPandas(_explode_terms, "term string, toxic int")
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
        .withColumn("surprise", (bad - p * n) / F.sqrt(n * p * (1 - p)))
        .filter((n >= SUPPORT) & (purity >= PURITY) & (F.col("surprise") >= SURPRISE))
        .orderBy(F.desc("surprise"), "term")
        .limit(MAX_VOTERS)
    )
    names = [r.term for r in voters.select("term").collect()]
    lexicon = Lexicon(names)

    @F.pandas_udf("array<int>")
    def cast(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon(x) for x in texts])

    rows = picked.select("doc_id", "toxic", cast("text").alias("votes")).orderBy("doc_id").collect()
    votes = np.zeros((len(rows), len(lexicon.names)))
    for k, r in enumerate(rows):
        votes[k, r.votes] = 1
    weight = np.array([weight_of[int(r.toxic)] for r in rows])
    post = LabelModel.fit(votes, weight).posterior(votes)
    w = logistic(votes, post, weight)
    return Classifier(names, float(w[-1]), w[:-1])


def score(docs: DataFrame, model: Classifier, text: str = "text", into: str = "score") -> DataFrame:
    """docs with column into, from 0 to 1, of each whole text; a column of that name is replaced. A null text counts as
    empty. Rows are independent of each other: nothing is shuffled."""
    workspace.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score_of = shared.value.scorer()
        for batch in texts:
            yield pd.Series([score_of(x) for x in batch], dtype="float64")
            give_back()

    scored.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(into, F.pandas_udf(scored, "double")(F.col(text)))
