"""Text operators: shingles and similarity of adjacent versions, context windows, proximity, retractions."""

from __future__ import annotations

import re

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def words(text: Column) -> Column:
    """Lower-case words between blanks."""
    return F.filter(F.split(F.lower(text), r"[ \n\t\r]+"), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it, also within lambdas."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, k: int = 5) -> Column:
    """The distinct runs of k words as 64-bit hashes; none for a shorter text."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, k), " ")))
        return F.when(F.size(w) >= k, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    return bound(words(text), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeated elements; null where both are empty."""
    return bound(F.size(F.array_intersect(a, b)), lambda n: n / F.nullif(F.size(a) + F.size(b) - n, F.lit(0)))


def adjacent_similarity(docs: DataFrame, group: str, order: str, text: str, k: int = 5) -> DataFrame:
    """order, previous and similarity of each text with the one before it in its group. Only neighbours are compared;
    each text is cut into shingles once, before the shuffle, and the group's sets pass a window of one row, so no group
    is held as a whole."""
    line = Window.partitionBy(group).orderBy(order)
    sets = docs.select(group, order, shingles(F.col(text), k).alias("_now"))
    before = sets.select(order, "_now", F.lag(order).over(line).alias("previous"), F.lag("_now").over(line).alias("_before"))
    return before.filter("previous IS NOT NULL").select(order, "previous", jaccard(F.col("_now"), F.col("_before")).alias("similarity"))


def context_windows(docs: DataFrame, key: str, text: str, pattern: str, width: int = 500) -> DataFrame:
    """key, start (from 0), hit and context: each match of pattern with up to width characters on either side."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    found = docs.filter(F.col(text).rlike(pattern)).select(key, text, F.posexplode(hits).alias("_k", "hit"), gaps.alias("_g"), hits.alias("_h"))
    size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    placed = found.withColumn("start", size(F.col("_g"), F.col("_k") + 1) + size(F.col("_h"), F.col("_k")))
    low = F.greatest(F.lit(0), F.col("start") - width)
    context = F.substr(F.col(text), low + 1, F.col("start") - low + F.length("hit") + width)
    return placed.select(key, "start", "hit", context.alias("context"))


def near(text: Column, first: str, second: str, gap: int) -> Column:
    """Whether first is followed by second within gap characters of the lower-cased text with blanks collapsed."""
    flat = F.regexp_replace(F.lower(text), r"[ \n\t\r]+", " ")
    return F.coalesce(flat.rlike(f"(?:{first}).{{0,{gap}}}(?:{second})"), F.lit(False))


def unexplained(figure: str, explanation: str, window: int):
    """A function of a text column: array<struct<start, stop>> of the matches of figure, in code points, that have no
    whole match of explanation, in any case, within window characters of them. Each figure is judged by its own window:
    places of both are in order, so one walk over them is enough. A null or empty text has none."""
    figures, reasons = re.compile(figure), re.compile(explanation, re.IGNORECASE)

    def one(text: str | None) -> list[dict[str, int]]:
        spans = [(m.start(), m.end()) for m in reasons.finditer(text or "")]
        found, k = [], 0
        for m in figures.finditer(text or ""):
            while k < len(spans) and spans[k][0] < m.start() - window:
                k += 1
            if k == len(spans) or spans[k][1] > m.end() + window:
                found.append({"start": m.start(), "stop": m.end()})
        return found

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None)

    return run
