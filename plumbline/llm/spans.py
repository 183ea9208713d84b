"""Places of pattern matches and rewriting of the matches, with Spark's own functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,stop:bigint,found:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, found>> of the leftmost non-overlapping matches of pattern, none of them empty, in
    code points. split() gives the gaps between the matches, whose lengths add up to the places."""
    none = F.array().cast(SPAN)

    def placed(gaps: Column, found: Column) -> Column:
        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["gap"])
            stop = start + F.length(pair["hit"])
            span = F.struct(start.alias("start"), stop.alias("stop"), pair["hit"].alias("found"))
            return F.struct(stop.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
        zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        wide = lambda s, p: step(s, p).cast(f"struct<at:bigint,out:{SPAN}>")
        return F.aggregate(pairs, zero, wide)["out"]

    both = bound(
        F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits")),
        lambda x: placed(x["gaps"], x["hits"]),
    )
    return F.when(text.rlike(pattern), both).otherwise(none)


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with each match m of pattern (none of them empty) replaced by change(m)."""
    changed = bound(
        F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits")),
        lambda x: F.concat(
            F.array_join(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), F.transform(x["hits"], change), lambda g, c: F.concat(g, c)), ""),
            F.element_at(x["gaps"], -1),
        ),
    )
    return F.when(text.rlike(pattern), changed).otherwise(text)
