"""Rows behind the watermark as an output of their own, and facts joined with the decisions that could know them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

LATE, LATE_SO_FAR = "late", "late_so_far"


def with_late_rows(stream: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """stream with late, whether a row came more than lateness after the latest time of earlier batches, and late_so_far,
    how many rows of its key did. All rows are there, none is dropped: the operator has no event-time timeout, as one with
    it would not be given rows behind the watermark. Only keys with late rows have state, a number. A row without a time
    is not late. Columns of those names are replaced."""
    source = stream.drop(LATE, LATE_SO_FAR)

    def step(_: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        before = seen = state.get[0] if state.exists else 0
        for frame in frames:
            late = (frame[at] < mark).fillna(False)
            frame[LATE], frame[LATE_SO_FAR] = late, seen + late.cumsum()
            seen += int(late.sum())
            yield frame
        if seen != before:
            state.update((seen,))

    schema = StructType([*source.schema.fields, StructField(LATE, BooleanType()), StructField(LATE_SO_FAR, LongType())])
    grouped = source.withWatermark(at, lateness).groupBy(key)
    return grouped.applyInPandasWithState(step, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def side_outputs(on_time: str, late: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for with_late_rows(): rows in time and late ones go to Parquet tables of their own, in a
    folder for each batch, so a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for path, rows in ((on_time, held.filter(~F.col(LATE)).drop(LATE, LATE_SO_FAR)), (late, held.filter(LATE))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        held.unpersist()

    return write


def known_by(decisions: DataFrame, facts: DataFrame, key: str, decided: str, known: str, horizon: str, lateness: str, how: str = "inner") -> DataFrame:
    """Each decision with the facts of its key that were known at its time or up to horizon before it; a fact that became
    known later never joins. Both sides are streams with a watermark of lateness and the join's times have both bounds, so
    Spark drops a fact from its state once no decision can reach back to it, and a decision once no fact can come for
    it. how: inner, or leftOuter for decisions without facts too, given when their time has passed. Columns but key must have
    different names; the facts' key is left out."""
    d = decisions.withWatermark(decided, lateness)
    f = facts.withWatermark(known, lateness).withColumnRenamed(key, "_fact_key")
    near = (F.col(known) <= F.col(decided)) & (F.col(known) >= F.col(decided) - F.expr(f"INTERVAL {horizon}"))
    return d.join(f, (F.col(key) == F.col("_fact_key")) & near, how).drop("_fact_key")
