"""Structured Streaming: idempotent ingest, late rows, sinks in their order, obligations and chain heads with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unique_rows(stream: DataFrame, key: list[str], at: str, lateness: str) -> DataFrame:
    """The first row of each key; state is kept for as long as rows may come late."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, at: str, lateness: str, length: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by key and event-time window, each given once the watermark has passed it."""
    grouped = stream.withWatermark(at, lateness).groupBy(F.window(at, length).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def split_late(batch: DataFrame, at: str, known_from: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that became known only after the time that they take effect; Spark's watermark would drop
    these silently, so they get their own output."""
    late = F.coalesce(F.col(known_from) > F.col(at), F.lit(True))
    return batch.filter(~late), batch.filter(late)


def keyed_insert(target: str, key: str):
    """A foreachBatch function that appends the rows whose key the Parquet table at target does not have, one for each
    key; a batch that is replayed adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    return write


def obligations(stream: DataFrame, key: str, kind: str, quantity: str, at: str, lateness: str, term_seconds: int) -> DataFrame:
    """key, open and status of each key after each batch: rows of kind 'due' add to what is owed, rows of kind 'fill' take
    off it. The balance is signed, so a fill that comes before its due row counts and the order of rows does not matter;
    a key whose balance is zero has no state, as if it had never been seen.
    open is never below zero. status is settled, open or, once the watermark is term_seconds past the earliest due row
    since the key was last settled, overdue; a key that no row reaches any more is reported then by its timer. Rows with
    a null quantity count for nothing."""

    def step(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owed, first = state.get if state.exists else (0.0, None)
        for frame in frames:
            due = frame[kind] == "due"
            owed += float(frame[quantity].where(due, -frame[quantity]).sum())
            if due.any():
                since = int(frame.loc[due, at].min().timestamp() * 1000)
                first = since if first is None else min(first, since)
        first = None if owed <= 0 else first
        limit = None if first is None else first + term_seconds * 1000
        now = state.getCurrentWatermarkMs()
        if owed == 0:
            state.remove()
        else:
            state.update((owed, first))
            if limit is not None and limit > now:
                state.setTimeoutTimestamp(limit)
        status = "settled" if owed <= 0 else "overdue" if limit is not None and limit <= now else "open"
        yield pd.DataFrame({key: [group[0]], "open": [max(0.0, owed)], "status": [status]})

    schema = f"{key} {dict(stream.dtypes)[key]}, open double, status string"
    grouped = stream.withWatermark(at, lateness).groupBy(key)
    return grouped.applyInPandasWithState(step, schema, "owed double, first long", "update", GroupStateTimeout.EventTimeTimeout)


def chain_heads(stream: DataFrame, key: str, seq: str, before: str, digest: str) -> DataFrame:
    """key, head_seq, head and broken of each key's chain after each batch. A row links if its number follows the head's
    and its before is the head's digest (any first row links); broken counts the rows that don't, which leave the head
    where it is. Rows of a batch are taken by their number, whatever order they come in."""

    def step(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, head, broken = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values(seq)
        for n, b, d in zip(rows[seq].tolist(), rows[before].tolist(), rows[digest].tolist()):
            if last is None or (n == last + 1 and b == head):
                last, head = n, d
            else:
                broken += 1
        state.update((last, head, broken))
        yield pd.DataFrame({key: [group[0]], "head_seq": [last], "head": [head], "broken": [broken]})

    schema = f"{key} {dict(stream.dtypes)[key]}, head_seq long, head string, broken long"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "head_seq long, head string, broken long", "update", GroupStateTimeout.NoTimeout)


def latest_for(stream: DataFrame, key: str, value: str, at: str, lateness: str, keep_seconds: int) -> DataFrame:
    """key, value and live: the value of the latest row of each key after each batch, held for keep_seconds of event time
    after it; then one row with a null value and live false tells that it is gone, and its state goes."""
    kind = dict(stream.dtypes)

    def step(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [group[0]], value: [None], "live": [False]})
            return
        held = state.get if state.exists else (None, -1)
        for frame in frames:
            row = frame.loc[frame[at].idxmax()]
            held = max(held, (row[value], int(row[at].timestamp() * 1000)), key=lambda x: x[1])
        if held[1] + keep_seconds * 1000 > state.getCurrentWatermarkMs():
            state.update(held)
            state.setTimeoutTimestamp(held[1] + keep_seconds * 1000)
            yield pd.DataFrame({key: [group[0]], value: [held[0]], "live": [True]})

    grouped = stream.withWatermark(at, lateness).groupBy(key)
    schema = f"{key} {kind[key]}, {value} {kind[value]}, live boolean"
    return grouped.applyInPandasWithState(step, schema, f"{value} {kind[value]}, at long", "update", GroupStateTimeout.EventTimeTimeout)


def first_sink(sinks: list[tuple[str, Callable[[DataFrame, int], None] | None]], log: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to the first sink of the list that is configured (not None), and to
    log where none is. A sink that fails fails the batch, named: its rows go to no other sink, they come again."""

    def write(batch: DataFrame, number: int) -> None:
        name, sink = next(((n, s) for n, s in sinks if s is not None), ("log", log))
        try:
            sink(batch, number)
        except Exception as e:
            raise RuntimeError(f"sink {name} failed on batch {number}") from e

    return write


def json_log(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps each batch as JSON lines with stored false, in a folder of its own that a
    replay writes again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("stored", F.lit(False)).write.mode("overwrite").json(f"{path}/batch={number}")

    return write
