"""Point-in-time joins: as-of, interval cover, coverage sweep, precedence, nearest quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals, ordered


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, known: str, value: str, into: str) -> DataFrame:
    """left with column into: the value of the right row of the same key with the latest time known that is not after at.

    Both sides are put in one line by key and time and the last value is carried forward, so a key with many rows on
    both sides is sorted once, not joined row by row. A right row at the very time counts; ties take the larger value.
    """
    lines = left.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    marks = right.select(F.col(key), F.col(known).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    line = Window.partitionBy(key).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = lines.unionByName(marks, allowMissingColumns=True).withColumn(into, F.last("_v", ignorenulls=True).over(line))
    return both.filter("_side = 1").drop("_t", "_side", "_v")


def once(rows: DataFrame) -> DataFrame:
    """The distinct rows with _times, how often each is there, so that repeated rows are not taken for one another's
    matches."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_times"))


def repeated(rows: DataFrame) -> DataFrame:
    """The rows as often as _times says."""
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("_times")


def cover(needs: DataFrame, quotes: DataFrame, key: str, need: tuple[str, str], valid: tuple[str, str]) -> DataFrame:
    """needs with n_quotes, the number of quotes of the key that cover the whole half-open need, and status: covered if
    that is one, else missing or ambiguous. A need meets the quotes in its start's cells of a grid, so a key with many
    rows on both sides is no cross of them. A need or quote without a key or an end covers nothing and is not covered."""
    q = quotes.select(F.col(key).alias("_key"), F.col(valid[0]).alias("_since"), F.col(valid[1]).alias("_until"))
    whole = (F.col("_since") <= F.col(need[0])) & (F.col("_until") >= F.col(need[1]))
    joined = intervals.stabbed(once(needs), need[0], q, "_since", "_until", {key: "_key"}, whole)
    out = repeated(joined.groupBy(*needs.columns, "_times").agg(F.count("_since").alias("n_quotes")))
    return out.withColumn("status", F.when(F.col("n_quotes") == 1, "covered").when(F.col("n_quotes") == 0, "missing").otherwise("ambiguous"))


def known_as_of(left: DataFrame, right: DataFrame, key: str, at: str, effective: str, available: str, value: str, into: str, mark: str = "future_known") -> DataFrame:
    """left with into, the value of the right row of its key that is both in effect and available at its time, with the
    latest effective time (ties: the later available, then the larger value), and mark: whether a row of the key was
    known before that time but takes effect only after it, which a caller may have to fail on.

    A right row counts from the later of its two times on; what is then the latest in effect is a running maximum, so a
    key with many rows on both sides is sorted once, not joined row by row.
    """
    marks = right.filter(F.col(effective).isNotNull() & F.col(available).isNotNull()).select(
        F.col(key), F.greatest(effective, available).alias("_t"), F.lit(0).alias("_side"),
        F.struct(F.col(effective).alias("e"), F.col(available).alias("a"), F.col(value).alias("v")).alias("_v"),
        F.when(F.col(effective) > F.col(available), 1).otherwise(0).alias("_ahead"),
    )
    # from its availability on a row that is not in effect yet is known ahead, until it takes effect
    ahead = right.filter(F.col(effective) > F.col(available)).select(F.col(key), F.col(available).alias("_t"), F.lit(0).alias("_side"), F.lit(-1).alias("_ahead"))
    lines = left.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1))
    both = lines.unionByName(marks, allowMissingColumns=True).unionByName(ahead, allowMissingColumns=True)
    line = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(into, F.max("_v").over(line)["v"]).withColumn(mark, F.coalesce(F.sum("_ahead").over(line), F.lit(0)) < 0)
    return found.filter("_side = 1").drop("_t", "_side", "_v", "_ahead")


def sweep(spans: DataFrame, key: str, start: str, stop: str, available: str | None = None) -> DataFrame:
    """The stretches between consecutive boundaries of each key's half-open spans, with depth, the number of spans over
    each: key, start, stop, depth. Depth 0 is a gap; stretches add up to the whole from first start to last stop.

    With available, the time from which a span is known, that is a boundary too where it falls inside the span, and
    seen counts the spans over a stretch that are known by then; one without such a time is never known.
    """
    edge = lambda at, step, seen: F.struct(at.alias("start"), F.lit(step).alias("step"), F.lit(seen).alias("seen"))
    since, until = F.col(start), F.col(stop)
    edges = [edge(since, 1, 0), edge(until, -1, 0)]
    if available:
        known = F.col(available) < until
        edges += [F.when(known, edge(F.greatest(since, F.col(available)), 0, 1)), F.when(known, edge(until, 0, -1))]
    steps = spans.select(F.col(key), F.inline(F.array_compact(F.array(*edges)))).groupBy(key, "start").agg(F.sum("step").alias("step"), F.sum("seen").alias("seen"))
    line = Window.partitionBy(key).orderBy("start")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.sum("step").over(so_far).alias("depth")] + ([F.sum("seen").over(so_far).alias("seen")] if available else [])
    return steps.select(key, "start", F.lead("start").over(line).alias("stop"), *counts).filter("stop IS NOT NULL")


def coverage_label(depth: Column, seen: Column) -> Column:
    """What holds over a stretch of a sweep."""
    return F.when(depth == 0, "no_effective_status").when(seen == 0, "status_not_yet_available").otherwise("covered")


def by_precedence(rows: DataFrame, key: list[str], rank: Column, available: Column) -> DataFrame:
    """Of each key the most specific row (least rank) that is in effect, and whether it was available: one that was not
    does not fall back to a less specific row."""
    order = Window.partitionBy(*key).orderBy(rank)
    first = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return first.withColumn("usable", F.coalesce(available, F.lit(False)))


def reconcile(official: DataFrame, vendor: DataFrame, key: list[str], fields: list[str], times: list[str] = ()) -> DataFrame:
    """key, status and differing: the names of the fields in which the two sides disagree, nulls being equal. Keys of one
    side only have status official_only or vendor_only. Of each of times, when a side observed or had the row, the later
    one of both is kept: a reconciled row is not known before."""
    a = official.select(*key, F.struct(*fields, *times).alias("_a"))
    b = vendor.select(*key, F.struct(*fields, *times).alias("_b"))
    both = a.join(b, key, "full_outer")
    unlike = F.array_compact(F.array(*(F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields)))
    status = (
        F.when(F.col("_b").isNull(), "official_only").when(F.col("_a").isNull(), "vendor_only").when(F.size(unlike) == 0, "agree").otherwise("differ")
    )
    named = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), unlike).otherwise(F.array().cast("array<string>"))
    later = [F.greatest(f"_a.{t}", f"_b.{t}").alias(t) for t in times]
    return both.select(*key, status.alias("status"), F.array_join(named, ",").alias("differing"), *later)


def first_after_last_before(marks: DataFrame, quotes: DataFrame, key: str, at: str, time: str, value: str, wait: str, stale: str) -> DataFrame:
    """marks with entry, the value of the first quote within wait after at (at it included), and exit, that of the last
    quote within stale before at (at it included); null where there is none. Of quotes at one time the smaller value is
    first and the larger last.

    Marks and quotes are put in one order and the nearest quote is carried to each mark, from part to part of the
    order, so no pairs are made and no key must be in one task.
    """
    q = quotes.filter(F.col(time).isNotNull()).select(F.col(key), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_q"))
    lines = marks.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1)).unionByName(q, allowMissingColumns=True)
    place = F.col("_q")["v"]
    before = ordered.carried(lines, ["_t", "_side", place.asc_nulls_first()], "_q", "_exit", [key])
    both = ordered.carried(before, [F.col("_t").desc(), "_side", place.desc_nulls_first()], "_q", "_entry", [key]).filter("_side = 1")
    late, early = F.col(at) + F.expr(f"INTERVAL {wait}"), F.col(at) - F.expr(f"INTERVAL {stale}")
    found = F.when(F.col(key).isNotNull() & (F.col("_entry")["t"] <= late), F.col("_entry")["v"])
    left = F.when(F.col(key).isNotNull() & (F.col("_exit")["t"] >= early), F.col("_exit")["v"])
    return both.select(*marks.columns, found.alias("entry"), left.alias("exit"))


def gaps(days: DataFrame, spine: DataFrame, key: str, day: str) -> DataFrame:
    """Days of the spine between a key's first and last day that the key does not have. day: a date; each key's days are
    counted out, so the spine is met by equality."""
    ends = days.groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi")).filter("_lo IS NOT NULL")
    every = ends.select(key, F.explode(F.sequence("_lo", "_hi")).alias(day))
    inside = every.join(spine.select(day).distinct(), day).select(key, day)
    return inside.join(days.select(key, day), [key, day], "left_anti")
