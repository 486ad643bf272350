"""Keyed tables as DataFrames: built from change streams, read and changed in bulk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.times import duration_ms, millis
from tideloom.operators.ordered import Running, Slicing, plan_slices, ranked, running
from tideloom.operators.panes import AnyOf, Count, Repeat, SinceFirst, segments


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last change per key: an aggregate with a map-side part, so a hot key shuffles one row per task."""
    rest = [c for c in changes.columns if c not in keys]
    return (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*changes.columns)
    )


def materialise(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column | None = None
) -> DataFrame:
    """Table content after all changes: latest per key, null keys ignored, deleted entries left out."""
    kept = changes
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    if deleted is None:
        return latest(kept, keys, order)
    flagged = kept.withColumn("_gone", F.coalesce(deleted, F.lit(False)))
    return latest(flagged, keys, order).filter(~F.col("_gone")).drop("_gone")


def get_all(table: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of the wanted keys; missing keys are left out."""
    return table.join(wanted.select(*keys), list(keys), "left_semi")


def delete_all(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys), list(keys), "left_anti")


def put_all(table: DataFrame, entries: DataFrame, keys: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """Upsert one row per key of ``entries``; rows flagged ``deleted`` remove their key."""
    kept = entries if deleted is None else entries.filter(~F.coalesce(deleted, F.lit(False)))
    return delete_all(table, entries, keys).unionByName(kept.select(*table.columns))


def key_range(table: DataFrame, key: str, lo, hi, descending: bool = False) -> DataFrame:
    """Entries with lo <= key < hi in key order. The bounds reach the scan."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    return table.filter((F.col(key) >= lo) & (F.col(key) < hi)).orderBy(order)


def all_sorted(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(key)


def alive(table: DataFrame, ts: str, ttl: str, now_ms: Column) -> DataFrame:
    """Entries written less than ``ttl`` before ``now_ms``."""
    return table.filter(millis(ts) > now_ms - duration_ms(ttl))


def series_range(
    series: DataFrame, keys: Sequence[str], ts: str, tie: str, start, end, limit: int | None = None
) -> DataFrame:
    """Messages with start <= ts < end, at most ``limit`` per key, oldest first.

    Spark keeps only the first ``limit`` rows per key on the map side (window group limit).
    """
    ranged = series.filter((F.col(ts) >= start) & (F.col(ts) < end))
    if limit is None:
        return ranged
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ts, tie))
    return ranged.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def series_remove(series: DataFrame, key: str, ts: str, start, end, of: Column) -> DataFrame:
    """The series without the messages of [start, end) for the keys that ``of`` selects."""
    hit = of & (F.col(ts) >= start) & (F.col(ts) < end)
    return series.filter(~F.coalesce(hit, F.lit(False)))


def side_input(
    messages: DataFrame, process: Callable[[DataFrame], DataFrame], keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """A table filled from another stream. ``process`` maps messages to entries (any number of them)
    with the columns ``keys``, ``order`` and ``value``; a null value deletes."""
    return materialise(process(messages), keys, order, F.col("value").isNull())


def batches(
    operations: DataFrame, source: Sequence[str], order: Sequence[str], size: int, slicing: Slicing | None = None
) -> DataFrame:
    """Add ``batch_no``: ``size`` consecutive operations of each source form one batch (all are kept)."""
    if slicing is None:
        slicing = plan_slices(operations, order[0])
    return (
        ranked(operations, source, order, "_rn", slicing)
        .withColumn("batch_no", F.floor((F.col("_rn") - 1) / size))
        .drop("_rn")
    )


def timed_batches(
    operations: DataFrame,
    source: Sequence[str],
    ts: str,
    tie: str,
    size: int,
    delay: str,
    flush_every: str = "1 minute",
    slicing: Slicing | None = None,
) -> DataFrame:
    """Batches closed by size, by ``delay`` after their first operation, or by the periodic flush.

    Adds ``flush_no`` (the flush interval, epoch aligned) and ``batch_no`` inside it.
    """
    clocked = operations.withColumn("_ms", millis(ts))
    if slicing is None:
        slicing = plan_slices(clocked, "_ms")
    flushed = clocked.withColumn("flush_no", F.floor(F.col("_ms") / duration_ms(flush_every)))
    closing = Repeat(AnyOf((Count(size), SinceFirst(delay))))
    return (
        segments(flushed, [*source, "flush_no"], tie, closing, slicing)
        .withColumnRenamed("segment", "batch_no")
        .drop("_ms")
    )


def compact(batched: DataFrame, source: Sequence[str], key: str, order: Sequence[str], is_query: Column) -> DataFrame:
    """Per batch the first query and the last update of each key. A batch is bounded by its size."""
    group = [*source, "batch_no", key]
    rest = [c for c in batched.columns if c not in group]
    row, place = F.struct(*rest), F.struct(*order)
    picked = batched.groupBy(*group).agg(
        F.min_by(row, F.when(is_query, place)).alias("_q"),
        F.max_by(row, F.when(~is_query, place)).alias("_u"),
    )
    return (
        picked.select(*group, F.explode(F.array("_q", "_u")).alias("_row"))
        .filter(F.col("_row").isNotNull())
        .select(*group, "_row.*")
    )


def versioned_actions(
    requests: DataFrame, ident: str, version: str, order: Sequence[str], slicing: Slicing | None = None
) -> DataFrame:
    """Bulk upsert with external versions: what each request does to its document.

    insert = first request of the id, update = a version above all earlier ones, conflict = otherwise
    (counted, not an error).
    """
    if slicing is None:
        slicing = plan_slices(requests, order[0])
    seen = running(requests, [ident], order, {"_best": Running("max", version, before=True)}, slicing)
    action = (
        F.when(F.col("_best").isNull(), "insert").when(F.col(version) > F.col("_best"), "update").otherwise("conflict")
    )
    return seen.withColumn("action", action).drop("_best")
