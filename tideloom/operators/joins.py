"""Stream and table joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.times import duration_ms, millis
from tideloom.operators.ordered import Running, Slicing, plan_slices, running

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``F.broadcast(df)`` after measuring that ``df`` stays below both bounds, else ``df`` unchanged.

    The measurement reads at most ``max_rows + 1`` rows. An unchanged side is joined by a shuffle,
    where adaptive execution splits skewed keys.
    """
    size = (
        df.limit(max_rows + 1)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b"),
        )
        .first()
    )
    return F.broadcast(df) if size["n"] <= max_rows and size["b"] <= max_bytes else df


def table_join(stream: DataFrame, table: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Stream-table join. ``how='left'`` is a join function that accepts a missing record.

    A null key matches nothing. A small table is broadcast, beyond that both sides are shuffled.
    """
    return stream.join(broadcast_if_small(table), on, how)


def _clocked(df: DataFrame, key: str, ts: str, tie: str, payload: Sequence[str], name: str) -> DataFrame:
    return df.select(
        F.col(key).alias("_key"),
        millis(ts).alias("_ms"),
        F.col(tie).alias("_tie"),
        F.struct(*payload).alias(name),
    )


def ttl_join(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    ts: str,
    tie: str,
    ttl: str,
    left_columns: Sequence[str],
    right_columns: Sequence[str],
    slicing: Slicing | None = None,
) -> DataFrame:
    """Each side keeps only the latest message per key for ``ttl``; an arriving message of either
    side joins the latest of the other side if that is newer than now - ttl (strictly).

    At most one result per message, so the output is linear in the input: both sides are put on one
    time axis and the latest message of the other side is carried forward. No pairs are formed.
    Replayed on event time; at equal clock the left side comes first.
    """
    both = _clocked(left, key, ts, tie, left_columns, "_l").withColumn("_side", F.lit(0)).unionByName(
        _clocked(right, key, ts, tie, right_columns, "_r").withColumn("_side", F.lit(1)), allowMissingColumns=True
    ).filter(F.col("_key").isNotNull())
    if slicing is None:
        slicing = plan_slices(both, "_ms")
    return match_latest(both, duration_ms(ttl), slicing).select(
        F.col("_key").alias(key), F.col("_ms").alias("joined_ms"), "_l.*", "_r.*"
    )


def match_latest(both: DataFrame, ttl_ms: int, slicing: Slicing) -> DataFrame:
    """The matches of a tagged union: ``_key, _ms, _side`` (0 left, 1 right), ``_tie`` and the payloads ``_l, _r``."""
    carried = running(
        both,
        ["_key"],
        ["_ms", "_side", "_tie"],
        {
            "_last_l": Running("last", F.when(F.col("_l").isNotNull(), F.struct("_ms", "_l")), before=True),
            "_last_r": Running("last", F.when(F.col("_r").isNotNull(), F.struct("_ms", "_r")), before=True),
        },
        slicing,
    )
    from_left = F.col("_side") == 0
    other_ms = F.when(from_left, F.col("_last_r._ms")).otherwise(F.col("_last_l._ms"))
    return (
        carried.filter(other_ms > F.col("_ms") - ttl_ms)
        .withColumn("_l", F.when(from_left, F.col("_l")).otherwise(F.col("_last_l._l")))
        .withColumn("_r", F.when(from_left, F.col("_last_r._r")).otherwise(F.col("_r")))
        .drop("_last_l", "_last_r")
    )


def asof_join(
    stream: DataFrame,
    changes: DataFrame,
    *,
    key: str,
    ts: str,
    tie: str,
    columns: Sequence[str],
    deleted: Column | None = None,
    how: str = "left",
    slicing: Slicing | None = None,
) -> DataFrame:
    """Look up the table that ``changes`` (upserts and deletes) forms, as it was when each row passed.

    A change is visible to stream rows of the same clock tick. A row with a null key finds nothing.
    """
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    value = F.struct(F.when(~gone, F.struct(*columns)).alias("v"))
    table_rows = changes.filter(F.col(key).isNotNull()).select(
        F.col(key), millis(ts).alias("_ms"), F.col(tie).alias("_tie"), value.alias("_change"), F.lit(0).alias("_side")
    )
    stream_rows = stream.withColumns({"_ms": millis(ts), "_tie": F.col(tie), "_side": F.lit(1)})
    both = stream_rows.unionByName(table_rows, allowMissingColumns=True)
    if slicing is None:
        slicing = plan_slices(both.select("_ms"), "_ms")
    carried = running(both, [key], ["_ms", "_side", "_tie"], {"_seen": Running("last", "_change")}, slicing)
    found = carried.filter(F.col("_side") == 1)
    if how == "inner":
        found = found.filter(F.col("_seen.v").isNotNull())
    return found.select(*stream.columns, *[F.col(f"_seen.v.{c}").alias(c) for c in columns])


def interval_join(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    ts: str,
    before: str,
    after: str,
    left_columns: Sequence[str],
    right_columns: Sequence[str],
) -> DataFrame:
    """Pairs with equal key whose left clock lies in [right - before, right + after].

    Joined on (key, time bucket), so a hot key is spread over its buckets and only rows of
    neighbouring buckets are compared. Buckets are as wide as the interval: each right row is in at
    most two of them.
    """
    lo, hi = duration_ms(before), duration_ms(after)
    width = lo + hi + 1
    ls = left.select(
        F.col(key),
        millis(ts).alias("_lms"),
        *left_columns,
    ).withColumn("_bucket", F.floor(F.col("_lms") / width))
    rs = right.select(F.col(key).alias("_rkey"), millis(ts).alias("_rms"), *right_columns)
    rs = rs.withColumn(
        "_rbucket",
        F.explode(F.sequence(F.floor((F.col("_rms") - lo) / width), F.floor((F.col("_rms") + hi) / width))),
    )
    near = F.col("_lms").between(F.col("_rms") - lo, F.col("_rms") + hi)
    same = (F.col(key) == F.col("_rkey")) & (F.col("_bucket") == F.col("_rbucket")) & near
    return ls.join(rs, same).select(key, *left_columns, *right_columns)


def band_join(df: DataFrame, bands: DataFrame, value: str, lo: str, hi: str, width: int) -> DataFrame:
    """Theta join ``lo <= value < hi`` as an equi-join, not a nested loop, whatever the lengths of the bands.

    Bins come in levels, each of twice the width of the one below, the lowest of ``width``. A band is listed on the first level
    whose bins are as long as it is, so in two bins at most; a value is looked up once on every level that has bands. Their
    numbers, at most 64, are all that comes to the driver. A bin that many values share is split as a skewed partition.
    """
    levels = F.greatest(F.ceil(F.log2((F.col(hi) - F.col(lo)) / width)), F.lit(0)).cast("int")
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    placed = bands.filter(F.col(lo) < F.col(hi)).withColumn("_band_level", levels)
    used = sorted(row[0] for row in placed.select("_band_level").distinct().collect())
    first, last = (F.floor(F.col(c) / size(F.col("_band_level"))) for c in (lo, hi))
    listed = placed.withColumn("_band_bin", F.explode(F.sequence(first, last)))
    probes = df.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    probes = probes.withColumn("_bin", F.floor(F.col(value) / size(F.col("_level"))))
    inside = (F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))
    same = (F.col("_level") == F.col("_band_level")) & (F.col("_bin") == F.col("_band_bin"))
    return probes.join(listed, same & inside).drop("_level", "_bin", "_band_level", "_band_bin")
