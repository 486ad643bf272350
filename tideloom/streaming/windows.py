"""Event-time windows on live streams, and the end of a bounded one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.times import duration_ms, millis
from tideloom.session import shared_folder
from tideloom.streaming.runs import run_counted


def clocked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream with an instant clock and its watermark (TIMESTAMP_NTZ cannot carry one)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(stream: DataFrame, ts: str, delay: str, size: str, aggs: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """Closed tumbling windows (append mode): a window comes out when the watermark has passed its end."""
    return (
        clocked(stream, ts, delay)
        .groupBy(*keys, F.window(ts, size).alias("_w"))
        .agg(*aggs)
        .withColumn("pane_id", millis("_w.start"))
        .drop("_w")
    )


def chained(
    stream: DataFrame, ts: str, delay: str, inner: str, outer: str, inner_agg: Column, outer_aggs: Sequence[Column],
    keys: Sequence[str],
) -> DataFrame:
    """Windows over window results: each step has its own watermark, derived from the one before."""
    first = clocked(stream, ts, delay).groupBy(*keys, F.window(ts, inner)).agg(inner_agg)
    return (
        first.groupBy(*keys, F.window(F.window_time("window"), outer).alias("_w"))
        .agg(*outer_aggs)
        .withColumn("pane_id", millis("_w.start"))
        .drop("_w")
    )


def sessions(stream: DataFrame, ts: str, delay: str, gap: str, aggs: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """Closed sessions (append mode)."""
    return (
        clocked(stream, ts, delay)
        .groupBy(*keys, F.session_window(ts, gap).alias("_w"))
        .agg(*aggs)
        .withColumn("pane_id", millis("_w.start"))
        .drop("_w")
    )


def interval_join(
    left: DataFrame, right: DataFrame, *, key: str, ts: str, delay: str, within: str, left_id: str, right_id: str
) -> DataFrame:
    """Pairs of a key whose right clock is at most ``within`` after the left one: Spark's stream-stream
    join, with state that the time bound lets go.

    Joined on (key, time bucket): a hot key is spread over its buckets. A right message is listed in the
    two buckets that its partners can be in.
    """
    width = duration_ms(within)

    def side(df: DataFrame, ident: str, prefix: str) -> DataFrame:
        timed = clocked(df, ts, delay)
        return timed.select(F.col(key).alias(f"{prefix}key"), F.col(ts).alias(f"{prefix}ts"), F.col(ident),
                            F.floor(millis(ts) / width).alias(f"{prefix}bucket"))

    ls, rs = side(left, left_id, "_l"), side(right, right_id, "_r")
    rs = rs.withColumn("_rbucket", F.explode(F.array(F.col("_rbucket") - 1, F.col("_rbucket"))))
    near = F.expr(f"_rts >= _lts AND _rts <= _lts + INTERVAL {width} MILLISECONDS")
    same = (F.col("_lkey") == F.col("_rkey")) & (F.col("_lbucket") == F.col("_rbucket"))
    return ls.join(rs, same & near).select(F.col("_lkey").alias(key), left_id, right_id)


def deduplicated(stream: DataFrame, ts: str, delay: str, ident: Sequence[str]) -> DataFrame:
    """Each message once, as long as its copies come within the watermark delay."""
    return clocked(stream, ts, delay).dropDuplicatesWithinWatermark(list(ident))


#: The clock of the row that ends a stream: later than any of its messages less the watermark delay.
END = "9999-01-01 00:00:00"


def run_to_end(
    source: DataFrame, ts: str, name: str, plan: Callable[[DataFrame], DataFrame], folder: str | None = None
) -> tuple[DataFrame, int]:
    """Run ``plan(stream)`` over a bounded ``source``; at its end every open window comes out. The output table, and how
    many rows the stream took in.

    The stream is the source with a second, empty one. When the source has been read to its end, the second one gives one
    row with the clock :data:`END`: the same query goes on from its checkpoint, the watermark passes all messages, and the
    windows still open come out of the state. The input is read once. The closing row has nulls elsewhere, and its own
    window stays open. A run that was interrupted goes on in its ``folder``; a second closing row changes nothing.
    """
    spark = source.sparkSession
    folder = folder or shared_folder(spark, name)
    closing = f"{folder}/closing"
    clock = source.schema[ts]
    marker = spark.range(1).select(F.lit(END).cast(clock.dataType).alias(ts))
    marker.limit(0).write.mode("append").parquet(closing)
    ends = spark.readStream.schema(marker.schema).parquet(closing)
    whole = plan(source.unionByName(ends, allowMissingColumns=True))
    _, rows = run_counted(whole, name, folder)
    marker.write.mode("append").parquet(closing)
    out, more = run_counted(whole, name, folder)
    return out, rows + more
