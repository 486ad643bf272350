"""Exact percentiles, distribution snapshots, latencies and counters."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.times import col, duration_ms, millis, window_start
from tideloom.operators.chains import Limits, starts
from tideloom.operators.ordered import Running, Slicing, plan_slices, running, settle


def cents(value) -> Column:
    """An amount with two decimals as a BIGINT of hundredths: exact and order-free to sum."""
    return F.floor(col(value) * 100 + 0.5).cast("bigint")


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ps: dict[str, float],
    slicing: Slicing | None = None,
) -> DataFrame:
    """Exact discrete percentiles of a numeric column per group: the smallest value whose share is >= p.

    The groups are reduced to (value, count) first and the counts summed up along the value axis in
    slices, so no task ever holds the values of a whole group, which a percentile buffer would.
    """
    if slicing is None:
        slicing = plan_slices(df, value)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = _placed(counts, by, value, slicing)
    return placed.groupBy(*by).agg(*_picks(value, ps))


def _placed(counts: DataFrame, by: Sequence[str], value: str, slicing: Slicing) -> DataFrame:
    """Add to every (group, value, _n) the rows up to it and the rows of its group."""
    counts = settle(counts, slicing)
    summed = running(counts, by, [value], {"_upto": Running("sum", "_n")}, slicing)
    if not slicing.cuts:
        return summed.withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    if not by:
        return summed.withColumn("_all", totals.scalar())
    same = [F.col(f"l.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by]
    return summed.alias("l").join(totals.alias("t"), same).select("l.*", "t._all")


def _picks(value: str, ps: dict[str, float]) -> list[Column]:
    # the share as the decimal it is written as: 0.07 of 100 is 7, which doubles miss
    share = lambda p: F.lit(Decimal(str(p)))
    return [F.min(F.when(F.col("_upto") >= F.col("_all") * share(p), F.col(value))).alias(n) for n, p in ps.items()]


def snapshot(
    df: DataFrame, ts: str, size: str, slide: str, value: str, ps: dict[str, float], slicing: Slicing | None = None
) -> DataFrame:
    """min, max, avg, sum, size and percentiles of ``value`` per sliding time window.

    Rows are counted per (slide, value) before each slide is copied into the windows that cover it.
    """
    if slicing is None:
        slicing = plan_slices(df, value)
    step = duration_ms(slide)
    copies = duration_ms(size) // step
    cells = (
        df.filter(F.col(value).isNotNull())
        .groupBy(window_start(millis(ts), slide).alias("_cell"), value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    offsets = F.sequence(F.lit(0), F.lit(copies - 1))
    spread = cells.select(
        F.explode(F.transform(offsets, lambda i: F.col("_cell") - i * step)).alias("pane_id"), value, "_n"
    )
    counts = spread.groupBy("pane_id", value).agg(F.sum("_n").alias("_n"))
    return (
        _placed(counts, ["pane_id"], value, slicing)
        .groupBy("pane_id")
        .agg(
            F.min(value).alias("min_v"),
            F.max(value).alias("max_v"),
            F.sum(F.col(value) * F.col("_n")).alias("sum_v"),
            F.sum("_n").alias("size_v"),
            *_picks(value, ps),
        )
        .withColumn("avg_v", F.col("sum_v") / F.col("size_v"))
    )


def latencies(df: DataFrame, event: str, arrival: str, scan: str, output: str, by: Sequence[str] = ()) -> DataFrame:
    """Queueing, query and total latency in ms from four clock columns (epoch ms)."""
    return df.groupBy(*by).agg(
        F.sum(F.col(scan) - F.col(arrival)).alias("queueing_ms"),
        F.sum(F.col(output) - F.col(scan)).alias("query_ms"),
        F.sum(F.col(output) - F.col(event)).alias("total_ms"),
        F.max(F.col(output) - F.col(event)).alias("max_total_ms"),
        F.count(F.lit(1)).alias("n"),
    )


def counters(df: DataFrame, predicate: Column) -> DataFrame:
    """Input, output and filtered-out counts of a filter. A null predicate filters out."""
    passed = F.count_if(F.coalesce(predicate, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("n_in"), passed.alias("n_out")).withColumn(
        "n_filtered", F.col("n_in") - F.col("n_out")
    )


def observed_filter(df: DataFrame, predicate: Column, observation) -> DataFrame:
    """``df.filter`` that fills ``observation`` with the same counters while some action runs."""
    passed = F.count_if(F.coalesce(predicate, F.lit(False)))
    return df.observe(observation, F.count(F.lit(1)).alias("n_in"), passed.alias("n_out")).filter(predicate)


def throttled_counts(
    df: DataFrame, key: str, ts: str, size: str, timeout: str, slicing: Slicing | None = None
) -> DataFrame:
    """Running count per (key, tumbling window), put out when more than ``timeout`` has passed since the
    last output. The first message of a window is put out at once.

    Every output depends on the one before: they are the starts of a chain of segments.
    """
    clocked = df.select(key, millis(ts).alias("_ms")).withColumn("pane_id", window_start("_ms", size))
    if slicing is None:
        slicing = plan_slices(clocked, "_ms")
    chain = starts(clocked, [key, "pane_id"], Limits(age=duration_ms(timeout) + 1, repeat=True), slicing)
    return chain.select(key, "pane_id", F.col("_ms").alias("emitted_ms"), F.col("_rn").alias("n"))
