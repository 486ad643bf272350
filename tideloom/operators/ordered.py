"""Running values over ordered groups, without putting a whole group into one task.

``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one task. With one key holding
a third of all rows that task never ends. Here the order axis is cut into slices of about equal row
count (quantiles of the order column), and the work is done per (group, slice):

1. each (group, slice) is reduced to one summary row, combined on the map side;
2. the summaries of a group, at most one per slice, are turned into prefix values;
3. every prefix is put as a seed row in front of its slice, and an ordinary window function runs
   inside (group, slice).

A (group, slice) never holds more rows than the slice holds over all groups, so its size is bounded
by rows / slices whatever the key distribution is. Rows with equal order value stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.times import col
from tideloom.session import shared_folder

ROWS_PER_SLICE = 1_000_000
MAX_SLICES = 16_384


@dataclass(frozen=True)
class Slicing:
    """Interior cut points of a numeric order column. No cut points means one slice."""

    cuts: tuple[float, ...] = ()

    def tag(self, df: DataFrame, column: str, out: str) -> DataFrame:
        if not self.cuts:
            return df.withColumn(out, F.lit(0))
        from pyspark.ml.feature import Bucketizer

        raw = f"{out}_raw"
        tagger = Bucketizer(
            splits=[-math.inf, *self.cuts, math.inf], inputCol=raw, outputCol=out, handleInvalid="keep"
        )
        tagged = tagger.transform(df.withColumn(raw, F.col(column).cast("double")))
        return tagged.withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(-1))).drop(raw)


def plan_slices(df: DataFrame, column: str, rows_per_slice: int | None = None, least: int = 1) -> Slicing:
    """Cut the numeric ``column`` into slices of about ``rows_per_slice`` rows, into ``least`` of them at least.

    Takes a row count (parquet footers only, for a plain scan) and, above one slice, one sketch of
    the column. Only the cut points, at most :data:`MAX_SLICES`, come back to the driver.
    """
    if rows_per_slice is None:
        rows_per_slice = int(df.sparkSession.conf.get("spark.tideloom.rowsPerSlice", str(ROWS_PER_SLICE)))
    rows = df.count()
    n = min(max(math.ceil(rows / rows_per_slice), min(least, rows)), MAX_SLICES)
    if n <= 1:
        return Slicing()
    points = df.select(F.col(column).cast("double").alias("x")).approxQuantile(
        "x", [i / n for i in range(1, n)], 0.25 / n
    )
    return Slicing(tuple(sorted(set(points))))


@dataclass(frozen=True)
class Running:
    """One running value. ``before`` leaves the current row out."""

    kind: str  # last | sum | count | max | min
    value: Column | str | None = None
    before: bool = False


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, Running],
    slicing: Slicing | None = None,
) -> DataFrame:
    """Add one running column per entry of ``outputs``, in ``order`` inside each ``by`` group.

    ``order[0]`` has to be numeric: it is the column that ``slicing`` cuts. The order should be
    total, or ties make the result ambiguous. ``count`` before the first row is 0, other kinds null.
    """
    slicing = slicing or Slicing()
    tagged = df.withColumns({f"_in_{name}": _input(spec) for name, spec in outputs.items()})
    if slicing.cuts:
        tagged = _seeded(slicing.tag(tagged, order[0], "_slice"), by, order, outputs)
        base = Window.partitionBy(*by, "_slice").orderBy(F.col("_seed").desc(), *order)
    else:
        base = Window.partitionBy(*by).orderBy(*order)
    result = tagged.withColumns(_outputs(outputs, base))
    if slicing.cuts:
        result = result.filter(~F.col("_seed")).drop("_seed", "_slice")
    return result.drop(*[f"_in_{name}" for name in outputs])


def _input(spec: Running) -> Column:
    return F.lit(1).cast("bigint") if spec.kind == "count" else col(spec.value)


def _outputs(outputs: dict[str, Running], base) -> dict[str, Column]:
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = base.rowsBetween(Window.unboundedPreceding, -1)
    columns = {}
    for name, spec in outputs.items():
        value = _over(spec.kind, F.col(f"_in_{name}"), earlier if spec.before else upto)
        columns[name] = F.coalesce(value, F.lit(0)) if spec.kind == "count" else value
    return columns


def _reduce(name: str, kind: str, order) -> Column:
    value = F.col(f"_in_{name}")
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind](value)


def _seeded(tagged: DataFrame, by, order, outputs: dict[str, Running]) -> DataFrame:
    summary = tagged.groupBy(*by, "_slice").agg(
        *[_reduce(name, spec.kind, order).alias(f"_in_{name}") for name, spec in outputs.items()]
    )
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    seeds = summary.select(
        *by,
        "_slice",
        *[_over(spec.kind, F.col(f"_in_{name}"), earlier).alias(f"_in_{name}") for name, spec in outputs.items()],
        F.lit(True).alias("_seed"),
    )
    return tagged.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)


def ranked(df: DataFrame, by, order, out: str = "rn", slicing: Slicing | None = None) -> DataFrame:
    """Row number from 1 inside each group."""
    return running(df, by, order, {out: Running("count")}, slicing)


def settle(df: DataFrame, slicing: Slicing) -> DataFrame:
    """The rows written to the shared folder and read back, if the axis is cut; else ``df`` itself.

    A sliced pass reads its input twice (summaries, then rows). Between two passes the result of the
    first is therefore stored, or the work would double with every further pass.
    """
    if not slicing.cuts:
        return df
    path = shared_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def gaps(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    gap_ms: int,
    *,
    closed: bool,
    start: str | None = None,
    number: str | None = None,
    extra: dict[str, Running] | None = None,
    slicing: Slicing | None = None,
) -> DataFrame:
    """Split each group where it is silent for longer than ``gap_ms`` (``closed=False``: at least that long).

    ``order[0]`` is the clock in ms. Adds ``start``, the clock of the first row of the run, and
    ``number``, the runs before it, and the running values of ``extra``; all in one pass.
    """
    slicing = slicing or Slicing()
    extra = extra or {}
    clock = F.col(order[0])

    def broken(before) -> Column:
        silence = clock - before
        return F.coalesce((silence > gap_ms) if closed else (silence >= gap_ms), F.lit(False))

    tagged = df.withColumns({f"_in_{n}": _input(spec) for n, spec in extra.items()})
    base = Window.partitionBy(*by).orderBy(*order)
    if slicing.cuts:
        tagged = slicing.tag(tagged, order[0], "_slice")
        tagged = tagged.withColumns({"_seed": F.lit(False), "_at": F.lit(None).cast("bigint"), "_no": F.lit(None).cast("bigint")})
        tagged = tagged.unionByName(_gap_seeds(tagged, by, order, broken, extra), allowMissingColumns=True)
        base = Window.partitionBy(*by, "_slice").orderBy(F.col("_seed").desc(), *order)
    else:
        tagged = tagged.withColumns({"_seed": F.lit(False), "_at": F.lit(None).cast("bigint"), "_no": F.lit(None).cast("bigint")})
    tagged = tagged.withColumn("_prev", F.lag(order[0]).over(base))
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = ~F.col("_seed") & broken(F.col("_prev"))
    first = ~F.col("_seed") & (F.col("_prev").isNull() | broken(F.col("_prev")))
    columns = _outputs(extra, base)
    if start:
        columns[start] = F.last(F.coalesce("_at", F.when(first, clock)), ignorenulls=True).over(upto)
    if number:
        columns[number] = F.sum(F.coalesce("_no", breaks.cast("bigint"))).over(upto)
    result = tagged.withColumns(columns).filter(~F.col("_seed"))
    return result.drop("_seed", "_slice", "_at", "_no", "_prev", *[f"_in_{n}" for n in extra])


def _gap_seeds(tagged: DataFrame, by, order, broken, extra: dict[str, Running]) -> DataFrame:
    clock = order[0]
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    summary = (
        tagged.withColumn("_broken", broken(F.lag(clock).over(inside)))
        .groupBy(*by, "_slice")
        .agg(
            F.min(clock).alias("_from"),
            F.max(clock).alias("_to"),
            F.max(F.when(F.col("_broken"), F.col(clock))).alias("_start"),
            F.count_if("_broken").alias("_breaks"),
            *[_reduce(n, spec.kind, order).alias(f"_in_{n}") for n, spec in extra.items()],
        )
    )
    axis = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice")
    earlier = axis.rowsBetween(Window.unboundedPreceding, -1)
    # does the first row of the slice start a run, seen from the slice before?
    linked = summary.withColumn("_before", F.lag("_to").over(axis)).withColumn(clock, F.col("_from"))
    linked = linked.withColumn("_cut", broken(F.col("_before")))
    fresh = F.col("_before").isNull() | F.col("_cut")
    linked = linked.withColumn("_start", F.coalesce("_start", F.when(fresh, F.col("_from"))))
    return linked.select(
        *by,
        "_slice",
        F.col("_before").alias(clock),
        F.last("_start", ignorenulls=True).over(earlier).alias("_at"),
        F.sum(F.col("_breaks") + F.col("_cut").cast("bigint")).over(earlier).alias("_no"),
        *[_over(spec.kind, F.col(f"_in_{n}"), earlier).alias(f"_in_{n}") for n, spec in extra.items()],
        F.lit(True).alias("_seed"),
    ).filter(F.col(clock).isNotNull())


def islands(
    df: DataFrame, by, order, gap_ms: int, *, closed: bool, start: str = "island_start", slicing: Slicing | None = None
) -> DataFrame:
    """Add the clock value of the first row of each gap island."""
    return gaps(df, by, order, gap_ms, closed=closed, start=start, slicing=slicing)
