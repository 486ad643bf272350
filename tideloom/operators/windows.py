"""Keyed and global windows: tumbling, sliding and session, as folds or as collected panes.

The clock is the event time column: stored streams are replayed on it, which makes results
deterministic, where a live engine would use the wall clock. Pane id = window start in epoch ms (for a session, the
time of its first message).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.times import duration_ms, millis, window_start
from tideloom.operators.ordered import Slicing, islands, plan_slices, ranked, settle

CHUNK_ROWS = 4_096


def _interval(text: str | int) -> str:
    return f"{duration_ms(text)} milliseconds"


def tumbling(df: DataFrame, ts: str, size: str, aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Fold per (keys, tumbling window): partial aggregation before the only shuffle."""
    return (
        df.groupBy(*keys, F.window(ts, _interval(size)).alias("_w"))
        .agg(*aggs)
        .withColumn("pane_id", millis("_w.start"))
        .drop("_w")
    )


def sliding(
    df: DataFrame, ts: str, size: str, slide: str, aggs: Sequence[Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Fold per (keys, sliding window). Windows are multiples of ``slide`` from the epoch."""
    return (
        df.groupBy(*keys, F.window(ts, _interval(size), _interval(slide)).alias("_w"))
        .agg(*aggs)
        .withColumn("pane_id", millis("_w.start"))
        .drop("_w")
    )


def session(df: DataFrame, ts: str, gap: str, aggs: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """Fold per (keys, session). A silence of exactly ``gap`` still belongs to the session.

    Rows are merged into partial sessions inside their input partition first (see
    ``session.RUNTIME_CONF``), so a hot key shuffles sessions and not rows.
    """
    return (
        df.groupBy(*keys, F.session_window(ts, _interval(gap)).alias("_w"))
        .agg(*aggs)
        .withColumn("pane_id", millis("_w.start"))
        .drop("_w")
    )


def tag_tumbling(df: DataFrame, ts: str, size: str) -> DataFrame:
    """Add ``pane_id`` per row: a pure projection, no shuffle."""
    return df.withColumn("pane_id", window_start(millis(ts), size))


def tag_session(
    df: DataFrame, ts: str, gap: str, keys: Sequence[str], tie: str, slicing: Slicing | None = None, stored: bool = False
) -> DataFrame:
    """Add the session's ``pane_id`` to every row. ``stored`` settles the result for a further pass."""
    clocked = df.withColumn("_ms", millis(ts))
    slicing = plan_slices(clocked, "_ms") if slicing is None else slicing
    tagged = islands(
        clocked, keys, ["_ms", tie], duration_ms(gap), closed=True, start="pane_id", slicing=slicing
    ).drop("_ms")
    return settle(tagged, slicing) if stored else tagged


def collect_panes(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    tie: str,
    columns: Sequence[str],
    chunk: int = CHUNK_ROWS,
    slicing: Slicing | None = None,
) -> DataFrame:
    """Messages of each (keys, pane_id) in order, as arrays of at most ``chunk`` messages.

    A collected pane has no size limit, and one array per pane would have to fit into one row of
    one task. A long pane is therefore several rows with consecutive ``chunk_no``; no message is
    left out.
    """
    clocked = df.withColumn("_ms", millis(ts))
    slicing = plan_slices(clocked, "_ms") if slicing is None else slicing
    numbered = ranked(clocked, [*keys, "pane_id"], ["_ms", tie], "_rn", slicing)
    return (
        numbered.withColumn("chunk_no", F.floor((F.col("_rn") - 1) / chunk))
        .groupBy(*keys, "pane_id", "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", *columns))).alias("_m"))
        .select(
            *keys,
            "pane_id",
            "chunk_no",
            F.size("_m").cast("bigint").alias("n_messages"),
            F.transform("_m", lambda m: F.struct(*[m[c].alias(c) for c in columns])).alias("messages"),
        )
    )


def fold_levels(rows: int, chunk: int) -> int:
    """How often runs of ``chunk`` states have to be merged after the first fold until one is left."""
    levels, states = 0, -(-rows // chunk)
    while states > 1:
        levels, states = levels + 1, -(-states // chunk)
    return levels


def fold_ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    zero: Column,
    step: Callable[[Column, Column], Column],
    merge: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column],
    out: str,
    chunk: int = CHUNK_ROWS,
    slicing: Slicing | None = None,
) -> DataFrame:
    """Fold-left of each group in order. ``order[0]`` is numeric and sliced.

    ``step(state, row)`` folds one message, ``merge(earlier, later)`` joins the states of two
    neighbouring runs; it is what lets a group of any size be folded by many tasks. Runs of
    ``chunk`` messages are folded on their own, then runs of ``chunk`` states, and so on: the
    number of levels follows from the row count, and no array is longer than ``chunk``.
    """
    slicing = plan_slices(df, order[0]) if slicing is None else slicing
    rows = df.count()
    numbered = ranked(df, by, order, "_rn", slicing)
    used = [c for c in df.columns if c not in by]
    states = (
        numbered.withColumn("_run", F.floor((F.col("_rn") - 1) / chunk))
        .groupBy(*by, "_run")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", *used))).alias("_m"))
        .select(*by, "_run", F.aggregate("_m", zero, step).alias("_state"))
    )
    for _ in range(fold_levels(rows, chunk)):
        states = (
            states.withColumn("_next", F.floor(F.col("_run") / chunk))
            .groupBy(*by, "_next")
            .agg(F.array_sort(F.collect_list(F.struct("_run", "_state"))).alias("_m"))
            .select(
                *by,
                F.col("_next").alias("_run"),
                F.aggregate("_m", zero, lambda a, b: merge(a, b["_state"])).alias("_state"),
            )
        )
    return states.select(*by, finish(F.col("_state")).alias(out))
