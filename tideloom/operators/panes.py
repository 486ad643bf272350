"""Windows with triggers: which pane a message belongs to and what each firing emits.

A replay on event time. The clock is epoch ms; a timer due at t fires before a message with clock t.
Timers due at or after the close of the window do not fire. Firing types are EARLY (a trigger fired
inside the window), DEFAULT (the window closed) and LATE (see :func:`late_panes`).

Each message gets a segment number inside its (key, window). A segment ends with a firing; the last
one may have none and is what the DEFAULT pane of a discarding window holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.times import col, duration_ms, millis, window_start
from tideloom.operators.chains import Limits, starts
from tideloom.operators.ordered import Running, Slicing, gaps, islands, plan_slices, running, settle


@dataclass(frozen=True)
class Count:
    """Fires with the n-th message."""

    n: int


@dataclass(frozen=True)
class SinceFirst:
    """Fires a duration after the first message."""

    duration: str


@dataclass(frozen=True)
class SinceLast:
    """Fires after a silence; each message re-arms the timer."""

    duration: str


@dataclass(frozen=True)
class AnyOf:
    """Fires with the first of its children."""

    children: tuple


@dataclass(frozen=True)
class Repeat:
    """Starts its child again after each firing."""

    child: object


def limits(trigger) -> Limits:
    if isinstance(trigger, Repeat):
        inner = limits(trigger.child)
        return Limits(inner.count, inner.age, inner.silence, True)
    if isinstance(trigger, Count):
        return Limits(count=trigger.n)
    if isinstance(trigger, SinceFirst):
        return Limits(age=duration_ms(trigger.duration))
    if isinstance(trigger, SinceLast):
        return Limits(silence=duration_ms(trigger.duration))
    if isinstance(trigger, AnyOf):
        parts = [limits(t) for t in trigger.children]

        def least(name):
            return min((getattr(p, name) for p in parts if getattr(p, name) is not None), default=None)

        return Limits(least("count"), least("age"), least("silence"))
    raise TypeError(f"not a trigger: {trigger!r}")


def segments(
    df: DataFrame, group: Sequence[str], tie: str, trigger, slicing: Slicing | None = None
) -> DataFrame:
    """Add ``segment`` (0, 1, ...) to every row, by the firings inside each group.

    ``df`` has the clock in ``_ms``; ``tie`` orders messages of one millisecond.
    """
    lim = limits(trigger)
    order = ["_ms", tie]
    sequential = lim.repeat and (lim.age is not None or (lim.count is not None and lim.silence is not None))
    if sequential:
        return _greedy_segments(df, group, order, lim, slicing)
    if lim.repeat and lim.count is not None:
        numbered = running(df, group, order, {"_rn": Running("count")}, slicing)
        return numbered.withColumn("segment", F.floor((F.col("_rn") - 1) / lim.count)).drop("_rn")
    if lim.repeat:
        return gaps(df, group, order, lim.silence, closed=False, number="segment", slicing=slicing)
    # one firing: segment 0 up to it, segment 1 after it
    wanted = {}
    if lim.count is not None:
        wanted["_rn"] = Running("count")
    if lim.age is not None:
        wanted["_first"] = Running("min", "_ms")
    if lim.silence is not None:
        result = gaps(df, group, order, lim.silence, closed=False, number="_run", extra=wanted, slicing=slicing)
    else:
        result = running(df, group, order, wanted, slicing)
    inside = F.lit(True)
    if lim.count is not None:
        inside = inside & (F.col("_rn") <= lim.count)
    if lim.age is not None:
        inside = inside & (F.col("_ms") < F.col("_first") + lim.age)
    if lim.silence is not None:
        inside = inside & (F.col("_run") == 0)
    return result.withColumn("segment", F.when(inside, 0).otherwise(1).cast("bigint")).drop("_rn", "_first", "_run")


def _greedy_segments(df, group, order, lim: Limits, slicing) -> DataFrame:
    """Repeating age triggers. The chained starts go back to the rows as marker rows in a running
    window, not through a join. Without a count a segment starts with a tick, else with a rank."""
    slicing = slicing or Slicing()
    markers = settle(starts(df, group, lim, slicing), slicing).withColumnRenamed("segment", "_start")
    markers = markers.withColumn("_place", F.lit(0))
    if lim.count is None:
        rows = df.withColumn("_place", F.lit(1))
        place = ["_ms", "_place", order[1]]
        both = rows.unionByName(markers.drop("_rn"), allowMissingColumns=True)
    else:
        rows = running(df, group, order, {"_rn": Running("count")}, slicing).withColumn("_place", F.lit(1))
        place = ["_ms", "_rn", "_place"]
        both = settle(rows.unionByName(markers, allowMissingColumns=True), slicing)
    filled = running(both, group, place, {"segment": Running("last", "_start")}, slicing)
    return filled.filter(F.col("_place") == 1).drop("_place", "_start", "_rn")


_COMBINE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def partial_aggregates(aggs: dict[str, tuple[str, object]]) -> list[Column]:
    first = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max}
    return [first[kind](col(c) if c is not None else None).alias(name) for name, (kind, c) in aggs.items()]


def segmented(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, early, tumbling: str | None, session: str | None, slicing: Slicing | None
) -> tuple[DataFrame, Slicing]:
    """The rows with ``_ms``, ``pane_id`` and ``segment``, and the slicing that was planned for them."""
    if (tumbling is None) == (session is None):
        raise ValueError("give either tumbling or session")
    clocked = df.withColumn("_ms", millis(ts))
    if slicing is None:
        slicing = plan_slices(clocked, "_ms")
    if tumbling is not None:
        placed = clocked.withColumn("pane_id", window_start("_ms", tumbling))
    else:
        placed = islands(
            clocked, keys, ["_ms", tie], duration_ms(session), closed=True, start="pane_id", slicing=slicing
        )
        placed = settle(placed, slicing)
    return segments(placed, [*keys, "pane_id"], tie, early, slicing), slicing


def firings(parts: DataFrame, group: Sequence[str], lim: Limits, tumbling: str | None, session: str | None) -> DataFrame:
    """Add ``_close``, ``_fired`` (by the trigger, inside the window) and ``_at`` to one row per segment (_n, _from, _to)."""
    if tumbling is not None:
        parts = parts.withColumn("_close", F.col("pane_id") + duration_ms(tumbling))
    else:
        ends = parts.groupBy(*group).agg((F.max("_to") + duration_ms(session)).alias("_close"))
        ends = ends.select(*[F.col(g).alias(f"_{g}_e") for g in group], "_close")
        same = [F.col(g).eqNullSafe(F.col(f"_{g}_e")) for g in group]
        parts = parts.join(ends, same).drop(*[f"_{g}_e" for g in group])
    early_fired, at = F.lit(False), [F.col("_close"), F.lit(None).cast("bigint")]
    if lim.count is not None:
        early_fired = early_fired | (F.col("_n") >= lim.count)
        at.append(F.when(F.col("_n") >= lim.count, F.col("_to")))
    if lim.age is not None:
        early_fired = early_fired | (F.col("_from") + lim.age < F.col("_close"))
        at.append(F.col("_from") + lim.age)
    if lim.silence is not None:
        early_fired = early_fired | (F.col("_to") + lim.silence < F.col("_close"))
        at.append(F.col("_to") + lim.silence)
    if not lim.repeat:
        early_fired = early_fired & (F.col("segment") == 0)
    return parts.withColumn("_fired", early_fired).withColumn("_at", F.when(F.col("_fired"), F.least(*at)).otherwise(F.col("_close")))


def panes(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    tie: str,
    aggs: dict[str, tuple[str, object]],
    early,
    tumbling: str | None = None,
    session: str | None = None,
    accumulating: bool = False,
    slicing: Slicing | None = None,
    fired: str | None = None,
) -> DataFrame:
    """Every pane of a triggered window: keys, pane_id, pane_no, firing_type, mode and the aggregates.
    ``fired`` names a further column for the clock of each firing.

    ``aggs`` maps a name to (count | sum | min | max, column). DISCARDING: each pane holds what came
    since the firing before, and the closing pane is left out if nothing came. ACCUMULATING: each
    pane holds everything so far, and the closing pane is always there. For a session the panes are
    numbered inside the gap island.
    """
    placed, slicing = segmented(df, keys, ts, tie, early, tumbling, session, slicing)
    group = [*keys, "pane_id"]
    parts = placed.groupBy(*group, "segment").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_ms").alias("_from"), F.max("_ms").alias("_to"), *partial_aggregates(aggs)
    )
    if accumulating or session is not None:
        parts = settle(parts, slicing)
    parts = firings(parts, group, limits(early), tumbling, session)
    firing = [F.col("_at").alias(fired)] if fired else []
    mode = F.lit("ACCUMULATING" if accumulating else "DISCARDING").alias("mode")
    names = list(aggs)
    if not accumulating:
        kind = F.when(F.col("_fired"), "EARLY").otherwise("DEFAULT").alias("firing_type")
        return parts.select(*group, F.col("segment").alias("pane_no"), kind, mode, *names, *firing)
    # running totals over the panes of a window, cut along the same slices
    kinds = {n: "sum" if k == "count" else k for n, (k, _) in aggs.items()}
    so_far = running(
        parts.withColumnsRenamed({n: f"_p_{n}" for n in names}),
        group,
        ["_to", "segment"],
        {n: Running(k, f"_p_{n}") for n, k in kinds.items()},
        slicing,
    )
    early_panes = so_far.filter("_fired").select(
        *group, F.col("segment").alias("pane_no"), F.lit("EARLY").alias("firing_type"), mode, *names, *firing
    )
    closing = (
        parts.groupBy(*group)
        .agg(
            F.sum(F.col("_fired").cast("bigint")).alias("pane_no"),
            F.max("_close").alias("_at"),
            *[_COMBINE[k](n).alias(n) for n, k in kinds.items()],
        )
        .select(*group, "pane_no", F.lit("DEFAULT").alias("firing_type"), mode, *names, *firing)
    )
    return early_panes.unionByName(closing)


def late_panes(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    arrival: str,
    tie: str,
    size: str,
    delay: str,
    aggs: dict[str, tuple[str, object]],
    slicing: Slicing | None = None,
) -> DataFrame:
    """Tumbling panes split into ON TIME (DEFAULT) and LATE messages.

    Messages arrive in ``arrival`` order (epoch ms). The watermark before a message is the highest
    event time that arrived so far minus ``delay``; a message is late if its window had closed by then.
    """
    clocked = df.withColumns({"_ms": millis(ts), "_at": F.col(arrival)})
    if slicing is None:  # no key spreads the rows, so there is a slice for every core
        slicing = plan_slices(clocked, "_at", least=df.sparkSession.sparkContext.defaultParallelism)
    marked = running(clocked, [], ["_at", tie], {"_seen": Running("max", "_ms", before=True)}, slicing)
    placed = marked.withColumn("pane_id", window_start("_ms", size))
    closed = F.col("pane_id") + duration_ms(size) <= F.col("_seen") - duration_ms(delay)
    return (
        placed.withColumn("firing_type", F.when(closed, "LATE").otherwise("DEFAULT"))
        .groupBy(*keys, "pane_id", "firing_type")
        .agg(*partial_aggregates(aggs))
    )
