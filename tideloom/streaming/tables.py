"""Live steps whose state is a table: early panes, timers by key, joins and tables kept up to date.

They run the batch operators on each micro-batch together with the state, so they stay in the JVM and
split hot keys by slices of the clock. See ``buckets.run_in_order`` and ``runs.run_with_state``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.times import duration_ms, millis, window_start
from tideloom.operators.joins import asof_join, match_latest
from tideloom.operators.ordered import Running, islands, plan_slices, running
from tideloom.operators.panes import panes, partial_aggregates
from tideloom.operators.tables import latest, materialise
from tideloom.streaming.buckets import run_in_order
from tideloom.streaming.runs import run_with_state


def count_panes(
    stream: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, delay: str, size: str, every: int, name: str
) -> DataFrame:
    """Tumbling windows with an early pane after each ``every`` messages (discarding); the closing pane
    holds the rest and comes when the watermark has passed the end of the window.

    Columns keys, pane_id, pane_no, firing_type, n, total. State: one row per open window with the
    messages since its last pane. Messages of closed windows are too late and dropped.
    """
    group = [*keys, "pane_id"]
    width = duration_ms(size)
    rows = stream.select(
        *keys, millis(ts).alias("_ms"), F.col(tie).alias("_tie"), F.lit(1).cast("bigint").alias("_n"),
        F.col(value).cast("bigint").alias("_v"),
    ).withColumn("pane_id", window_start("_ms", size))
    types = dict(rows.dtypes)
    state_schema = ", ".join([f"`{k}` {types[k]}" for k in group] + ["_number bigint", "_n bigint", "_v bigint"])

    def step(batch: DataFrame, state: DataFrame, before: int, after: int):
        timely = batch.filter(F.col("pane_id") + width > before)
        slicing = plan_slices(timely, "_ms")
        # the state of a window stands before its messages, as if it were one message
        kept = state.withColumns({"_ms": F.col("pane_id") - 1, "_tie": F.lit(0).cast(types["_tie"])})
        both = timely.unionByName(kept, allowMissingColumns=True)
        counted = running(
            both, group, ["_ms", "_tie"], {"_upto": Running("sum", "_n"), "_first": Running("last", "_number")}, slicing
        )
        place = F.floor(F.greatest(F.col("_upto") - 1, F.lit(0)) / every)
        parts = (
            counted.withColumn("pane_no", F.coalesce("_first", F.lit(0)) + place)
            .groupBy(*group, "pane_no")
            .agg(F.sum("_n").alias("n"), F.sum("_v").alias("total"))
            .withColumn("_full", F.col("n") >= every)
            .withColumn("_closed", F.col("pane_id") + width <= after)
        )
        kind = F.when(F.col("_full"), "EARLY").otherwise("DEFAULT")
        output = parts.filter(F.col("_full") | (F.col("_closed") & (F.col("n") > 0))).select(
            *group, "pane_no", kind.alias("firing_type"), "n", "total"
        )
        rest = ~F.col("_full")
        following = (
            parts.filter(~F.col("_closed"))
            .groupBy(*group)
            .agg(
                F.max(F.when(rest, F.col("pane_no")).otherwise(F.col("pane_no") + 1)).alias("_number"),
                F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("_n"),
                F.sum(F.when(rest, F.col("total")).otherwise(0)).alias("_v"),
            )
        )
        return output, following

    return run_with_state(rows, name, step, state_schema, "_ms", duration_ms(delay))


def live_panes(
    stream: DataFrame, *, keys: Sequence[str], ts: str, tie: str, aggs: dict[str, tuple[str, str | None]], early, delay: str,
    name: str, tumbling: str | None = None, session: str | None = None, accumulating: bool = False, folder: str | None = None,
) -> DataFrame:
    """The live form of ``panes.panes``: any trigger, both modes, tumbling windows and sessions.

    A pane comes out, once, when the watermark has passed its firing; the column fired_ms tells the clock. Messages whose
    window had closed by the watermark when they came are given as a LATE pane (pane_no and fired_ms null) per window and
    micro-batch. State: the messages of open windows, in buckets of the keys.
    """
    gap = duration_ms(session) if session else None
    used = [c for _, c in aggs.values() if c is not None]
    columns = list(dict.fromkeys([*keys, tie, *used]))
    rows = stream.select(*columns, millis(ts).alias("_ms"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    group = [*keys, "pane_id"]

    def step(ready: DataFrame, table: DataFrame, before: int, after: int):
        both = ready.withColumn("_new", F.lit(True)).unionByName(table.withColumn("_new", F.lit(False)))
        slicing = plan_slices(both, "_ms")
        if tumbling:
            placed = both.withColumn("pane_id", window_start("_ms", tumbling))
            placed = placed.withColumn("_close", F.col("pane_id") + duration_ms(tumbling))
            placed = placed.withColumn("_late", F.col("_new") & (F.col("_close") <= before))
        else:
            placed = islands(both, keys, ["_ms", tie], gap, closed=True, start="pane_id", slicing=slicing)
            ends = placed.groupBy(*group).agg((F.max("_ms") + gap).alias("_close"), F.bool_and("_new").alias("_fresh"))
            ends = ends.withColumnsRenamed({g: f"_{g}_e" for g in group})
            same = [F.col(g).eqNullSafe(F.col(f"_{g}_e")) for g in group]
            # a session that was open when the batch came is not late
            placed = placed.join(ends, same).drop(*[f"_{g}_e" for g in group])
            placed = placed.withColumn("_late", F.col("_fresh") & (F.col("_close") <= before))
        timely = placed.filter(~F.col("_late")).select(*columns, "_ms", "_close")
        whole = timely.withColumn("_clock", F.timestamp_millis("_ms"))
        found = panes(
            whole, keys=keys, ts="_clock", tie=tie, aggs=aggs, early=early, tumbling=tumbling, session=session,
            accumulating=accumulating, slicing=slicing, fired="fired_ms",
        ).filter((F.col("fired_ms") > before) & (F.col("fired_ms") <= after))
        mode = F.lit("ACCUMULATING" if accumulating else "DISCARDING").alias("mode")
        nothing = F.lit(None).cast("bigint")
        late = placed.filter("_late").groupBy(*group).agg(*partial_aggregates(aggs)).select(
            *group, nothing.alias("pane_no"), F.lit("LATE").alias("firing_type"), mode, *aggs, nothing.alias("fired_ms")
        )
        return found.unionByName(late), timely.filter(F.col("_close") > after).select(*columns, "_ms")

    return run_in_order(
        rows, name, step, keys, schema, "_ms", duration_ms(delay), folder, flush=False, all_buckets=True
    )[0]


def ttl_join(
    left: DataFrame, right: DataFrame, *, key: str, ts: str, tie: str, delay: str, ttl: str, left_id: str, right_id: str, name: str,
    folder: str | None = None,
) -> DataFrame:
    """The live form of ``joins.ttl_join``: the same rows, also when files come out of order within ``delay``.

    State: the messages newer than the watermark, and below it the latest one per key and side until its time to live
    has passed. Columns key, joined_ms and the ids of both messages.
    """

    def side(df: DataFrame, number: int, ident: str, payload: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).select(
            F.col(key).alias("_key"), millis(ts).alias("_ms"), F.col(tie).alias("_tie"),
            F.lit(number).alias("_side"), F.struct(F.col(ident)).alias(payload),
        )

    both = side(left, 0, left_id, "_l").unionByName(side(right, 1, right_id, "_r"), allowMissingColumns=True)
    both = both.select("_key", "_ms", "_tie", "_side", "_l", "_r")
    schema = ", ".join(f"{n} {t}" for n, t in both.dtypes)
    alive = duration_ms(ttl)

    def step(ready: DataFrame, table: DataFrame, before: int, watermark: int):
        seen = ready.withColumn("_new", F.lit(True)).unionByName(table.withColumn("_new", F.lit(False)))
        matches = match_latest(seen, alive, plan_slices(seen, "_ms")).filter("_new")
        newest = (
            seen.filter(F.col("_ms") > watermark - alive)
            .groupBy("_key", "_side")
            .agg(F.max_by(F.struct("_ms", "_tie", "_l", "_r"), F.struct("_ms", "_tie")).alias("_row"))
            .select("_key", "_row._ms", "_row._tie", "_side", "_row._l", "_row._r")
        )
        return matches.select(F.col("_key").alias(key), F.col("_ms").alias("joined_ms"), "_l.*", "_r.*"), newest

    return run_in_order(both, name, step, ["_key"], schema, "_ms", duration_ms(delay), folder)[0]


def live_table(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, deleted: Column | None = None, folder: str | None = None
) -> DataFrame:
    """A table kept up to date by a change stream: the latest change per key, deletes included as
    tombstones while the stream runs and left out of the result.

    Each micro-batch is reduced to one row per key before it meets the table, and replaces only the hash buckets of the
    keys it changes.
    """
    types = dict(changes.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in changes.columns)

    def step(rows: DataFrame, table: DataFrame, *_):
        return rows.limit(0), latest(table.unionByName(materialise(rows, keys, order)), keys, order)

    _, table, last = run_in_order(changes, name, step, keys, schema, None, folder=folder)
    rows = table.read(last)
    return rows if deleted is None else rows.filter(~F.coalesce(deleted, F.lit(False)))


def table_join(
    stream: DataFrame, changes: DataFrame, *, key: str, ts: str, tie: str, columns: Sequence[str], delay: str, name: str,
    deleted: Column | None = None, how: str = "left", folder: str | None = None,
) -> DataFrame:
    """Join a live stream with the table that a live change stream forms, as it is when each row passes.

    Both inputs are read as one stream in the order of the clock, so a row sees the changes that stand before it, also
    those that come in a later file within ``delay``. State: the rows and changes newer than the watermark, and below it
    the latest change per key.
    """
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    kept = list(stream.columns)
    updates = changes.filter(F.col(key).isNotNull()).select(
        F.col(key), F.col(ts), F.col(tie), F.struct(*columns).alias("_value"), gone.alias("_gone")
    ).withColumn("_change", F.lit(True))
    both = updates.unionByName(stream.withColumn("_change", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_clock", millis(ts))
    state_columns = [key, ts, tie, "_value", "_gone"]
    types = dict(both.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in state_columns)

    def step(ready: DataFrame, table: DataFrame, *_):
        known = table.unionByName(ready.filter("_change").select(*state_columns))
        rows = ready.filter("NOT _change").select(*kept)
        opened = known.select(key, ts, tie, "_value.*", "_gone")
        found = asof_join(rows, opened, key=key, ts=ts, tie=tie, columns=columns, deleted=F.col("_gone"), how=how)
        return found, latest(known, [key], [ts, tie])

    return run_in_order(both, name, step, [key], schema, "_clock", duration_ms(delay), folder)[0]


def key_timers(
    stream: DataFrame, key: str, ts: str, tie: str, delay: str, after: str, arm: str, disarm: str, kind: str, name: str
) -> DataFrame:
    """Timers by key: a message of kind ``arm`` (re)schedules a callback ``after`` later, one of kind
    ``disarm`` deletes it. The callback gives (key, armed_by, due_ms), when the next of these messages
    of the key or the watermark has reached the due time.

    State: the last arming message of each key whose timer is pending.
    """
    wait = duration_ms(after)
    rows = stream.filter(F.col(kind).isin(arm, disarm)).select(
        key, millis(ts).alias("_ms"), F.col(tie).alias("_id"), (F.col(kind) == arm).alias("_arm")
    )
    state_schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def callback(message: str):
        return F.col(f"{message}._id").alias("armed_by"), (F.col(f"{message}._ms") + wait).alias("due_ms")

    def step(batch: DataFrame, state: DataFrame, before: int, now: int):
        seen = batch.unionByName(state)
        this = F.struct("_ms", "_id", "_arm")
        carried = running(seen, [key], ["_ms", "_id"], {"_before": Running("last", this, before=True)}, plan_slices(seen, "_ms"))
        overtaken = carried.filter(F.col("_before._arm") & (F.col("_before._ms") + wait <= F.col("_ms")))
        newest = latest(seen, [key], ["_ms", "_id"]).filter("_arm")
        due = newest.filter(F.col("_ms") + wait <= now).select(key, F.struct("_ms", "_id").alias("_m"))
        output = overtaken.select(key, *callback("_before")).unionByName(due.select(key, *callback("_m")))
        return output, newest.filter(F.col("_ms") + wait > now)

    return run_with_state(rows, name, step, state_schema, "_ms", duration_ms(delay))
