"""User folds and collected messages under triggers.

``panes`` knows the aggregates that add up. Here a pane holds the state of a user's fold, in the order of its
messages, or the messages themselves. A fold comes with a ``merge`` of two neighbouring runs: it lets a pane of any
size be folded by many tasks, and the accumulating panes of a window, however many, be prefixes that many tasks
compute. A DISCARDING pane is its own segment; an ACCUMULATING pane the merge of all segments so far.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.operators.ordered import Slicing, settle
from tideloom.operators.panes import firings, limits, segmented
from tideloom.operators.windows import CHUNK_ROWS, collect_panes, fold_levels, fold_ordered
from tideloom.session import shared_folder

#: States that one row of the prefix merge holds at a time.
RUN = 64


def folded_panes(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    tie: str,
    zero: Column,
    step: Callable[[Column, Column], Column],
    merge: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column],
    out: str,
    early,
    tumbling: str | None = None,
    session: str | None = None,
    accumulating: bool = False,
    slicing: Slicing | None = None,
    chunk: int = CHUNK_ROWS,
    run: int = RUN,
) -> DataFrame:
    """Every pane of a triggered window with a fold-left of its messages: keys, pane_id, pane_no, firing_type, mode, ``out``.

    ``step(state, row)`` folds one message, ``merge(earlier, later)`` joins two neighbouring runs, and ``finish`` gives the
    output. The panes are those of :func:`tideloom.operators.panes.panes`, numbers and firing types included. Messages
    of one millisecond are in the order of ``tie``; null keys are a key; no rows give no panes. States should be bounded.
    """
    rows, slicing = segmented(df, keys, ts, tie, early, tumbling, session, slicing)
    rows = settle(rows, slicing)
    group = [*keys, "pane_id"]

    def framed(n, low, high, state):
        return F.struct(n.alias("n"), low.alias("low"), high.alias("high"), state.alias("state"))

    none = F.lit(None).cast("bigint")
    states = fold_ordered(
        rows, [*group, "segment"], ["_ms", tie],
        zero=framed(F.lit(0).cast("bigint"), none, none, zero),
        step=lambda s, m: framed(s["n"] + 1, F.coalesce(s["low"], m["_ms"]), m["_ms"], step(s["state"], m)),
        merge=lambda a, b: framed(
            a["n"] + b["n"], F.coalesce(a["low"], b["low"]), F.coalesce(b["high"], a["high"]), merge(a["state"], b["state"])
        ),
        finish=lambda s: s, out="_s", chunk=chunk, slicing=slicing,
    )
    parts = states.select(*group, "segment", F.col("_s.n").alias("_n"), F.col("_s.low").alias("_from"),
                          F.col("_s.high").alias("_to"), F.col("_s.state").alias("_state"))
    parts = _stored(firings(parts, group, limits(early), tumbling, session))
    mode = F.lit("ACCUMULATING" if accumulating else "DISCARDING").alias("mode")
    kind = lambda fired: F.when(fired, "EARLY").otherwise("DEFAULT").alias("firing_type")
    if not accumulating:
        return parts.select(*group, F.col("segment").alias("pane_no"), kind(F.col("_fired")), mode, finish(F.col("_state")).alias(out))
    so_far = _stored(prefixes(parts.select(*group, "segment", "_fired", "_state"), group, "segment", "_state", merge, run=run))
    early_panes = so_far.filter("_fired").select(*group, F.col("segment").alias("pane_no"), F.lit(True).alias("_early"), "_state")
    closing = so_far.groupBy(*group).agg(
        F.sum(F.col("_fired").cast("bigint")).alias("pane_no"), F.lit(False).alias("_early"), F.max_by("_state", "segment").alias("_state")
    )
    return early_panes.unionByName(closing).select(*group, "pane_no", kind(F.col("_early")), mode, finish(F.col("_state")).alias(out))


def prefixes(
    df: DataFrame, by: Sequence[str], at: str, state: str, merge: Callable[[Column, Column], Column], run: int = RUN
) -> DataFrame:
    """``df`` with ``state`` merged over all rows of its ``by`` group up to it. ``at`` numbers the rows of a group 0, 1, ...

    Runs of ``run`` rows are merged on their own, their last states in turn one level higher, and what comes before a run
    goes back to its rows: log(rows) / log(run) levels, no array above ``run`` and no whole group in one task.
    """
    top = df.agg(F.max(at)).first()[0]
    return df if top is None else _prefixes(df, by, at, state, merge, run, fold_levels(top + 1, run))


def _prefixes(df, by, at, state, merge, run, levels) -> DataFrame:
    others = [c for c in df.columns if c not in by and c != state]
    runs = (
        df.withColumn("_run", F.floor(F.col(at) / run))
        .groupBy(*by, "_run")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("_at"), F.col(state).alias("_state"), F.struct(*others).alias("_row")))).alias("_m"))
    )

    def add(done, item):
        merged = F.when(F.size(done) == 0, item["_state"]).otherwise(merge(F.element_at(done, -1)["_state"], item["_state"]))
        return F.concat(done, F.array(F.struct(merged.alias("_state"), item["_row"].alias("_row"))))

    element = f"array<{_item_type(runs)}>"
    local = runs.select(*by, "_run", F.aggregate("_m", F.array().cast(element), add).alias("_m"))
    if levels:
        local = _stored(local)
        totals = local.select(*by, F.col("_run").alias("_number"), F.element_at("_m", -1)["_state"].alias(state))
        above = _prefixes(totals, by, "_number", state, merge, run, levels - 1)
        above = above.select(*[F.col(b).alias(f"_{b}_a") for b in by], (F.col("_number") + 1).alias("_next"), F.col(state).alias("_before"))
        same = [F.col(b).eqNullSafe(F.col(f"_{b}_a")) for b in by]
        local = local.join(above, [*same, F.col("_run") == F.col("_next")], "left")
    rows = local.select(*by, *(["_run", "_before"] if levels else []), F.explode("_m").alias("_m"))
    whole = F.col("_m._state")
    if levels:
        whole = F.when(F.col("_run") == 0, whole).otherwise(merge(F.col("_before"), whole))
    return rows.select(*by, *[F.col(f"_m._row.{c}").alias(c) for c in others], whole.alias(state))


def _item_type(runs: DataFrame) -> str:
    """The type of an item of the merged array: state and row of an item of the collected one."""
    fields = {f.name: f.dataType.simpleString() for f in runs.schema["_m"].dataType.elementType}
    return f"struct<_state:{fields['_state']},_row:{fields['_row']}>"


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: the next passes read it more than once."""
    path = shared_folder(df.sparkSession, "pane-states")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def collected_panes(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    tie: str,
    columns: Sequence[str],
    early,
    tumbling: str | None = None,
    session: str | None = None,
    accumulating: bool = False,
    slicing: Slicing | None = None,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Messages of every pane of a triggered window: keys, pane_id, pane_no, firing_type, mode, chunk_no, n_messages, messages.

    A pane is one or more rows with consecutive ``chunk_no``, each with at most ``chunk`` messages in order; none is left
    out. Messages are put out once: an ACCUMULATING pane holds the rows of its window up to its own ``pane_no``, whose
    number of messages is in ``n_so_far``, and the closing pane (pane_no = number of firings) may have no row of its own;
    then it is given with an empty list.
    """
    rows, slicing = segmented(df, keys, ts, tie, early, tumbling, session, slicing)
    rows = _stored(rows)
    group = [*keys, "pane_id"]
    parts = rows.groupBy(*group, "segment").agg(F.count(F.lit(1)).alias("_n"), F.min("_ms").alias("_from"), F.max("_ms").alias("_to"))
    parts = _stored(firings(parts, group, limits(early), tumbling, session))
    mode = F.lit("ACCUMULATING" if accumulating else "DISCARDING").alias("mode")
    chunks = collect_panes(rows, ts, [*keys, "segment"], tie, columns, chunk, slicing)
    marks = parts.select(*group, F.col("segment").alias("pane_no"), F.when(F.col("_fired"), "EARLY").otherwise("DEFAULT").alias("firing_type"), F.col("_n").alias("n_so_far"))
    if accumulating:
        marks = prefixes(marks, group, "pane_no", "n_so_far", lambda a, b: a + b)
        ends = parts.groupBy(*group).agg(
            F.sum(F.col("_fired").cast("bigint")).alias("pane_no"), F.bool_and("_fired").alias("_all"), F.sum("_n").alias("n_so_far")
        )
        bare = ends.filter("_all").select(*group, "pane_no", F.lit("DEFAULT").alias("firing_type"), "n_so_far")
        marks = marks.unionByName(bare)
    named = marks.select(*[F.col(g).alias(f"_{g}_m") for g in group], "pane_no", "firing_type", "n_so_far")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}_m")) for g in group] + [F.col("segment") == F.col("pane_no")]
    messages = chunks.schema["messages"].dataType.simpleString()
    return named.join(chunks, same, "left").select(
        *[F.col(f"_{g}_m").alias(g) for g in group], "pane_no", "firing_type", mode,
        F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        *(["n_so_far"] if accumulating else []), F.coalesce("messages", F.array().cast(messages)).alias("messages"),
    )
