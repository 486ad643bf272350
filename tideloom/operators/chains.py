"""Chains of segments: where each one starts depends on where the one before it ended.

Only the starts are sequential, and they need no more than the number of messages per distinct clock
tick. So every group is reduced to its ticks (map-side combine): at most one row per millisecond of
its window, however many messages it holds.

Where the clock axis is not cut, the ticks of a group stream through one task in constant memory, and
the chains of all groups of an Arrow batch advance together. Where it is cut, a group is worked on in
all its slices at once (:func:`_sliced_starts`): each slice finds, for every place where a segment
could start, the last start that follows from it inside the slice; these maps are composed from slice
to slice by pointer doubling, in as many joins as the number of slices has binary digits; then each
slice that the chain enters puts out its own starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.operators.ordered import Running, Slicing, running, settle


#: Rows of an Arrow batch that a task gives back.
OUT_ROWS = 10_000


@dataclass(frozen=True)
class Limits:
    """Bounds on one segment: message count, age and silence in ms; ``repeat`` starts a new one after it."""

    count: int | None = None
    age: int | None = None
    silence: int | None = None
    repeat: bool = False


def starts(df: DataFrame, group: Sequence[str], lim: Limits, slicing: Slicing | None = None) -> DataFrame:
    """Segment starts of every group: the group, clock ``_ms`` and rank ``_rn`` of the first message,
    and ``segment`` (0, 1, ...). ``df`` has the clock in ``_ms``, the axis that ``slicing`` cuts."""
    ticks = df.groupBy(*group, "_ms").agg(F.count(F.lit(1)).alias("_n"))
    # JSON tells every text from every other, and null from all of them
    ident = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    ticks = ticks.withColumn("_group", ident)
    types = dict(df.dtypes)
    schema = ", ".join([f"`{g}` {types[g]}" for g in group] + ["_ms bigint", "_rn bigint", "segment bigint"])
    names = list(group)
    if slicing is not None and slicing.cuts:
        return _sliced_starts(ticks, names, schema, lim, slicing)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return segment_starts(batches, names, lim)

    return ticks.repartition("_group").sortWithinPartitions("_group", "_ms").mapInPandas(run, schema)


def _sliced_starts(ticks: DataFrame, names: list[str], schema: str, lim: Limits, slicing: Slicing) -> DataFrame:
    before = {"_upto": Running("sum", "_n"), "_prev": Running("max", "_ms", before=True)}
    placed = running(settle(ticks, slicing), ["_group"], ["_ms"], before, slicing)
    silence = F.lit(None) if lim.silence is None else F.col("_ms") - F.col("_prev") >= lim.silence
    placed = slicing.tag(placed, "_ms", "_slice").select(
        *names, "_group", "_slice", "_ms", "_n", (F.col("_upto") - F.col("_n") + 1).alias("_rn"),
        F.coalesce(silence.cast("boolean"), F.lit(False)).alias("_quiet"),
    )
    placed = settle(placed, slicing)

    def dealt(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition("_group", "_slice").sortWithinPartitions("_group", "_slice", *order)

    maps = dealt(placed.drop(*names), "_ms").mapInArrow(
        lambda batches: slice_maps(batches, lim),
        "_group string, _slice int, _rn bigint, _last bigint, _last_ms bigint, _hops bigint",
    )
    maps = settle(maps, slicing)
    edges = settle(_crossings(placed, maps, lim, slicing), slicing)
    root = maps.filter("_rn = 1")

    # edges over 1, 2, 4, ... slices that the chain enters, then all nodes on the way from the root
    jumps = [edges.select("_group", "_node", "_to", "_steps")]
    while not jumps[-1].isEmpty():
        jumps.append(settle(_joined(jumps[-1], jumps[-1], "_steps"), slicing))
    reached = root.select("_group", F.col("_last").alias("_to"), F.col("_hops").alias("_steps"))
    for jump in reversed(jumps[:-1]):
        further = _joined(reached, jump, "_steps").select(*reached.columns)
        reached = settle(reached.unionByName(further), slicing)
    onward = reached.withColumnRenamed("_to", "_node").join(edges.withColumnRenamed("_steps", "_more"), ["_group", "_node"])
    entries = onward.select("_group", "_slice", F.col("_entry").alias("_rn"), (F.col("_steps") + 1).alias("_no"))
    entries = entries.unionByName(root.select("_group", "_slice", "_rn", F.lit(0).cast("bigint").alias("_no")))
    # an entry stands in front of the ticks of its slice
    both = placed.withColumn("_no", F.lit(-1).cast("bigint")).unionByName(entries, allowMissingColumns=True)
    both = both.fillna(0, ["_ms", "_n"]).withColumns({
        "_quiet": F.coalesce("_quiet", F.lit(False)), "_place": F.when(F.col("_no") < 0, 1).otherwise(0),
    })
    return dealt(both, "_place", "_ms").mapInArrow(lambda batches: slice_starts(batches, names, lim), schema)


def _joined(first: DataFrame, then: DataFrame, steps: str) -> DataFrame:
    """Edges of ``first`` followed by edges of ``then``; ``steps`` adds up."""
    a, b = first.alias("a"), then.alias("b")
    kept = [F.col(f"a.{c}") for c in first.columns if c not in ("_to", steps)]
    same = (F.col("a._group") == F.col("b._group")) & (F.col("a._to") == F.col("b._node"))
    return a.join(b, same).select(*kept, "b._to", (F.col(f"a.{steps}") + F.col(f"b.{steps}")).alias(steps))


def _crossings(placed: DataFrame, maps: DataFrame, lim: Limits, slicing: Slicing) -> DataFrame:
    """From the last start in a slice (``_node``) to the next start, in a later slice (``_entry`` in ``_slice``), and the
    last one there (``_to``), with the number of starts between.

    The next start is the first tick that is due, the first after a silence, or the message with which the count is full:
    the two former are looked up on the clock axis, backwards.
    """
    nodes = maps.select("_group", F.col("_last").alias("_node"), F.col("_last_ms").alias("_ms")).distinct()
    axis = placed.select(
        "_group", (-F.col("_ms")).alias("_at"), F.lit(1).alias("_place"), F.lit(None).cast("bigint").alias("_node"),
        F.col("_rn").alias("_due"), F.when(F.col("_quiet"), F.col("_rn")).alias("_calm"),
    )
    asked, found = [], []
    if lim.age is not None:
        asked.append(nodes.select("_group", (-F.col("_ms") - lim.age).alias("_at"), F.lit(2).alias("_place"), "_node"))
        found.append(F.when(F.col("_place") == 2, F.col("_due_rn")))
    if lim.silence is not None:
        asked.append(nodes.select("_group", (-F.col("_ms")).alias("_at"), F.lit(0).alias("_place"), "_node"))
        found.append(F.when(F.col("_place") == 0, F.col("_calm_rn")))
    if not asked:  # by count alone
        asked.append(nodes.select("_group", (-F.col("_ms")).alias("_at"), F.lit(0).alias("_place"), "_node"))
        found.append(F.lit(None).cast("bigint"))
    for rows in asked:
        axis = axis.unionByName(rows, allowMissingColumns=True)
    backwards = Slicing(tuple(sorted(-c for c in slicing.cuts)))
    wanted = {"_due_rn": Running("last", "_due"), "_calm_rn": Running("last", "_calm")}
    looked_up = running(settle(axis, slicing), ["_group"], ["_at", "_place"], wanted, backwards)
    entry = F.min(F.coalesce(*found))
    if lim.count is not None:
        entry = F.least(entry, F.col("_node") + lim.count)
    nexts = looked_up.filter(F.col("_node").isNotNull()).groupBy("_group", "_node").agg(entry.alias("_entry"))
    to = maps.select(
        "_group", F.col("_rn").alias("_entry"), "_slice", F.col("_last").alias("_to"), (F.col("_hops") + 1).alias("_steps")
    )
    return nexts.join(to, ["_group", "_entry"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by (_group, _slice) as tables that hold each such piece whole."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        group, part = table["_group"][-1], table["_slice"][-1]
        if (group.as_py(), part.as_py()) != key:
            at = pc.index(pc.and_(pc.equal(table["_group"], group), pc.equal(table["_slice"], part)), True).as_py()
            whole = pa.concat_tables([*held, table.slice(0, at)])
            if whole.num_rows:
                yield whole
            held, key = [table.slice(at)], (group.as_py(), part.as_py())
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def _edges(table: pa.Table) -> np.ndarray:
    """The first row of every piece, and the number of rows."""
    if not table.num_rows:
        return np.zeros(1, np.int64)
    same = [pc.equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)) for c in ("_group", "_slice")]
    changes = np.flatnonzero(~pc.and_(*same).to_numpy(zero_copy_only=False)) + 1
    return np.r_[0, changes, table.num_rows]


def _places(table: pa.Table, edges: np.ndarray, lim: Limits):
    """Where segments could start, in order: row, rank and next start of each; itself where none follows in its piece.

    Without a count these are the ticks, else the messages.
    """
    ms, n, rank, quiet = (table[c].to_numpy() for c in ("_ms", "_n", "_rn", "_quiet"))
    rows, lo, hi = len(ms), edges[:-1], edges[1:]
    piece = np.repeat(np.arange(len(lo)), hi - lo)
    each = n if lim.count is not None else np.ones(rows, np.int64)
    first = np.r_[0, np.cumsum(each)]  # the first place of each row
    row = np.repeat(np.arange(rows), each)
    own = np.arange(len(row))
    end = first[hi][piece[row]]
    following = end.copy()
    if lim.age is not None and rows:
        base = ms.min()
        span = int(ms.max() - base) + lim.age + 2
        axis = piece * span + (ms - base)
        due = np.searchsorted(axis, axis + lim.age)
        following = np.minimum(following, first[due][row])
    if lim.silence is not None:
        calm = np.where(quiet, np.arange(rows), rows)
        calm = np.r_[np.minimum.accumulate(calm[::-1])[::-1], rows][1:]  # the first silence after each row
        following = np.minimum(following, first[calm][row])
    if lim.count is not None:
        following = np.minimum(following, own + lim.count)
    return row, rank[row] + own - first[row], np.where(following < end, following, own)


def slice_maps(batches: Iterator[pa.RecordBatch], lim: Limits) -> Iterator[pa.RecordBatch]:
    """For each place of a piece the last start that follows from it there, and how many starts later that is."""
    for table in _pieces(batches):
        row, rank, last = _places(table, _edges(table), lim)
        hops = (last != np.arange(len(last))).astype(np.int64)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            hops += hops[last]
            last = further
        ms = table["_ms"].to_numpy()
        out = table.select(["_group", "_slice"]).take(pa.array(row))
        for name, values in (("_rn", rank), ("_last", rank[last]), ("_last_ms", ms[row[last]]), ("_hops", hops)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        yield from out.to_batches(OUT_ROWS)


def slice_starts(batches: Iterator[pa.RecordBatch], names: list[str], lim: Limits) -> Iterator[pa.RecordBatch]:
    """The starts of each piece, from its entry (the rank and number in the row with ``_no`` >= 0) on."""
    for table in _pieces(batches):
        no = table["_no"].to_numpy()
        entry = no >= 0
        ticks = table.filter(pa.array(~entry))
        row, rank, following = _places(ticks, _edges(ticks), lim)
        # the tick behind an entry is the first of its piece; ranks rise by row inside the piece
        at = np.flatnonzero(entry)
        opened = at - np.arange(len(at))
        place = np.searchsorted(row, opened)
        offset = table["_rn"].to_numpy()[at]
        following = following.tolist()
        found, number = [], []
        ends = np.searchsorted(row, _edges(ticks))
        for begin, wanted, segment in zip(place.tolist(), offset.tolist(), no[at].tolist(), strict=True):
            stop = int(ends[np.searchsorted(ends, begin, side="right")])
            here = begin + int(np.searchsorted(rank[begin:stop], wanted))
            while True:
                found.append(here)
                number.append(segment)
                segment += 1
                if following[here] == here:
                    break
                here = following[here]
        out = ticks.select([*names, "_ms"]).take(pa.array(row[found] if found else np.zeros(0, np.int64)))
        out = out.append_column("_rn", pa.array(rank[found] if found else [], pa.int64()))
        yield from out.append_column("segment", pa.array(number, pa.int64())).to_batches(OUT_ROWS)


def segment_starts(batches: Iterator[pd.DataFrame], group: list[str], lim: Limits) -> Iterator[pd.DataFrame]:
    """``starts`` over batches of (group columns, _group, _ms, _n) sorted by (_group, _ms)."""
    carry = None  # of the last group: ident, start ms, messages in the segment, segment, rank, last ms
    for pdf in batches:
        if pdf.empty:
            continue
        tick, ms, rank, segment, carry = _advance(
            pdf["_group"].to_numpy(), pdf["_ms"].to_numpy(), pdf["_n"].to_numpy(), lim, carry
        )
        if len(tick):
            out = pdf.iloc[tick][group].reset_index(drop=True)
            yield out.assign(_ms=ms, _rn=rank, segment=segment)


def _advance(idents, ms, n, lim: Limits, carry):
    ticks = len(ms)
    lo = np.r_[0, np.flatnonzero(idents[1:] != idents[:-1]) + 1]
    hi = np.r_[lo[1:], ticks]
    groups = np.arange(len(lo))
    goes_on = carry is not None and carry[0] == idents[0]
    before = np.r_[0, np.cumsum(n)]  # messages of the batch in front of each tick

    base = ms.min()
    span = int(ms.max() - base) + (lim.age or 0) + 2
    axis = np.repeat(groups, hi - lo) * span + (ms - base)

    next_gap = np.full(ticks + 1, ticks)
    if lim.silence is not None:
        quiet = np.r_[False, ms[1:] - ms[:-1] >= lim.silence]
        quiet[lo] = False
        if goes_on:
            quiet[0] = ms[0] - carry[5] >= lim.silence
        at = np.where(quiet, np.arange(ticks), ticks)
        next_gap[:-1] = np.minimum.accumulate(at[::-1])[::-1]

    # the open segment of each group: first clock value, message position (may lie before the batch), number
    start, position = ms[lo].copy(), before[lo].copy()
    number, ranked = np.zeros(len(lo), "int64"), np.zeros(len(lo), "int64")
    gap_from = lo + 1
    found = [(lo, before[lo], number.copy(), groups)]
    if goes_on:
        start[0], position[0], number[0], ranked[0] = carry[1], -carry[2], carry[3], carry[4]
        gap_from[0] = 0
        found = [(lo[1:], before[lo[1:]], number[1:].copy(), groups[1:])]

    live = groups
    while len(live):
        end = hi[live]
        if lim.age is not None:
            due = np.searchsorted(axis, live * span + (start[live] - base) + lim.age)
            end = np.minimum(end, np.maximum(due, lo[live]))
        if lim.silence is not None:
            end = np.minimum(end, next_gap[gap_from[live]])
        upto = before[end]
        first = end.copy()
        ended = end < hi[live]
        if lim.count is not None:
            full = position[live] + lim.count < upto
            upto = np.where(full, position[live] + lim.count, upto)
            first = np.where(full, np.searchsorted(before[1:], upto, side="right"), first)
            ended = ended | full
        live, first, upto = live[ended], first[ended], upto[ended]
        start[live], position[live], gap_from[live] = ms[first], upto, first + 1
        number[live] += 1
        found.append((first, upto, number[live].copy(), live))

    tick, place, segment, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    rank = ranked[owner] + place - before[lo[owner]] + 1
    g = len(lo) - 1
    carry = (idents[-1], start[g], before[-1] - position[g], number[g], ranked[g] + before[-1] - before[lo[g]], ms[-1])
    return tick, ms[tick], rank, segment, carry
