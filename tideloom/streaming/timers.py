"""User functions with timers and with a watermark of their own, on Spark's state store.

Messages of a key wait in its state until the watermark has passed their clock, then messages and timers are taken in clock
order (a timer due at t before a message with clock t), each once. So results do not depend on how the input was cut into
micro-batches, as long as messages come within the delay, and a timer never fires before the watermark has passed it. Spark
calls a key when it has new messages or when the least of its due times and waiting clocks has passed (an event-time timer).
However many messages of a key wait or arrive in one micro-batch, a call holds a bounded part of them: they lie in the state
store as sorted runs cut into small parts, and a merge of the runs takes them out in order.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideloom.functions.times import duration_ms, millis
from tideloom.session import CLUSTER_CONF

# A run is sorted in memory before it is stored in parts; a merge holds one part of each run.
RUN_BYTES, PART_BYTES, PART_ROWS, MAX_RUNS = 16 * 1024**2, 256 * 1024, 1000, 64
# What waits and is no larger than this stays with the key's other state.
TAIL_BYTES = 64 * 1024
OUTPUT_ROWS = 2000


class Context:
    """What the functions of one key may see and do.

    ``key`` is the key, ``now`` the clock of the message or timer in ms, ``state`` anything that JSON can hold (None at first).
    """

    def __init__(self, key, state, timers: dict[str, int]):
        self.key, self.state, self.now = key, state, None
        self._timers, self._due = timers, [(at, name) for name, at in timers.items()]
        heapq.heapify(self._due)
        self._rows: list[tuple] = []

    def schedule(self, name: str, at: int) -> None:
        """Call back at clock ``at``; an earlier schedule of that name is replaced. A clock that has passed is due at once."""
        if self._timers.get(name) == (at := int(at)):
            return
        self._timers[name] = at
        heapq.heappush(self._due, (at, name))
        if len(self._due) > 2 * len(self._timers) + 1000:  # mostly deleted or rescheduled ones
            self._due = [(at, name) for name, at in self._timers.items()]
            heapq.heapify(self._due)

    def delete(self, name: str) -> None:
        """Forget the timer of that name, if there is one."""
        self._timers.pop(name, None)

    def emit(self, *values) -> None:
        """Add a row to the output."""
        self._rows.append(values)

    def next_timer(self) -> int | None:
        while self._due and self._timers.get(self._due[0][1]) != self._due[0][0]:
            heapq.heappop(self._due)  # deleted or rescheduled since
        return self._due[0][0] if self._due else None

    def take_timer(self) -> tuple[int, str]:
        at, name = heapq.heappop(self._due)
        del self._timers[name]
        return at, name


OnMessage = Callable[[Context, dict], None]
OnTimer = Callable[[Context, str, int], None]

_KEPT = T.StructType().add("due", T.LongType())
for _name, _kind in {"timers": T.StringType, "user": T.StringType, "runs": T.StringType, "tail": T.BinaryType, "key": T.BinaryType}.items():
    _KEPT.add(_name, _kind())
_PLACE, _PART = T.StructType().add("run", T.LongType()).add("part", T.LongType()), T.StructType().add("rows", T.BinaryType())


def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Waiting:
    """The messages of one key that wait, in order of (clock, tie).

    ``parts`` (by run and part) are in the state store; a run says which of its parts are left, how many rows of the first of
    them are taken already (``skip``) and the clock of the next row. The ``tail`` is not stored yet, or too small for a run.
    """

    def __init__(self, parts, runs: list[dict], tail: bytes | None, tie: Sequence[str], whole: Sequence[str]):
        self.parts, self.runs, self.tie, self.whole = parts, runs, list(tie), whole
        self.tail = [_unpack(tail)] if tail else []
        self._bytes = sum(t.nbytes for t in self.tail)

    def add(self, rows: pa.Table) -> None:
        self.tail.append(rows)
        self._bytes += rows.nbytes
        if self._bytes >= RUN_BYTES:
            self._store()

    def take(self, before: int) -> Iterator[dict]:
        """The messages before a clock; what is taken is no longer there."""
        tail = self._sorted()
        passed = _passed(tail, before)
        self.tail = [tail.slice(passed)] if passed < len(tail) else []
        self._bytes = sum(t.nbytes for t in self.tail)
        sources = [(run, None) for run in self.runs if run["clock"] < before] + [(None, tail.slice(0, passed))] * (passed > 0)
        merged = len(sources) > 1
        streams = [self._read(run, before, self._messages, merged) if run else self._rows(rows, self._messages, merged) for run, rows in sources]
        for _, message in heapq.merge(*streams, key=itemgetter(0)) if merged else itertools.chain(*streams):
            yield message
        self.runs = [run for run in self.runs if run["first"] < run["end"]]

    def clock(self) -> int | None:
        """The least clock that waits, after :meth:`take`."""
        return min([run["clock"] for run in self.runs] + [t["_clock"][0].as_py() for t in self.tail], default=None)

    def kept(self) -> bytes | None:
        """The tail, to be held with the key; a large one becomes a run."""
        if self._bytes > TAIL_BYTES:
            self._store()
        while len(self.runs) > MAX_RUNS:
            self._merge_runs()
        return _pack(self.tail[0]) if self.tail else None

    def _sorted(self) -> pa.Table:
        rows = pa.concat_tables(self.tail, promote_options="permissive") if self.tail else pa.table({"_clock": pa.array([], pa.int64())})
        return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("_clock", *self.tie)])) if len(rows) > 1 else rows

    def _store(self) -> None:
        rows, self.tail, self._bytes = self._sorted(), [], 0
        size = max(1, min(PART_ROWS, PART_BYTES * len(rows) // max(1, rows.nbytes)))
        self._write(rows.slice(at, size) for at in range(0, len(rows), size))

    def _write(self, parts: Iterable[pa.Table]) -> None:
        run = {"run": max((r["run"] for r in self.runs), default=-1) + 1, "first": 0, "end": 0, "skip": 0, "clock": None, "rows": 0}
        for rows in parts:
            if run["clock"] is None:
                run["clock"] = rows["_clock"][0].as_py()
            self.parts.updateValue((run["run"], run["end"]), (_pack(rows),))
            run["end"] += 1
            run["rows"] += len(rows)
        self.runs.append(run)

    def _merge_runs(self) -> None:
        """The smaller half of the runs becomes one run."""
        some = sorted(self.runs, key=itemgetter("rows"))[: max(2, MAX_RUNS // 2)]
        rows = (row for _, row in heapq.merge(*(self._read(run, None, _single, True) for run in some), key=itemgetter(0)))

        def parts() -> Iterator[pa.Table]:
            block, size = [], 0
            for row in rows:
                block.append(row)
                size += row.nbytes
                if len(block) >= PART_ROWS or size >= PART_BYTES:
                    yield pa.concat_tables(block, promote_options="permissive").combine_chunks()
                    block, size = [], 0
            if block:
                yield pa.concat_tables(block, promote_options="permissive").combine_chunks()

        self._write(parts())
        self.runs = [run for run in self.runs if run["first"] < run["end"]]

    def _read(self, run: dict, before: int | None, items: Callable[[pa.Table], list], keyed: bool) -> Iterator[tuple]:
        while run["first"] < run["end"]:
            place = run["run"], run["first"]
            rows = _unpack(self.parts.getValue(place)[0]).slice(run["skip"])
            passed = len(rows) if before is None else _passed(rows, before)
            yield from self._rows(rows.slice(0, passed), items, keyed)
            if passed < len(rows):
                run["skip"], run["clock"] = run["skip"] + passed, rows["_clock"][passed].as_py()
                return
            self.parts.removeKey(place)
            run["first"], run["skip"] = run["first"] + 1, 0

    def _rows(self, rows: pa.Table, items: Callable[[pa.Table], list], keyed: bool) -> Iterator[tuple]:
        """Pairs of sort key (where there is something to merge with) and item."""
        for at in range(0, len(rows), PART_ROWS):
            some = rows.slice(at, PART_ROWS)
            keys = self._keys(some) if keyed else itertools.repeat(None)
            yield from zip(keys, items(some))

    def _keys(self, rows: pa.Table) -> Iterator[tuple]:
        """As Arrow sorts: not a number after numbers, null after all."""
        ranked = lambda v: (2, 0) if v is None else (1, 0) if v != v else (0, v)
        return zip(_values(rows["_clock"]), *(map(ranked, _values(rows[c])) for c in self.tie))

    def _messages(self, rows: pa.Table) -> list[dict]:
        """Whole numbers exactly, the others as pandas gives them."""
        names, others = rows.column_names, rows.drop_columns(self.whole).to_pandas()
        columns = [_values(rows[c]) if c in self.whole else others[c].tolist() for c in names]
        return [dict(zip(names, values)) for values in zip(*columns)]


def _passed(rows: pa.Table, before: int) -> int:
    return int(np.searchsorted(rows["_clock"].to_numpy(), before))


def _values(column: pa.ChunkedArray) -> list:
    """Whole numbers by way of numpy, which is faster and exact where none is null."""
    return column.to_numpy().tolist() if column.type == pa.int64() and not column.null_count else column.to_pylist()


def _single(rows: pa.Table) -> list[pa.Table]:
    return [rows.slice(i, 1) for i in range(len(rows))]


class _Step(StatefulProcessor):
    """Calls the user functions of a key for what the watermark has passed."""

    def __init__(self, columns, key, tie, whole, on_message, on_timer, output):
        self.columns, self.key, self.tie, self.whole = columns, key, tie, whole
        self.on_message, self.on_timer, self.output = on_message, on_timer, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _KEPT)
        self.parts = handle.getMapState("parts", _PLACE, _PART)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._call(key[0], rows, timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._call(key[0], (), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _call(self, key, frames: Iterable[pd.DataFrame], mark: int, expired: int | None) -> Iterator[pd.DataFrame]:
        found = self.kept.get()
        due, timers, user, runs, tail, given = found or (None,) * 6
        context = Context(key, json.loads(user) if user else None, json.loads(timers) if timers else {})
        waiting = Waiting(self.parts, json.loads(runs) if runs else [], tail, self.tie, self.whole)
        for frame in frames:
            rows = self._table(frame)
            if len(rows):
                waiting.add(rows)
                if "_group" in self.columns and given is None:
                    given = _pack(rows.select([self.key]).slice(0, 1))
        if given is not None:
            context.key = _unpack(given).to_pandas()[self.key].tolist()[0]
        for message in waiting.take(mark):
            clock = message.pop("_clock")
            while _fire(context, self.on_timer, clock + 1):
                yield self._emitted(context)
            context.now = clock
            self.on_message(context, message)
            if len(context._rows) >= OUTPUT_ROWS:
                yield self._emitted(context)
        while _fire(context, self.on_timer, mark):
            yield self._emitted(context)
        if context._rows:
            yield self._emitted(context)
        tail = waiting.kept()
        least = min((t for t in (context.next_timer(), waiting.clock()) if t is not None), default=None)
        after = None if least is None else max(least, mark + 1)
        if after is not None or context.state is not None:
            self.kept.update((after, json.dumps(context._timers), json.dumps(context.state), json.dumps(waiting.runs), tail, given))
        elif found:
            self.kept.clear()
        if due != after:
            if due is not None and due != expired:  # Spark forgets an expired one
                self.handle.deleteTimer(due)
            if after is not None:
                self.handle.registerTimer(after)

    def _table(self, frame: pd.DataFrame) -> pa.Table:
        frame.columns = self.columns  # Spark renames those that begin with _
        frame = frame[frame["_clock"].notna()].drop(columns=["_event", "_group"], errors="ignore").astype({"_clock": "int64"})
        rows = pa.Table.from_pandas(frame, preserve_index=False)
        for name in self.whole:
            rows = rows.set_column(rows.column_names.index(name), name, rows[name].cast(pa.int64()))
        return rows

    def _emitted(self, context: Context) -> pd.DataFrame:
        rows, context._rows = context._rows, []
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.output, zip(*rows))})


def with_timers(
    stream: DataFrame,
    key: str,
    ts: str,
    tie: Sequence[str],
    delay: str,
    on_message: OnMessage,
    on_timer: OnTimer,
    output: str,
    watermark: str | None = None,
) -> DataFrame:
    """Rows that the functions emit (columns ``output``), as an append-mode stream.

    ``on_message(context, row)`` is called for every message of a key in order of (ts, tie), ``on_timer(context, name, due)``
    for every timer. ``watermark`` names another column that carries the watermark, as :func:`with_watermark` gives one.
    The state needs Spark's RocksDB store: it is set for the session. Messages without a key or a clock are left out; a null double reads as NaN. Messages that come after the watermark has passed their clock are taken at once.
    """
    names, columns = [c for c in stream.columns if c != watermark], T._parse_datatype_string(output).names
    # rows without a clock may still carry a watermark
    rows = stream.filter(F.col(key).isNotNull() if watermark else F.col(key).isNotNull() & F.col(ts).isNotNull())
    # as text, since pandas would make doubles of whole numbers with nulls among them
    whole = [c for c, kind in stream.dtypes if c in names and kind in ("tinyint", "smallint", "int", "bigint")]
    given = [F.col(c).cast("string").alias(c) if c in whole and c != key else F.col(c) for c in names]
    rows = rows.select(*given, millis(ts).alias("_clock"), F.col(watermark or ts).cast("timestamp").alias("_event"))
    whole = [c for c in whole if c != key]
    for name, value in CLUSTER_CONF.items():  # Spark keeps lists and timers in this store only, so in a local session too
        if stream.sparkSession.conf.get(name, None) != value:
            stream.sparkSession.conf.set(name, value)
    by = key
    if dict(stream.dtypes)[key].startswith(("timestamp", "struct", "array")):
        # a timer's call would get such a key in another form than a message's: it is grouped as text and kept beside the state
        by, exact = "_group", {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
        rows = rows.withColumn(by, F.to_json(F.struct(key), exact))
    step = _Step(rows.columns, key, list(tie), whole, on_message, on_timer, columns)
    return rows.withWatermark("_event", delay).groupBy(by).transformWithStateInPandas(step, output, "append", "EventTime")


def _fire(context: Context, on_timer: OnTimer, before: int) -> bool:
    """Timers due before a clock, also those that they schedule themselves. True: there are rows to put out first."""
    while (at := context.next_timer()) is not None and at < before:
        context.now = at
        on_timer(context, context.take_timer()[1], at)
        if len(context._rows) >= OUTPUT_ROWS:
            return True
    return False


OnWatermark = Callable[[Context, int], "int | None"]


def with_watermark(
    stream: DataFrame,
    key: str,
    ts: str,
    tie: Sequence[str],
    delay: str,
    every: str,
    on_message: OnMessage,
    on_watermark: OnWatermark,
    output: str,
) -> DataFrame:
    """A step that is told how the watermark goes on, and chooses the watermark of what it gives.

    ``on_watermark(context, mark)`` is called for a key that had messages, at every multiple of ``every`` that the watermark
    passes, after all messages before it. It returns its output watermark in ms (no later row of this key will be older), or
    None to sleep until the next message. Rows that it or ``on_message`` emits are followed by the column ``_mark``; a row of
    nulls beside the key (the first column of ``output``) carries a new output watermark. :func:`follow` reads both.
    """
    span, width = duration_ms(every), len(T._parse_datatype_string(output).names)

    def marked(context: Context, call) -> None:
        before = len(context._rows)
        user, last = context.state or (None, None)
        context.state = user
        chosen = call(context)
        mark = last if chosen is None else chosen if last is None else max(last, chosen)
        if len(context._rows) > before:
            stamp = None if last is None else pd.Timestamp(last, unit="ms", tz="UTC")
            context._rows[before:] = [(*row, stamp) for row in context._rows[before:]]
        if mark != last:
            context._rows.append((context.key, *[None] * (width - 1), pd.Timestamp(mark, unit="ms", tz="UTC")))
        context.state = [context.state, mark]

    def message(context: Context, row: dict) -> None:
        def call(c):
            on_message(c, row)

        marked(context, call)
        if "watermark" not in context._timers:
            context.schedule("watermark", context.now - context.now % span + span)

    def timer(context: Context, name: str, due: int) -> None:
        def call(c):
            chosen = on_watermark(c, due)
            if chosen is not None:
                c.schedule(name, due + span)
            return chosen

        marked(context, call)

    return with_timers(stream, key, ts, tie, delay, message, timer, f"{output}, _mark timestamp")


def follow(
    stream: DataFrame, key: str, ts: str, tie: Sequence[str], on_message: OnMessage, on_timer: OnTimer, output: str, delay: str = "0 seconds"
) -> DataFrame:
    """The next step after :func:`with_watermark`: its timers obey the output watermark, not the clocks of its rows.

    Spark takes one such step per streaming query: put :func:`tideloom.streaming.runs.hand_over` between the two.
    """
    return with_timers(stream, key, ts, tie, delay, on_message, on_timer, output, watermark="_mark")
