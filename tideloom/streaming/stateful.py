"""Steps with state per key on live streams: idle reports and task functions.

Both use ``applyInPandasWithState``: Spark keeps the state in its state store and calls a function per
key and micro-batch. Inside a call rows are put in clock order, which makes the result independent of
how in-order input was cut into micro-batches. Idle reports reduce the rows of a key before the
shuffle. A task function gets all rows of its key in a micro-batch: bound them by the admission limit
of the source (``live(..., max_bytes=...)``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideloom.functions.times import duration_ms, millis


def _type_of(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def _sorted(batches: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    parts = [b for b in batches if len(b)]
    if not parts:
        return pd.DataFrame(columns=list(order))
    return pd.concat(parts, ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


def idle_reports(stream: DataFrame, key: str, ts: str, delay: str, idle: str) -> DataFrame:
    """Watermark hook: when a key has been silent for ``idle``, report how many messages it had since
    the report before. Columns key, reported_ms, n.

    Before the shuffle the rows of a key in each Arrow batch are merged into runs (first, last, n), so
    a hot key sends runs over the network and not messages.
    """
    gap = duration_ms(idle)
    key_type = _type_of(stream, key)
    rows = stream.filter(F.col(key).isNotNull()).select(key, millis(ts).alias("_ms"))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values([key, "_ms"], ignore_index=True)
            fresh = (pdf[key] != pdf[key].shift()) | (pdf["_ms"] - pdf["_ms"].shift() >= gap)
            grouped = pdf.groupby(fresh.cumsum(), sort=False)
            out = grouped.agg(**{key: (key, "first"), "_from": ("_ms", "min"), "_to": ("_ms", "max"), "n": (key, "size")})
            yield out.assign(_ts=pd.to_datetime(out["_to"], unit="ms", utc=True))

    merged = rows.mapInPandas(runs, f"`{key}` {key_type}, _from bigint, _to bigint, n bigint, _ts timestamp")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "reported_ms": [last + gap], "n": [n]})
            return
        pdf = _sorted(batches, ["_from", "_to"])
        last, n = state.get if state.exists else (None, 0)
        reports = []
        for start, end, count in zip(pdf["_from"].tolist(), pdf["_to"].tolist(), pdf["n"].tolist()):
            if last is not None and start - last >= gap:
                reports.append((k[0], last + gap, n))
                n = 0
            last, n = end if last is None else max(last, end), n + count
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + gap, state.getCurrentWatermarkMs() + 1))
        if reports:
            yield pd.DataFrame(reports, columns=[key, "reported_ms", "n"])

    return (
        merged.withWatermark("_ts", delay)
        .groupBy(key)
        .applyInPandasWithState(
            step, f"`{key}` {key_type}, reported_ms bigint, n bigint", "last bigint, n bigint", "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def process_by_key(
    stream: DataFrame,
    key: str,
    order: Sequence[str],
    process: Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]],
    output: str,
    state_schema: str,
) -> DataFrame:
    """A task function per key: ``process(key, rows in order, state or None) -> (output, new state)``."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, new = process(k, _sorted(batches, order), state.get if state.exists else None)
        state.update(new)
        if len(out):
            yield out

    return stream.groupBy(key).applyInPandasWithState(
        step, output, state_schema, "append", GroupStateTimeout.NoTimeout
    )
