"""Rows as Python records with their own types: BIGINT stays exact and null stays None."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from concurrent.futures import Future

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    """The Arrow types that Spark expects back for ``schema``."""
    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def batch_of(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema=schema)


class DaemonPool:
    """Threads for slow calls. Unlike an executor's they never keep a task from failing or a worker from ending."""

    def __init__(self, size: int) -> None:
        self._work: queue.SimpleQueue = queue.SimpleQueue()
        self._size = size
        for _ in range(size):
            threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self) -> None:
        while (item := self._work.get()) is not None:
            future, call, args = item
            if future.set_running_or_notify_cancel():
                try:
                    future.set_result(call(*args))
                except BaseException as error:  # noqa: BLE001  (goes to whoever waits)
                    future.set_exception(error)

    def submit(self, call: Callable, *args) -> Future:
        future: Future = Future()
        self._work.put((future, call, args))
        return future

    def __enter__(self) -> DaemonPool:
        return self

    def __exit__(self, *_) -> None:
        for _ in range(self._size):
            self._work.put(None)
