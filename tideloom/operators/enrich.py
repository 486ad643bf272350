"""Enrichment through a remote table: batched lookups with retry, rate limit, cache and concurrency.

A *read function* takes a list of key tuples and returns ``{key tuple: {column: value}}``; missing
keys are left out. A *write function* takes a list of records. Both are made per task by a factory, so
connections are opened where they are used.
"""

from __future__ import annotations

import itertools
import random
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.batches import DaemonPool, arrow_schema, batch_of
from tideloom.session import shared_folder

Read = Callable[[list[tuple]], dict[tuple, dict]]


def _any_error(error: Exception) -> bool:
    return True


@dataclass(frozen=True)
class Retry:
    """When and how often to call again."""

    attempts: int = 3
    backoff: str = "exponential"  # none | fixed | random | exponential
    delay_ms: int = 10
    max_delay_ms: int = 1_000
    jitter_ms: int = 0
    retriable: Callable[[Exception], bool] = _any_error
    factor: float = 2.0  # of the exponential backoff
    stop_after_ms: float | None = None  # total time since the first call after which there is no other

    def wait_s(self, failures: int) -> float:
        if self.backoff == "none":
            wait = 0
        elif self.backoff == "fixed":
            wait = self.delay_ms
        elif self.backoff == "random":
            wait = random.uniform(self.delay_ms, self.max_delay_ms)
        elif self.backoff == "exponential":
            wait = self.delay_ms * self.factor ** (failures - 1)
        else:
            raise ValueError(f"no backoff {self.backoff!r}")
        return (min(wait, self.max_delay_ms) + random.uniform(0, self.jitter_ms)) / 1000

    def run(self, call: Callable, *args, clock=time.monotonic, sleep=time.sleep):
        begun = clock()
        for failures in range(1, self.attempts + 1):
            try:
                return call(*args)
            except Exception as error:
                if failures == self.attempts or not self.retriable(error):
                    raise
                wait = self.wait_s(failures)
                if self.stop_after_ms is not None and (clock() - begun + wait) * 1000 > self.stop_after_ms:
                    raise
                sleep(wait)


def _one_credit(key) -> int:
    return 1


@dataclass(frozen=True)
class RateLimit:
    """Credits per second over all tasks, and what one key or record costs."""

    per_second: float
    credits: Callable[[object], int] = _one_credit


class TokenBucket:
    """One task's share of a rate limit. Starts empty, holds at most one second of credits."""

    def __init__(self, per_second: float, clock=time.monotonic, sleep=time.sleep) -> None:
        self._rate, self._clock, self._sleep = per_second, clock, sleep
        self._free, self._at = 0.0, clock()
        self._lock = threading.Lock()

    def take(self, credits: float) -> None:
        """Wait until the credits are there. Threads share the bucket: each waits for what it took."""
        with self._lock:
            now = self._clock()
            self._free = min(self._rate, self._free + (now - self._at) * self._rate)
            self._at = now
            self._free -= credits
            short = -self._free
        if short > 0:
            self._sleep(short / self._rate)


class Cache:
    """Least recently used entries; also remembers missing keys. An entry ends ``ttl_s`` after it was written and
    ``idle_ttl_s`` after it was last read or written."""

    def __init__(self, max_size: int, ttl_s: float | None = None, clock=time.monotonic, idle_ttl_s: float | None = None) -> None:
        self._max, self._ttl, self._idle, self._clock = max_size, ttl_s, idle_ttl_s, clock
        self._entries: OrderedDict = OrderedDict()

    def get(self, key):
        """(found, value)"""
        hit = self._entries.get(key)
        if hit is None:
            return False, None
        written, used, value = hit
        now = self._clock()
        if (self._ttl is not None and now - written >= self._ttl) or (self._idle is not None and now - used >= self._idle):
            del self._entries[key]
            return False, None
        self._entries[key] = (written, now, value)
        self._entries.move_to_end(key)
        return True, value

    def put(self, key, value) -> None:
        now = self._clock()
        self._entries[key] = (now, now, value)
        self._entries.move_to_end(key)
        while len(self._entries) > self._max:
            self._entries.popitem(last=False)

    def drop(self, key) -> None:
        self._entries.pop(key, None)


class CachedTable:
    """A remote table behind a cache, for use in a task: ``read(keys) -> dict`` and ``write(entries)``, an entry of None
    being a delete.

    Writes go to the remote table first. Written through, they are then in the cache; written around, the cache forgets
    the key, and the next read fetches what the remote table made of it.
    """

    def __init__(self, read: Callable[[list], dict], write: Callable[[dict], object], cache: Cache, through: bool = True) -> None:
        self._read, self._write, self._cache, self._through = read, write, cache, through

    def get_all(self, keys: Sequence) -> dict:
        return self.get_marked(keys)[0]

    def get_marked(self, keys: Sequence) -> tuple[dict, list]:
        """The entries, and the keys that were not in the cache and had to be fetched."""
        found, missing = {}, []
        for key in dict.fromkeys(keys):
            hit, value = self._cache.get(key)
            if hit:
                found[key] = value
            else:
                missing.append(key)
        if missing:
            fetched = self._read(missing)
            for key in missing:
                found[key] = fetched.get(key)
                self._cache.put(key, found[key])
        return found, missing

    def put_all(self, entries: dict) -> None:
        self._write(entries)
        for key, value in entries.items():
            if self._through:
                self._cache.put(key, value)
            else:
                self._cache.drop(key)


@dataclass(frozen=True)
class Access:
    """How a remote table is called."""

    batch_size: int = 100
    concurrency: int = 1
    retry: Retry | None = None
    limit: RateLimit | None = None
    tasks: int = 8  # tasks that share the rate limit


def _caller(call: Callable, access: Access) -> Callable[[list], object]:
    bucket = TokenBucket(access.limit.per_second / access.tasks) if access.limit else None

    def attempt(items: list):
        if bucket:  # a repeated call costs as much as the first
            bucket.take(sum(access.limit.credits(i) for i in items))
        return call(items)

    return (lambda items: access.retry.run(attempt, items)) if access.retry else attempt


def _dealt(df: DataFrame, access: Access) -> DataFrame:
    """A rate limit is divided among ``access.tasks``: no more of them may run."""
    return df.repartition(access.tasks) if access.limit else df


def _batched(calls: Callable, items: list, access: Access) -> Iterator:
    chunks = [items[i : i + access.batch_size] for i in range(0, len(items), access.batch_size)]
    if access.concurrency == 1:
        yield from map(calls, chunks)
        return
    with DaemonPool(access.concurrency) as pool:
        waiting: deque = deque()
        for chunk in chunks:
            if len(waiting) >= access.concurrency:
                yield waiting.popleft().result()
            waiting.append(pool.submit(calls, chunk))
        while waiting:
            yield waiting.popleft().result()


def _keys_of(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple]:
    """Key tuples with plain Python values; missing parts are None."""
    return list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))


def _schema(df: DataFrame, columns: Sequence[str], extra: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + T.StructType.fromDDL(extra).fields)


def lookup(keys_df: DataFrame, keys: Sequence[str], make: Callable[[], Read], values: str, access: Access) -> DataFrame:
    """Remote values of the keys in ``keys_df`` (distinct, each looked up once); missing keys are left out."""
    names = T.StructType.fromDDL(values).names
    schema = _schema(keys_df, keys, values)

    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _caller(make(), access)
        for batch in batches:
            for found in _batched(read, _keys_of(batch, keys), access):
                if found:
                    rows = [dict(zip(keys, k)) | {n: v.get(n) for n in names} for k, v in found.items()]
                    yield batch_of(rows, wanted)

    return keys_df.mapInArrow(run, schema)


def enrich(
    df: DataFrame,
    keys: Sequence[str],
    make: Callable[[], Read],
    values: str,
    how: str = "left",
    access: Access = Access(),
    keep: bool = False,
) -> DataFrame:
    """Join ``df`` with a remote table: each distinct key is looked up once, then joined back.

    The distinct step is the cache: a hot key costs one call however many rows have it. Keys whose
    parts are all null are not looked up. ``keep=True`` writes the answers to the shared folder first,
    so that a lost executor does not repeat the calls.
    """
    wanted = df.select(*keys).dropna("all").distinct()
    found = lookup(_dealt(wanted, access), keys, make, values, access)
    if keep:
        path = shared_folder(df.sparkSession, "lookup")
        found.write.parquet(path)
        found = df.sparkSession.read.parquet(path)
    renamed = found.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if len(keys) == 1:
        same = [F.col(keys[0]) == F.col(f"_k_{keys[0]}")]
    else:
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def enrich_in_place(
    df: DataFrame,
    keys: Sequence[str],
    make: Callable[[], Read],
    values: str,
    how: str = "left",
    access: Access = Access(),
    cache_size: int = 10_000,
    cache_ttl_s: float | None = None,
) -> DataFrame:
    """The same without any shuffle, for streams: each task looks up the distinct new keys of a batch
    and keeps a cache of bounded size."""
    value_schema = T.StructType.fromDDL(values)
    names = value_schema.names
    schema = _schema(df, df.columns, values)

    wanted = arrow_schema(value_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _caller(make(), access)
        cache = Cache(cache_size, cache_ttl_s)
        for batch in batches:
            row_keys = _keys_of(batch, keys)
            known: dict[tuple, dict | None] = {}
            for k in dict.fromkeys(row_keys):
                hit, value = cache.get(k)
                if hit or all(part is None for part in k):
                    known[k] = value
            missing = [k for k in dict.fromkeys(row_keys) if k not in known]
            for found in _batched(read, missing, access):
                known.update(found)
            for k in missing:
                known.setdefault(k, None)
                cache.put(k, known[k])
            extra = batch_of([{n: (known[k] or {}).get(n) for n in names} for k in row_keys], wanted)
            out = pa.RecordBatch.from_arrays([*batch.columns, *extra.columns], names=[*batch.schema.names, *names])
            yield out.filter(pa.array([known[k] is not None for k in row_keys])) if how == "inner" else out

    return _dealt(df, access).mapInArrow(run, schema)


def cached_access(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make: Callable[[], object],
    *,
    op: str = "op",
    value: str = "value",
    through: bool = True,
    cache_size: int = 10_000,
    cache_ttl_s: float | None = None,
    access: Access = Access(),
) -> DataFrame:
    """Reads and writes of a remote table through a cache, in ``order`` for each key.

    ``op`` is read, write (of ``value``) or delete; ``make`` opens the table: ``read(keys) -> {key: value}`` and
    ``write({key: value or None})``. Adds to each row ``answer``, the value read, and ``hit``, whether the cache had it;
    both are null for writes, deletes and keys with a null part, which do not reach the table. ``through`` keeps what was
    written in the cache, otherwise the next read of the key fetches what the table made of it.

    All rows of a key are in one task, as each depends on the one before; they stream through it in constant memory.
    Neighbouring rows that all read are fetched in batches of distinct keys, neighbouring writes are written as one. A lost
    task repeats its writes, so they have to be idempotent.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("answer", df.schema[value].dataType), T.StructField("hit", T.BooleanType())])
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remote = make()
        read = _caller(remote.read, access)
        fetch = lambda ks: {k: v for part in _batched(read, ks, access) for k, v in part.items()}
        table = CachedTable(fetch, _caller(remote.write, access), Cache(cache_size, cache_ttl_s), through)
        for batch in batches:
            rows = list(zip(_keys_of(batch, keys), batch.column(op).to_pylist(), batch.column(value).to_pylist(), strict=True))
            answers, hits = [None] * len(rows), [None] * len(rows)
            whole = [i for i, (key, _, _) in enumerate(rows) if None not in key]
            for reading, run_of in itertools.groupby(whole, key=lambda i: rows[i][1] == "read"):
                places = list(run_of)
                if not reading:
                    table.put_all({rows[i][0]: rows[i][2] if rows[i][1] == "write" else None for i in places})
                    continue
                found, missing = table.get_marked([rows[i][0] for i in places])
                fresh = set(missing)
                for i in places:
                    answers[i], hits[i] = found[rows[i][0]], rows[i][0] not in fresh
                    fresh.discard(rows[i][0])  # a repeated read of the run comes from the cache
            columns = [*batch.columns, pa.array(answers, wanted.field("answer").type), pa.array(hits, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=wanted.names)

    dealt = df.repartition(access.tasks, *keys) if access.limit else df.repartition(*keys)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, schema)


def write_remote(
    df: DataFrame, make: Callable[[], Callable[[list[dict]], int]], access: Access = Access()
) -> DataFrame:
    """Write all rows through a write function, in batches; one row (batches, written) per task.

    Lazy: the writes happen when the result is read. A lost task writes again, so writes have to be
    idempotent upserts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = _caller(make(), access)
        calls = written = 0
        for batch in batches:
            for n in _batched(write, batch.to_pylist(), access):
                calls, written = calls + 1, written + n
        yield pa.RecordBatch.from_pydict({"batches": pa.array([calls], pa.int64()), "written": pa.array([written], pa.int64())})

    return _dealt(df, access).mapInArrow(run, "batches bigint, written bigint")


def bulk_upsert(
    df: DataFrame, make: Callable[[], Callable[[list[dict]], list[str]]], access: Access = Access()
) -> DataFrame:
    """Bulk upsert into an index. The writer gives one outcome per request: insert, update, conflict
    or failed. Conflicts (an older version came late) are counted; a failure fails the task once its
    batches are flushed. One row (outcome, n) per task and outcome; lazy like :func:`write_remote`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = _caller(make(), access)
        seen: dict[str, int] = {}
        for batch in batches:
            for outcomes in _batched(write, batch.to_pylist(), access):
                for outcome in outcomes:
                    seen[outcome] = seen.get(outcome, 0) + 1
        if seen.get("failed"):
            raise RuntimeError(f"{seen['failed']} requests failed")
        columns = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["outcome", "n"])

    return _dealt(df, access).mapInArrow(run, "outcome string, n bigint")
