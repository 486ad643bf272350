"""Stateless steps: map, flat map, merge, partition, broadcast, fan out, bypass."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.batches import DaemonPool, arrow_schema, batch_of
from tideloom.functions.times import col


def map_rows(df: DataFrame, *columns: Column, payload: str | None = None) -> DataFrame:
    """1:1 projection. A row whose ``payload`` becomes null is dropped."""
    mapped = df.select(*columns)
    return mapped if payload is None else mapped.filter(F.col(payload).isNotNull())


def flat_map(df: DataFrame, items: Column, out: str, *keep: str) -> DataFrame:
    """1:n: one row per element of the array ``items``."""
    return df.select(*keep, F.explode(items).alias(out))


def merge_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, others, first)


def partition_number(method: str, key, n: int) -> Column:
    """Output partition of a message: ``key`` (the key is the number) or ``hash`` of the key. Null keys go to 0."""
    if method == "key":
        number = F.pmod(col(key), F.lit(n))
    elif method == "hash":
        number = F.when(col(key).isNotNull(), F.pmod(F.xxhash64(col(key)), F.lit(n)))
    else:
        raise ValueError(f"no partitioning method {method!r}")
    return F.coalesce(number.cast("int"), F.lit(0))


def partition_by(df: DataFrame, n: int, key=None, method: str = "hash", spread: int = 1) -> DataFrame:
    """Lay rows out in ``n`` output partitions. Without a key they go round robin.

    Joins and aggregates need no such call, Spark shuffles for them. ``spread`` gives each output
    partition that many tasks (rows salted by their content), so a hot key is not written by one task.
    The column ``partition`` has the output partition's number.
    """
    if key is None:
        return df.repartition(n)
    numbered = df.withColumn("partition", partition_number(method, key, n))
    if spread == 1:
        return numbered.repartitionById(n, F.col("partition"))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread)).cast("int")
    return numbered.repartitionById(n * spread, F.col("partition") * spread + salt)


def fan_out_copies(df: DataFrame, instances: int) -> DataFrame:
    """Every message once for each of a fixed number of downstream instances."""
    return df.withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(instances - 1))))


def routes(df: DataFrame, rules: dict[str, Column]) -> dict[str, DataFrame]:
    """Several chains from one stream, by predicate."""
    return {name: df.filter(rule) for name, rule in rules.items()}


def tagged_routes(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The same in one pass over ``df``: a row appears once for each rule it meets, with ``route``."""
    hit = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return df.withColumn("route", F.explode(hit))


def bypass(df: DataFrame, is_system: Column, step: Callable[[DataFrame], DataFrame], enabled: bool = True) -> DataFrame:
    """System messages skip ``step`` and go straight to its output (as far as it has their columns)."""
    flag = F.coalesce(is_system, F.lit(False))
    processed = step(df.filter(~flag))
    if not enabled:
        return processed
    system = df.filter(flag)
    shared = [c for c in processed.columns if c in system.columns]
    return processed.unionByName(system.select(*shared), allowMissingColumns=True)


def flat_map_async(
    df: DataFrame,
    make: Callable[[], Callable[[dict], Iterable[dict]]],
    schema: str,
    max_concurrency: int = 8,
    timeout_s: float = 30.0,
    records_per_turn: int = 16,
    tasks: int | None = None,
) -> DataFrame:
    """1:n through a slow call, with up to ``max_concurrency`` calls in flight per task.

    ``make`` runs once per task and returns the call (its ``close``, if any, runs at the end). A thread
    takes ``records_per_turn`` records at a time. An error, or a turn that takes longer than
    ``timeout_s`` per record, fails the task at once, and Spark retries it. Records have plain Python values, None for null. ``tasks`` deals the rows out evenly
    first, for inputs with few partitions.
    """

    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()

        def turn(records: list[dict]) -> list[dict]:
            return [out for record in records for out in call(record)]

        try:
            with DaemonPool(max_concurrency) as pool:
                for batch in batches:
                    waiting, out = deque(), []
                    records = batch.to_pylist()
                    for i in range(0, len(records), records_per_turn):
                        if len(waiting) >= max_concurrency:
                            out.extend(waiting.popleft().result(timeout_s * records_per_turn))
                        waiting.append(pool.submit(turn, records[i : i + records_per_turn]))
                    while waiting:
                        out.extend(waiting.popleft().result(timeout_s * records_per_turn))
                    if out:
                        yield batch_of(out, wanted)
        finally:
            close = getattr(call, "close", None)
            if close:
                close()

    if tasks is not None:
        df = df.repartition(tasks)
    return df.mapInArrow(run, schema)
