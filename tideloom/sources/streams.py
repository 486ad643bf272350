"""Streams: where they start, how they are keyed, and the live form of a stored table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.session import table


def envelope(df: DataFrame, key: Column, value: Column, offset: Column, event_time: Column) -> DataFrame:
    """Rows as keyed messages. A message without payload is dropped."""
    return df.select(
        key.alias("key"), value.alias("value"), offset.alias("offset"), event_time.alias("event_time")
    ).filter(F.col("value").isNotNull())


def from_oldest(df: DataFrame) -> DataFrame:
    return df


def from_offset(df: DataFrame, offset: str, start) -> DataFrame:
    """Start at an offset (inclusive). The filter reaches the scan."""
    return df.filter(F.col(offset) >= start)


def from_offsets(df: DataFrame, partition: Column, offset: str, starts: dict[int, int]) -> DataFrame:
    """A start offset per partition; partitions without one are read from their oldest message."""
    rule = F.lit(True)
    for number, start in starts.items():
        rule = rule & ((partition != number) | (F.col(offset) >= start))
    return df.filter(rule)


def from_timestamp(df: DataFrame, ts: str, start: Column) -> DataFrame:
    """Start at the first message at or after a time."""
    return df.filter(F.col(ts) >= start)


def from_upcoming(df: DataFrame, offset: str, known: DataFrame) -> DataFrame:
    """Only what comes after everything in ``known`` (the table as it was when the reader was set up)."""
    return df.filter(F.col(offset) > F.coalesce(known.agg(F.max(offset)).scalar(), F.lit(-1)))


def broker_start(
    startpoint: str, partitions: dict[str, dict[int, int]] | None = None, timestamp_ms: int | None = None
) -> dict[str, str]:
    """Reader options of a log-broker source for a startpoint: oldest, upcoming, offset or timestamp.

    ``partitions`` gives the offset per topic and partition. A checkpoint, where there is one, wins
    over these options; a reset is a new checkpoint folder.
    """
    if startpoint == "oldest":
        return {"startingOffsets": "earliest"}
    if startpoint == "upcoming":
        return {"startingOffsets": "latest"}
    if startpoint == "offset":
        return {"startingOffsets": json.dumps({t: {str(p): o for p, o in ps.items()} for t, ps in partitions.items()})}
    if startpoint == "timestamp":
        return {"startingTimestamp": str(timestamp_ms), "startingOffsetsByTimestampStrategy": "latest"}
    raise ValueError(f"no startpoint {startpoint!r}")


def live(
    spark: SparkSession, folder: str, name: str, max_files: int | None = None, max_bytes: int = 64 * 1024**3
) -> DataFrame:
    """A stored parquet table (one file or a folder of files) as a live stream.

    A micro-batch takes files, oldest first, up to ``max_bytes`` (or ``max_files`` of them).
    """
    path = f"{folder.rstrip('/')}/{name}.parque[t]"  # a glob, so that a single file is a valid source
    reader = spark.readStream.schema(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema)
    if max_files is None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    else:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def memory_stream(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small in-memory collection as a bounded stream."""
    return spark.createDataFrame(rows, schema)


class NamedSources:
    """Sources by name. A source may be an expander: a function of (read, spark, folder) that builds its rows from other
    sources, which it reads by name with ``read(name)``."""

    def __init__(self) -> None:
        self._expanders: dict[str, object] = {}

    def expand(self, name: str):
        """Decorator: the pipeline that stands behind ``name``."""

        def add(build):
            if name in self._expanders:
                raise ValueError(f"source {name} is there already")
            self._expanders[name] = build
            return build

        return add

    def read(self, spark: SparkSession, folder: str, name: str, _open: tuple[str, ...] = ()) -> DataFrame:
        """The rows of a source: an expander's, or else those of the table of that name in the folder."""
        if name in _open:
            raise ValueError(f"sources expand to each other: {' -> '.join([*_open, name])}")
        build = self._expanders.get(name)
        if build is None:
            return table(spark, folder, name)
        return build(lambda other: self.read(spark, folder, other, (*_open, name)), spark, folder)
