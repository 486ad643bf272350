"""Sinks over Spark's writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def send_to(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", **options) -> DataFrame:
    """Write the stream; the same rows go on downstream (the input is returned)."""
    df.write.format(fmt).mode(mode).options(**options).save(path)
    return df


def write_date_buckets(
    df: DataFrame, path: str, ts: str, pattern: str = "yyyy_MM_dd-HH", records_per_file: int = 1_000_000
) -> None:
    """One folder per bucket of the event time.

    The rebalance hint gathers a bucket into few files and lets adaptive execution split a bucket
    that is too large for one task.
    """
    bucketed = df.withColumn("bucket", F.date_format(ts, pattern))
    (
        bucketed.hint("rebalance", F.col("bucket"))
        .write.partitionBy("bucket")
        .option("maxRecordsPerFile", records_per_file)
        .mode("append")
        .parquet(path)
    )


def write_rolled(df: DataFrame, path: str, records: int | None = None, size_bytes: int | None = None, fmt="parquet") -> None:
    """Start a new file after a number of records, or before the file's records exceed a number of bytes.

    By bytes every task numbers its files by a running sum over its records and writes them by (``roll_task``,
    ``roll_file``), which are partition columns of the result: nothing is shuffled, and a file is ended by the first record
    that does not fit. A record larger than the bound has a file of its own. A record counts as its JSON line, so for
    ``fmt="json"`` these are the bytes of the file; other formats encode and compress them further.
    """
    if (records is None) == (size_bytes is None):
        raise ValueError("give either records or size_bytes")
    if records is not None:
        df.write.option("maxRecordsPerFile", records).mode("append").format(fmt).save(path)
        return
    line = F.octet_length(F.to_json(F.struct("*"))) + 1
    places = "roll_task int, roll_file bigint, _place bigint"
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(places).fields)
    sized = df.withColumn("_bytes", line.cast("bigint"))
    rolled = sized.mapInArrow(lambda batches: roll_files(batches, size_bytes, TaskContext.get().partitionId()), schema)
    in_order = rolled.sortWithinPartitions("roll_task", "roll_file", "_place").drop("_place")
    in_order.write.partitionBy("roll_task", "roll_file").mode("append").format(fmt).save(path)


def roll_files(batches: Iterator[pa.RecordBatch], size_bytes: int, task: int) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes of each record in ``_bytes`` -> the records, their file and their place in the task."""
    used = number = place = 0
    for batch in batches:
        upto = np.cumsum(batch.column("_bytes").to_numpy())
        files = np.empty(len(upto), np.int64)
        at = 0
        while at < len(upto):
            before = int(upto[at - 1]) if at else 0
            end = max(at, int(np.searchsorted(upto, before + size_bytes - used, side="right")))
            if end == at:  # the next record does not fit
                if used:
                    number, used = number + 1, 0
                    continue
                end = at + 1
            files[at:end] = number
            used += int(upto[end - 1]) - before
            at = end
        out = batch.drop_columns(["_bytes"])
        places = np.arange(place, place + len(upto))
        place += len(upto)
        for name, values in (("roll_task", pa.array([task] * len(upto), pa.int32())), ("roll_file", files), ("_place", places)):
            out = out.append_column(name, pa.array(values))
        yield out


def write_text(df: DataFrame, path: str, value: Column, codec: str = "none") -> None:
    """Lines of text; codec none, gzip, snappy, bzip2, lz4 or deflate."""
    df.select(value.cast("string").alias("value")).write.option("compression", codec).mode("append").text(path)


def each_batch(path: str, transform: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet"):
    """A ``foreachBatch`` function that may be repeated: a batch replaces its own folder.

    With the stream's checkpoint this makes the output exactly-once. Read it back with
    ``spark.read.parquet(path)``: the batch number is a partition column.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if transform is None else transform(batch)
        out.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

    return write
