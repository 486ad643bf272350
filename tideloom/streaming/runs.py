"""Run a streaming DataFrame over all input there is now, and read what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.session import shared_folder
from tideloom.sources.sinks import each_batch


def run_to_table(
    stream: DataFrame,
    name: str,
    mode: str = "append",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Process the available input in micro-batches and return the output as a table.

    Output and checkpoint are in the shared folder; each micro-batch replaces its own part, so a
    repeated batch after a failure does no harm. With the ``folder`` of an earlier run the stream goes
    on where that one ended; a new folder starts from the source's default position.
    """
    result, _ = _run(stream, name, mode, transform, folder)
    return result


def run_counted(stream: DataFrame, name: str, folder: str) -> tuple[DataFrame, int]:
    """The output table so far and the number of rows that this run took in."""
    out, query = _run(stream, name, "append", None, folder)
    return out, sum(p["numInputRows"] for p in query.recentProgress)


def _run(stream: DataFrame, name: str, mode: str, transform, folder: str | None):
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)
    out = f"{folder}/out"
    started = (
        stream.writeStream.foreachBatch(each_batch(out, transform))
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    return written(out, empty if transform is None else transform(empty)), started


def hand_over(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process the available input, and return the output as a live stream for a next step.

    Between the steps is a folder of Spark's file sink, whose log shows a micro-batch's files all at once: the next step takes
    what one micro-batch gave, watermark and rows, in one micro-batch too.
    """
    folder = folder or shared_folder(stream.sparkSession, name)
    place = f"{folder}/out"
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", place)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.readStream.schema(stream.schema).parquet(place)


def written(path: str, empty: DataFrame) -> DataFrame:
    """What micro-batches wrote; ``empty`` if there was no input yet."""
    spark = empty.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path).drop("batch") if files.exists(place) else empty


Step = Callable[[DataFrame, DataFrame, int, int], tuple[DataFrame, DataFrame]]


def run_with_state(
    stream: DataFrame, name: str, step: Step, state_schema: str, clock: str, delay_ms: int, folder: str | None = None
) -> DataFrame:
    """Process the available input with a table as state, and return the output as a table.

    For each micro-batch ``step(rows, state, before, after)`` gives its output and the next state, both as
    ordinary (batch) DataFrames: a hot key is split as in any batch job. ``before`` and ``after`` are the
    watermark (highest ``clock`` in epoch ms so far, less ``delay_ms``) without and with this batch.

    State and watermark are in the shared folder. Batch b reads what b - 1 wrote and replaces what
    b - 2 wrote, so a batch that is repeated after a failure starts from the same state.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)
    _process_all(stream, step, state_schema, clock, delay_ms, folder)
    nothing = spark.createDataFrame([], stream.schema), spark.createDataFrame([], state_schema)
    return written(f"{folder}/out", step(*nothing, 0, 0)[0])


def _process_all(stream: DataFrame, step: Step, state_schema: str, clock: str, delay_ms: int, folder: str) -> int:
    """The number of the last micro-batch there was."""
    done = -1

    def process(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        old, new = (f"{folder}/state-{i % 2}" for i in (batch_id - 1, batch_id))
        if batch_id:
            state = session.read.schema(state_schema).parquet(f"{old}/rows")
            highest = session.read.parquet(f"{old}/clock").first()[0]
        else:
            state, highest = session.createDataFrame([], state_schema), None
        rows.persist()
        try:
            top = rows.agg(F.max(clock)).first()[0]
            after = max((v for v in (highest, top) if v is not None), default=0)
            output, following = step(rows, state, (highest or 0) - delay_ms, after - delay_ms)
            output.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
            following.write.mode("overwrite").parquet(f"{new}/rows")
            session.range(1).select(F.lit(after).cast("bigint")).write.mode("overwrite").parquet(f"{new}/clock")
        finally:
            rows.unpersist()
        nonlocal done
        done = batch_id

    (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return done
