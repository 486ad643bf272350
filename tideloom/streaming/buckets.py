"""State tables in hash buckets: a micro-batch reads and replaces only the buckets that its keys fall into."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.session import shared_folder

BUCKETS = 32
LONG_AGO = -(1 << 62)


class BucketTable:
    """Rows by bucket of their keys, in versions: batch b writes version b of the buckets it touched.

    ``versions-<b % 2>`` says which version of each bucket holds after batch b, so a batch that is repeated after a
    failure starts from the same rows and replaces its own.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, list(keys), buckets

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys in ``rows``: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def versions(self, batch: int) -> dict[int, int]:
        if batch < 0:
            return {}
        return {r[0]: r[1] for r in self.spark.read.parquet(f"{self.folder}/versions-{batch % 2}").collect()}

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self, batch: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows after ``batch``, of some buckets or of all."""
        held = self.versions(batch)
        wanted = [f"{self.folder}/rows/v={v}/bucket={k}" for k, v in held.items() if v >= 0 and (buckets is None or k in buckets)]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self._empty()

    def write(self, batch: int, rows: DataFrame, buckets: Sequence[int]) -> None:
        """``rows`` become the content of ``buckets``; the others stay as they were after the batch before."""
        before = self.versions(batch - 1)
        after = dict(before)
        if buckets:
            path = f"{self.folder}/rows/v={batch}"
            rows.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(path)
            filled = self._buckets_in(path)
            after |= {k: batch if k in filled else -1 for k in buckets}
        pairs = list(after.items()) or [(0, -1)]
        self.spark.createDataFrame(pairs, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/versions-{batch % 2}"
        )
        self._drop(set(range(batch)) - set(before.values()) - set(after.values()))

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _buckets_in(self, path: str) -> set[int]:
        files, make = self._files()
        names = [s.getPath().getName() for s in files.listStatus(make(path))]
        return {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}

    def _drop(self, versions: set[int]) -> None:
        """Versions that no batch needs any more."""
        files, make = self._files()
        for v in versions:
            place = make(f"{self.folder}/rows/v={v}")
            if files.exists(place):
                files.delete(place, True)


Step = Callable[[DataFrame, DataFrame, int, int], tuple[DataFrame, DataFrame]]


def run_in_order(
    stream: DataFrame, name: str, step: Step, keys: Sequence[str], table_schema: str, clock: str | None, delay_ms: int = 0,
    folder: str | None = None, flush: bool = True, all_buckets: bool = False,
) -> tuple[DataFrame, BucketTable, int]:
    """Process the available input in the order of ``clock``, against a table in buckets.

    Rows newer than the watermark (highest clock so far, less ``delay_ms``) wait: an older one may still come. Those it
    has passed, and rows that come too late, go with the touched part of the table into ``step(rows, table, before,
    after)``, which gives their output and the new content of that part; the watermark moves from ``before`` to ``after``.
    So files that arrive out of order within the delay give the results of files in order. With ``flush`` waiting rows at
    the end of the input are given with what is known by then, and wait on if the run goes on in the same ``folder``.
    ``all_buckets`` is for steps in which the watermark alone changes the table. Without a clock no row waits.

    Returns the output, the table and the number of the last micro-batch.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)
    table = BucketTable(spark, f"{folder}/table", table_schema, keys)
    schema = stream.schema
    last = _last_batch(spark, folder)

    def waiting(batch: int) -> tuple[DataFrame, int | None]:
        if batch < 0 or clock is None:
            return spark.createDataFrame([], schema), None
        mark = spark.read.parquet(f"{folder}/waiting-{batch % 2}/clock").first()[0]
        return spark.read.schema(schema).parquet(f"{folder}/waiting-{batch % 2}/rows"), mark

    def process(rows: DataFrame, batch: int) -> None:
        nonlocal last
        held, highest = waiting(batch - 1)
        rows = rows.persist()
        try:
            ready, before, after = rows, 0, 0
            if clock is not None:
                top = rows.agg(F.max(clock)).first()[0]
                newest = max((v for v in (highest, top) if v is not None), default=0)
                before, after = (LONG_AGO if highest is None else highest - delay_ms), newest - delay_ms
                both = rows.unionByName(held)
                ready, later = both.filter(F.col(clock) <= after), both.filter(F.col(clock) > after)
                later.write.mode("overwrite").parquet(f"{folder}/waiting-{batch % 2}/rows")
                spark.range(1).select(F.lit(newest).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/waiting-{batch % 2}/clock")
            touched = list(range(table.buckets)) if all_buckets else table.touched(ready)
            output, following = step(ready, table.read(batch - 1, touched), before, after)
            output.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
            table.write(batch, following, touched)
        finally:
            rows.unpersist()
        last = batch

    (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    held, highest = waiting(last)
    if not flush:
        held = held.limit(0)
    known = table.read(last, table.touched(held)) if clock is not None and flush else table.read(-1)
    output, _ = step(held, known, highest or 0, highest or 0)
    if last >= 0:
        output = spark.read.schema(output.schema).parquet(*[f"{folder}/out/batch={b}" for b in range(last + 1)]).unionByName(output)
    return output, table, last


def _last_batch(spark: SparkSession, folder: str) -> int:
    """Number of the last micro-batch of an earlier run in this folder, -1 if there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return -1
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=-1)
