"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.session import shared_folder

# ASCII white space, what separates words in most operators.
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

# Text that one step of a vectorised task takes at a time.
STEP_BYTES = 1 << 20


def key_columns(*columns: Column) -> list[Column]:
    """``ka``, ``kb``: 128 bits that stand for a row's id and text. Never null; equal rows have equal keys."""
    return [
        F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("ka"),
        F.xxhash64(F.lit("second"), *reversed(columns), *[c.isNull() for c in columns]).alias("kb"),
    ]


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the cluster's shared folder and read back.

    The result survives lost executors and is not computed twice. The folder is deleted when the session ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def arrow_function(kind: str):
    """Decorator: an Arrow function as a column function. The UDF is made at the call, as parsing ``kind`` needs a session."""

    def wrap(fn):
        @functools.wraps(fn)
        def call(*columns) -> Column:
            return F.arrow_udf(fn, kind)(*columns)

        return call

    return wrap


def returning_memory(fn):
    """Decorator of a function of batches: at its end the task's Python worker, which waits for another task and beside which
    the JVM works on, gives what its allocators hold back to the machine."""

    @functools.wraps(fn)
    def run(batches, *args):
        try:
            yield from fn(batches, *args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def steps(sizes, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``limit``; a larger row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
