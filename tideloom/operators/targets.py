"""A keyed table that is written: batches of versioned requests against what earlier batches have stored.

The table is a folder of accepted requests, one part per batch, so a batch adds only what it changes
and rewrites nothing. What is stored for an id is its request with the highest version.

A batch sees the parts before its own number and replaces its own: running it again, after a lost
driver or as a repeated micro-batch, gives the same outcomes and the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.operators.ordered import Running, Slicing, plan_slices, running
from tideloom.operators.tables import latest


def stored(spark, path: str, ident: str, version: str, before: int | None = None) -> DataFrame | None:
    """The newest version of each id, of the batches below ``before``; None if there is no such batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    parts = spark.read.parquet(path)
    if before is not None:
        parts = parts.filter(F.col("batch") < before)
    return latest(parts, [ident], [version, "batch"])


def upsert_batch(
    requests: DataFrame,
    path: str,
    batch: int,
    *,
    ident: str,
    version: str,
    order: Sequence[str],
    slicing: Slicing | None = None,
) -> DataFrame:
    """Write one batch of requests and return them with their ``outcome``, read back from the folder ``path + ".outcomes"``.

    insert = the id is neither stored nor requested earlier in the batch, update = a version above the stored one and all
    earlier ones of the batch, conflict = any other: it is counted and writes nothing, so a conflict is no error. A
    request without id or version is ``failed`` and writes nothing. ``order[0]`` is numeric and ``order`` total.

    The versions there join the requests on the id; the order inside the batch is a running maximum in slices, so that an
    id with any number of requests is spread over tasks.
    """
    spark = requests.sparkSession
    if slicing is None:
        slicing = plan_slices(requests, order[0])
    there = stored(spark, path, ident, version, batch)
    if there is None:
        known = requests.withColumn("_there", F.lit(None).cast(requests.schema[version].dataType))
    else:
        held = there.select(F.col(ident).alias("_ident"), F.col(version).alias("_there"))
        known = requests.join(held, F.col(ident) == F.col("_ident"), "left").drop("_ident")
    seen = running(known, [ident], order, {"_best": Running("max", version, before=True)}, slicing)
    newest = F.greatest("_best", "_there")
    outcome = (
        F.when(F.col(ident).isNull() | F.col(version).isNull(), "failed")
        .when(newest.isNull(), "insert")
        .when(F.col(version) > newest, "update")
        .otherwise("conflict")
    )
    outcomes = f"{path}.outcomes"
    seen.withColumn("outcome", outcome).drop("_best", "_there").write.mode("overwrite").parquet(f"{outcomes}/batch={batch}")
    judged = spark.read.parquet(f"{outcomes}/batch={batch}")
    accepted = judged.filter(F.col("outcome").isin("insert", "update")).drop("outcome")
    latest(accepted, [ident], [version]).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return judged


def upsert_writer(path: str, *, ident: str, version: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``upsert_batch`` as a ``foreachBatch`` function."""

    def write(rows: DataFrame, batch: int) -> None:
        upsert_batch(rows, path, batch, ident=ident, version=version, order=order)

    return write
