"""Session settings and the shared working folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import tideloom

# Settings the operators rely on. All of them are runtime SQL settings, so they apply to a session
# that someone else has already started.
RUNTIME_CONF = {
    # TIMESTAMP_NTZ clocks are read as UTC instants.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Session windows are merged inside each input partition before the shuffle, so a hot key
    # sends its sessions over the network and not its rows.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # Rows may hold whole documents: a Python worker should not get ten thousand of them at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

# Streaming state on the executors' disks and in the checkpoint, not in their memory. In a local session,
# where state is small, opening a database per partition costs more than it saves.
CLUSTER_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF`, on a cluster also :data:`CLUSTER_CONF`, to a running session and return it.

    Functions of this package that run inside tasks are pickled by value, so executors need no
    installed copy of it.
    """
    cloudpickle.register_pickle_by_value(tideloom)
    context = spark.sparkContext
    if context.master.startswith("local"):
        # Streaming state has a fixed number of partitions: no more of them than threads here.
        threads = context.defaultParallelism
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = RUNTIME_CONF | {"spark.sql.shuffle.partitions": str(min(partitions, threads))}
    else:
        wanted = RUNTIME_CONF | CLUSTER_CONF
    for name, value in wanted.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tideloom-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine: on a cluster every
    executor has to see the same path, also after another executor was lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/tideloom-{purpose}-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str):
    """One parquet table of a data folder as a bounded stream."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
