"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}
_STORED: list[str] = []

# AQE sizes the shuffles at run time, splits skewed join partitions and turns
# a shuffled join into a broadcast one only after the small side was measured.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    # Ids remembered by a long stream stay on disk instead of the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


MIB = 1 << 20


def sized_for(input_bytes: int) -> dict[str, str]:
    """Settings for a job that shuffles about `input_bytes`.

    AQE merges shuffle partitions but never adds any, so a large job has to
    start with enough of them: 128 MiB each, which a task sorts in memory.
    """
    partitions = max(-(-input_bytes // (128 * MIB)), 200)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * MIB),
        "spark.sql.files.maxPartitionBytes": str(256 * MIB),
    }


def build_session(
    app_name: str = "runlens",
    master: str | None = None,
    extra: dict[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """Start (or reuse) a session; `master` stays with spark-submit when None."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    sizes = {} if input_bytes is None else sized_for(input_bytes)
    for key, value in {**DEFAULTS, **sizes, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A local master has one machine only, so there a temporary folder is made
    once per application. On a cluster a missing setting is an
    error: a machine-local folder would not be visible to the executors.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="runlens-")
    return _LOCAL_ROOTS[application]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root; never reused between calls."""
    return f"{shared_root(spark)}/runlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from there.

    For intermediate results that several branches of a plan need: the lineage
    is cut, and a lost executor costs a read instead of the work before it.
    """
    path = work_path(df.sparkSession, name)
    _STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that `materialize` stored inside, once the job has written its results."""
    start = len(_STORED)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _STORED[start:]:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        del _STORED[start:]
