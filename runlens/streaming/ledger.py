"""Resumable ledger of finished results and its running progress.

The ledger is a table of unique ids (`streaming/store.py`). A long-running query remembers
ids only as long as repeats are likely (a watermark); later ones are found in the ledger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runlens.session import work_path
from runlens.streaming import store

STREAM, BATCH = store.STREAM, store.BATCH


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Ledger rows with the stream and batch that wrote them; an absent ledger is empty."""
    return store.read(spark, path, schema)


def first_per_id(results: DataFrame, key: str) -> DataFrame:
    """One row per id, the smallest one, so that a repeated batch writes the same."""
    fields = [c for c in results.columns if c != key]
    return (
        results.groupBy(key)
        .agg(F.min(F.struct(*fields)).alias("_row"))
        .select(key, "_row.*")
        .select(*results.columns)
    )


def write_batch(
    results: DataFrame,
    stream: str,
    batch_id: int,
    path: str,
    schema: T.StructType,
    key: str,
    sums: Mapping[str, Column] | None = None,
) -> None:
    """Add the batch's new ids to the ledger.

    foreachBatch may run a batch again: the ledger knows the last batch of each
    stream and leaves it as it is. The batch is stored first, since it is looked at several times.
    """
    spark = results.sparkSession
    folder = store.Folder(spark, work_path(spark, "ledger-batch"))
    first_per_id(results.where(F.col(key).isNotNull()), key).write.parquet(folder.root)
    try:
        rows = spark.read.schema(results.schema).parquet(folder.root)
        store.add(rows, path, schema, key, stream, batch_id, sums)
    finally:
        folder.remove("")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the running query, kept in its checkpoint.

    Batch numbers start again at 0 under a new checkpoint, so the batch alone
    does not name a partition of the ledger.
    """
    running = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    return running or hashlib.md5(checkpoint.encode()).hexdigest()


def stream_results(
    spark: SparkSession, source: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Result lines of a growing folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(source)


def run_ledger(
    results: DataFrame,
    path: str,
    checkpoint: str,
    schema: T.StructType,
    key: str = "instance_id",
    once: bool = True,
    keep_ids: bool | None = None,
    late: str = "1 day",
    seen: Column | None = None,
    sums: Mapping[str, Column] | None = None,
) -> StreamingQuery:
    """Start the ledger query; `once` stops it when the present input is read.

    Every batch is checked against the ledger. A query that goes on also remembers its
    ids in the state store (`keep_ids`), so that the repeats that come soon never get
    as far; an id leaves the state when `late` has passed, by `seen` (a time column; the time of
    the batch by default), so the state stops growing.
    """
    keep_ids = not once if keep_ids is None else keep_ids
    if keep_ids:
        marked = results.where(F.col(key).isNotNull()).withColumn(
            "_seen", F.current_timestamp() if seen is None else seen
        )
        results = marked.withWatermark("_seen", late).dropDuplicatesWithinWatermark([key]).drop("_seen")

    def sink(batch: DataFrame, batch_id: int) -> None:
        stream = _stream_id(batch.sparkSession, checkpoint)
        write_batch(batch, stream, batch_id, path, schema, key, sums)

    writer = results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def progress_sums() -> dict[str, Column]:
    """The running sums behind `ledger_progress`."""
    rate = F.col("resolve_rate")
    return {
        "resolved_any": F.when(rate > 0, 1).otherwise(0),
        "rated": F.when(rate.isNotNull(), 1).otherwise(0),
        "rates": F.coalesce(rate, F.lit(0.0)),
    }


def ledger_progress(spark: SparkSession, path: str, total: int) -> DataFrame:
    """done / total and mean resolve rate of a ledger that keeps `progress_sums`.

    The sums stand in the ledger's marker, so no row is read and no state is kept.
    """
    found = store.snapshot(spark, path).totals
    rated = found.get("rated", 0)
    mean = found["rates"] / rated if rated else None
    return spark.createDataFrame(
        [(int(found.get("rows", 0)), total, int(found.get("resolved_any", 0)), mean)],
        "done long, total long, resolved_any long, avg_resolve_rate double",
    )


def progress(results: DataFrame, total: int, key: str = "instance_id") -> DataFrame:
    """Running done / total and mean resolve rate, each id once.

    A streaming source keeps all ids in its state store, besides one row of sums: for input that
    ends. A stream without an end takes `ledger_progress`.
    """
    return results.where(F.col(key).isNotNull()).dropDuplicates([key]).agg(
        F.count(F.lit(1)).alias("done"),
        F.count_if(F.col("resolve_rate") > 0).alias("resolved_any"),
        F.avg("resolve_rate").alias("avg_resolve_rate"),
    ).select(
        "done",
        F.lit(total).cast("bigint").alias("total"),
        "resolved_any",
        "avg_resolve_rate",
    )


def run_progress(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Store the row of `progress` after each batch, in a folder per batch (see `read_progress`).

    The folders of all batches but this and the last one are then removed.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        folder = store.Folder(batch.sparkSession, path)
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        for name in folder.names(""):
            if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) < batch_id - 1:
                folder.remove(name)

    writer = (
        rows.writeStream.outputMode("complete")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The latest row: a batch that is being written never takes the place of an earlier one."""
    rows = spark.read.parquet(path)
    return rows.orderBy(F.desc(BATCH)).limit(1)
