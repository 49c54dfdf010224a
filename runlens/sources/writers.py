"""Writers for prompts, results, ledgers, reports and id lists."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def training_lines(instances: DataFrame, prompt, columns: list[str] | None = None) -> DataFrame:
    """(input, label): the prompt and the whole row as JSON, null fields kept."""
    label = F.to_json(F.struct(*(columns or instances.columns)), KEEP_NULLS)
    return instances.select(prompt.alias("input"), label.alias("label"))


def write_training_jsonl(lines: DataFrame, path: str) -> None:
    lines.select("input", "label").write.options(**KEEP_NULLS).json(path)


def write_result_tables(results: DataFrame, root: str, parts: Mapping[str, list[str]]) -> None:
    """One Parquet table per kind of output, partitioned by run_id.

    `parts` maps a table name (predictions, reports, turns, logs, ...) to its
    columns. Rows in which all of a table's own columns are null are left out,
    as an absent output is. A directory per instance would mean millions of
    small files.
    """
    for name, columns in parts.items():
        own = F.coalesce(*[F.col(c).cast("string") for c in columns])
        (
            results.where(own.isNotNull())
            .select("run_id", "instance_id", *columns)
            .write.partitionBy("run_id")
            .mode("append")
            .parquet(f"{root}/{name}")
        )


def merge_predictions(dataset: DataFrame, predictions: DataFrame) -> DataFrame:
    """Three-field predictions of the dataset's ids, in dataset order (`seq`)."""
    kept = predictions.select("instance_id", "model_patch", "model_name_or_path")
    return (
        dataset.select("instance_id", "seq")
        .join(kept, "instance_id")
        .orderBy("seq")
        .select(
            "instance_id",
            F.coalesce("model_patch", F.lit("")).alias("model_patch"),
            F.coalesce("model_name_or_path", F.lit("unknown")).alias("model_name_or_path"),
        )
    )


def append_ledger(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON document."""
    report.coalesce(1).write.options(**KEEP_NULLS).json(path)


def write_id_list(ids: DataFrame, order: list, path: str, column: str = "instance_id") -> None:
    """One id per line in the given order; part files keep that order by name."""
    ids.orderBy(*order).select(F.col(column).cast("string")).write.text(path)


def write_prediction_tree(predictions: DataFrame, root: str, file_name: str = "prediction.json") -> None:
    """One <root>/<instance_id>/<file_name> per row of (instance_id, value).

    The layout that other tools expect, for exports: a file per row, written by
    the task that holds the row; ids are dealt out, since rows that take much longer to
    write than to read may come in very few partitions. A row that is written again replaces its file.
    """
    parts = 4 * predictions.sparkSession.sparkContext.defaultParallelism

    def write(rows: Iterator[Row]) -> None:
        system, top = fs.FileSystem.from_uri(root)
        for row in rows:
            folder = f"{top}/{row['instance_id']}"
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/{file_name}") as out:
                out.write(row["value"].encode())

    dealt = predictions.select("instance_id", "value").repartition(parts, "instance_id")
    dealt.foreachPartition(write)
