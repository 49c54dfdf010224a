"""Readers for the stored entities; every schema is given, none is inferred."""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.text import py_strip
from runlens.schemas import PREDICTION

CORRUPT = "_corrupt_record"


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(
    spark: SparkSession, path: str, schema: T.StructType, required: str = "instance_id"
) -> DataFrame:
    """Lines that parse and carry `required`; others are left out."""
    return _permissive(spark, path, schema).where(_usable(required)).drop(CORRUPT)


def count_rejects(
    spark: SparkSession, path: str, schema: T.StructType, required: str = "instance_id"
) -> DataFrame:
    """One row: lines read, and those the tolerant reader leaves out."""
    return _permissive(spark, path, schema).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~_usable(required)).alias("rejected"),
    )


def _usable(required: str) -> Column:
    return F.col(CORRUPT).isNull() & F.col(required).isNotNull()


def _permissive(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parsed lines with the raw text of bad ones.

    The text is parsed by `from_json` rather than by the JSON reader, which
    may prune the parse away when only the corrupt column is asked for.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.length(py_strip(F.col("value"))) > 0)
    return lines.select(F.from_json("value", full, options).alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array each.

    Such a file cannot be split; store large sets as Parquet once.
    """
    return (
        spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    )


def read_prediction_tree(
    spark: SparkSession, root: str, file_name: str = "prediction.json"
) -> DataFrame:
    """Every readable prediction file below `root` that names its instance.

    A tree on a mounted disk is listed and read by tasks, since Spark's file reader keeps a
    list of all files in the driver and makes a task of every few; other stores are left to it.
    """
    full = T.StructType([*PREDICTION.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(full)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    mounted = _mounted(spark, root)
    files = reader.json(root if mounted is None else _tree_texts(spark, mounted, file_name))
    return files.where(_usable("instance_id")).select(*PREDICTION.fieldNames())


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of an existing folder on a mounted disk, null for other stores and for patterns."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(conf)
    if system.getUri().getScheme() != "file" or not system.exists(folder):
        return None
    return system.makeQualified(folder).toUri().getPath()


def _tree_texts(spark: SparkSession, root: str, file_name: str) -> RDD[str]:
    """Texts of the files below `root` with this name: one task names the folders, all tasks read them."""

    def entries(roots: Iterable[str]) -> Iterator[str]:
        for top in roots:
            with os.scandir(top) as found:
                yield from (entry.path for entry in found)

    def failed(error: OSError) -> None:
        raise error

    def paths(top: str) -> Iterator[str]:
        if not os.path.isdir(top):
            walked = [(os.path.dirname(top), [], [os.path.basename(top)])]
        else:
            walked = os.walk(top, onerror=failed, followlinks=True)
        for folder, _, names in walked:
            yield from (os.path.join(folder, name) for name in fnmatch.filter(names, file_name))

    def texts(tops: Iterable[str]) -> Iterator[str]:
        for top in tops:
            for path in paths(top):
                with open(path, "rb") as file:
                    raw = file.read()
                try:
                    yield raw.decode(json.detect_encoding(raw))
                except UnicodeDecodeError:  # not readable
                    continue

    context = spark.sparkContext
    tops = context.parallelize([root], 1).mapPartitions(entries)
    return tops.repartition(4 * context.defaultParallelism).mapPartitions(texts)


def with_line_order(lines: DataFrame) -> DataFrame:
    """Adds `seq`, the place of a row in its input files, for rows read from files."""
    return lines.withColumn(
        "seq",
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def load_prompt_map(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """id -> prompt text; empty ids or texts dropped, the last line of an id wins."""
    given = (F.length("instance_id") > 0) & (F.length("text_inputs") > 0)
    return (
        lines.where(given)
        .groupBy("instance_id")
        .agg(F.max_by("text_inputs", seq).alias("text_inputs"))
    )


def read_split(
    spark: SparkSession, root: str, dataset: str, split: str | None = None
) -> DataFrame:
    """A split of a stored dataset; the default split depends on the dataset."""
    from runlens.functions.prompts import TEST_SPLIT_DATASET

    chosen = split or ("test" if dataset == TEST_SPLIT_DATASET else "train")
    return spark.read.parquet(f"{root}/{dataset}/{chosen}")


def object_path(uri: str) -> str:
    """Path of an s3 URI for Spark's readers and writers; other schemes are refused."""
    scheme, _, rest = uri.partition("://")
    if scheme.lower() != "s3":
        raise ValueError(f"only s3 paths can be read here, this is: {uri}")
    return f"s3a://{rest}"


def read_id_list(spark: SparkSession, path: str, column: str = "instance_id") -> DataFrame:
    """One id per line, trimmed, blank lines skipped."""
    ids = spark.read.text(path).select(py_strip(F.col("value")).alias(column))
    return ids.where(F.length(column) > 0)


def parse_label(label: Column, schema: T.DataType | str, strict: bool = True) -> Column:
    """Typed struct of a JSON column; strict fails on bad text, else null fields."""
    if strict:
        return F.from_json(label, schema, {"mode": "FAILFAST"})
    return F.from_json(F.coalesce(label, F.lit("{}")), schema)
