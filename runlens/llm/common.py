"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def tagged(df: DataFrame, name: str) -> DataFrame:
    """`df` as a stored table with a unique `_row`; stored, so that the numbers stay as they are."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), name)


def first_id(id_column: str, row_column: str = "_row") -> Column:
    """Aggregate: struct(missing, id, row) of the smallest id; null ids come last, ties go to the first row."""
    fields = (F.col(id_column).isNull().alias("missing"), F.col(id_column).alias("id"), F.col(row_column).alias("row"))
    return F.min(F.struct(*fields))


def gapless(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2 ... per `keys`, by bucket and then by `order`.

    Only (keys, bucket) meet in a task; buckets follow each other by their
    counts, which is a table of one small row per bucket.
    """
    parts = [*keys, bucket]
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        *[F.col(k).alias(f"_start_{k}") for k in parts],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_start_{k}")) for k in parts]
    return ranked.join(starts, same, "left").select(
        *df.columns, (F.col("_start") + F.col("_rank") - 1).cast("long").alias(name)
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of an edge list (a, b); the component is its smallest node.

    Alternates the two star operations: every node hands its neighbours to its
    smallest one, first all larger neighbours, then all smaller ones. Stars
    are reached in about log(longest path) rounds and stay as they are. Only edges are moved, never
    a neighbour list, so a node may have any number of edges.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )

    def state() -> tuple:
        row = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = state()
    while seen[0]:
        both = current.union(current.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("_a"), F.least("a", "m").alias("m")
        )
        large = (
            both.where("b > a")
            .join(smallest, F.col("a") == F.col("_a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(smallest.select(F.col("_a"), "m"))
            .where("a <> b")
            .distinct()
        )
        large = materialize(large, name)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest.select(F.col("a").alias("_a"), "m"), F.col("a") == F.col("_a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .union(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        current = materialize(small, name)
        now = state()
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select("b", "b").distinct()
    )


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal keys, one table per key, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns))
        start = 0
        while start < len(marks):
            end = start + 1
            while end < len(marks) and marks[end] == marks[start]:
                end += 1
            if marks[start] != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = marks[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield current, pa.Table.from_batches(held)
