"""Reproducible selection, ordering and sharding of instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.verdicts import failing_block
from runlens.session import materialize


def seeded_sample(instances: DataFrame, count: int, seed: int = 42, key: str = "instance_id") -> DataFrame:
    """The first `count` rows in the order of a seeded hash of the id.

    The order depends on seed and id only, not on partitions; it is a
    permutation of its own, not that of another library's shuffle. Ids are
    unique. The cut is found on hashes and ids alone; rows are then filtered by
    it where they are, and only the chosen ones are sorted.
    """
    place = F.concat(shuffle_key(seed, key), F.lit("-"), F.col(key).cast("string"))
    return _up_to(instances, place, count)


def _up_to(rows: DataFrame, place: Column, count: int) -> DataFrame:
    """The `count` rows with the smallest unique `place`, in its order."""
    places = rows.select(place.alias("_place"))
    cut = places.orderBy("_place").limit(count).agg(F.max("_place")).scalar()
    return rows.where(place <= cut).orderBy(place)


def shuffle_key(seed: int, key: str):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def instance_limit(instances: DataFrame, count: int, order: str = "seq") -> DataFrame:
    """The first `count` rows by the unique `order`; 0 keeps all."""
    return _up_to(instances, F.col(order), count) if count > 0 else instances


def repo_locality_sort(instances: DataFrame) -> DataFrame:
    """Rows sorted by repo and id so that work on one repo stays together."""
    return instances.orderBy(
        F.coalesce("repo", F.lit("")), F.coalesce("instance_id", F.lit(""))
    )


def top_failures(tests: DataFrame, limit: int = 20) -> DataFrame:
    """Failing-test text per instance from (instance_id, test, status, seq) rows.

    The rank filter is applied before the shuffle as well (window group
    limit), so an instance with very many tests ships `limit` rows per task;
    the total comes from a partial count.
    """
    failing = tests.where(F.col("status").isin("FAILED", "ERROR"))
    rank = F.row_number().over(Window.partitionBy("instance_id").orderBy("seq"))
    first = (
        failing.withColumn("_rank", rank)
        .where(F.col("_rank") <= limit)
        .groupBy("instance_id")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "test"))).alias("_first"))
    )
    totals = failing.groupBy("instance_id").agg(F.count(F.lit(1)).alias("failing"))
    names = F.transform("_first", lambda item: item["test"])
    return first.join(totals, "instance_id").select(
        "instance_id",
        "failing",
        failing_block(names, F.col("failing"), limit).alias("feedback"),
    )


def round_robin_shards(rows: DataFrame, workers: int, order: str = "seq") -> DataFrame:
    """`shard` = place in `order` modulo min(workers, rows).

    `order` is unique, but may have gaps of any size: its values are dealt by range
    into parts of about the same size and numbered inside them, and only the
    parts' counts are summed up in one task. No other column takes part in it.
    """
    dealt = rows.select(F.col(order).alias("_order")).repartitionByRange("_order")
    parts = materialize(dealt.withColumn("_part", F.spark_partition_id()), "order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_order")) - 1
    places = parts.withColumn("_inside", inside).join(starts, "_part").select(
        "_order", (F.col("_start") + F.col("_inside")).alias("_place")
    )
    used = rows.agg(F.greatest(F.least(F.count(F.lit(1)), F.lit(workers)), F.lit(1))).scalar()
    placed = rows.join(places, F.col(order) == F.col("_order"))
    return placed.select(*rows.columns, F.pmod("_place", used).alias("shard"))
