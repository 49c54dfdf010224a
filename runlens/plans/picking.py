"""Sampling, limit, ordering and sharding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.operators import sampling
from runlens.plans.registry import query
from runlens.sources import fixtures as fx


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    return fx.instances(spark, sf).select("instance_id", "repo", "seq")


@query(
    "seeded_sample",
    "select instance_id, repo, seq from instances order by md5(concat('42-', instance_id)), instance_id limit 250",
)
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.seeded_sample(_instances(spark, sf), 250, seed=42)


@query("instance_limit", "select instance_id, repo, seq from instances order by seq limit 50")
def instance_limit(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.instance_limit(_instances(spark, sf), 50)


@query("repo_locality_sort", "select instance_id, repo, seq from instances order by repo, instance_id")
def repo_locality_sort(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.repo_locality_sort(_instances(spark, sf))


@query(
    "round_robin_shards",
    """
select instance_id, repo, seq, (row_number() over (order by seq) - 1) % least(7, (select count(*) from instances)) as shard
from instances
""",
)
def round_robin_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.round_robin_shards(_instances(spark, sf), 7)
