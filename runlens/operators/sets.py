"""Set operations over result batches and id sets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame


def union_batches(batches: Iterable[DataFrame | None]) -> DataFrame:
    """All results of the finished batches; a failed batch (None) is dropped."""
    done = [batch for batch in batches if batch is not None]
    if not done:
        raise ValueError("no batch finished")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)


def completed_diff(ids: DataFrame, completed: DataFrame, key: str = "instance_id") -> DataFrame:
    """Distinct ids not yet completed."""
    return ids.select(key).subtract(completed.select(key))
