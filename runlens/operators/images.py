"""Container image lists: distinct references and the plan to mirror them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.prompts import image_repo_key, retag


def unique_images(instances: DataFrame) -> DataFrame:
    """Sorted distinct references of the instances that have one."""
    return instances.where(F.col("image").isNotNull()).select("image").distinct().orderBy("image")


def failed_images(instances: DataFrame) -> DataFrame:
    """Ids whose image could not be derived."""
    return instances.where(F.col("image").isNull()).select(
        F.coalesce("instance_id", F.lit("?")).alias("instance_id")
    )


def images_per_repo(images: DataFrame) -> DataFrame:
    return (
        images.select("image")
        .distinct()
        .groupBy(image_repo_key(F.col("image")).alias("repo_key"))
        .agg(F.count(F.lit(1)).alias("images"))
        .orderBy("repo_key")
    )


def mirror_plan(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Status of each wanted image: bad_tag, skipped (already there) or to_copy.

    A reference without `:latest` is bad; empty lines are ignored.
    """
    slash = F.position(F.lit("/"), F.col("image"))
    name = F.when(slash > 0, F.substr("image", slash + 1)).otherwise(F.col("image"))
    listed = wanted.where(F.length("image") > 0).select(
        "image", F.endswith(name, F.lit(":latest")).alias("_good"), retag(name).alias("target")
    )
    there = present.select(F.col("target")).distinct().withColumn("_there", F.lit(True))
    status = (
        F.when(~F.col("_good"), F.lit("bad_tag"))
        .when(F.col("_there"), F.lit("skipped"))
        .otherwise(F.lit("to_copy"))
    )
    return listed.join(there, "target", "left").select("image", "target", status.alias("status"))


def mirror_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("images"))
