"""Distributions over growing tables from stored, mergeable quantile sketches.

Each day (or whatever period `day` is cut to) and group keeps one sketch beside its exact count, sum, minimum and maximum. A question
over any days merges sketches and reads no row again; a new or repeated day writes
its own partition only. A merged sketch of size k answers with a rank error of
RANK_ERROR(k) (of all rows, 99 of 100 times); the exact figures are those of `quantiles.py`.

Null values and NaN are left out; a group without values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 1024
DAY = "day"


def rank_error(size: int = SIZE) -> float:
    """The published bound of these sketches for single ranks."""
    return 2.446 / size**0.9433


def daily_sketches(rows: DataFrame, day: Column, groups: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """day, groups, n, total, low, high, sketch."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return (
        rows.withColumn("_v", v)
        .where(F.col("_v").isNotNull())
        .groupBy(day.cast("date").alias(DAY), *groups)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_v").alias("total"),
            F.min("_v").alias("low"),
            F.max("_v").alias("high"),
            F.kll_sketch_agg_double("_v", size).alias("sketch"),
        )
    )


def store_days(sketches: DataFrame, path: str) -> None:
    """Write the days of `sketches`, in place of the same days if they are there; one file per day."""
    sketches.repartition(DAY).write.partitionBy(DAY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_distribution(
    stored: DataFrame, groups: Sequence[str], percents: Sequence[int] = (10, 25, 50, 75, 90), size: int = SIZE
) -> DataFrame:
    """groups, n, mean, min, max (exact) and p10, p25, ... (within the rank error) over the days of `stored`."""
    merged = stored.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.kll_merge_agg_double("sketch", size).alias("_sketch"),
    )
    marks = [
        F.kll_sketch_get_quantile_double("_sketch", F.lit(p / 100)).alias(f"p{p}") for p in percents
    ]
    return merged.select(*groups, "n", "mean", "min", "max", *marks)


def rank_gaps(values: DataFrame, found: DataFrame, groups: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """groups, percent, gap: how far the exact ranks of each found mark are from the one asked for (0 if between them)."""
    wanted = [F.struct(F.lit(p).alias("percent"), F.col(f"p{p}").alias("mark")) for p in percents]
    marks = found.select(*groups, F.array(*wanted).alias("_marks"))
    v = F.col(value).cast("double")
    # As many marks per group as percents; groups are those of the merged table.
    counted = (
        values.where(v.isNotNull() & ~F.isnan(v))
        .join(marks, list(groups))
        .select(*groups, v.alias("_v"), F.explode("_marks").alias("m"))
        .groupBy(*groups, "m.percent", "m.mark")
        .agg(F.avg((F.col("_v") < F.col("m.mark")).cast("double")).alias("_below"), F.avg((F.col("_v") <= F.col("m.mark")).cast("double")).alias("_upto"))
    )
    share = F.col("percent") / 100
    gap = F.greatest(F.col("_below") - share, share - F.col("_upto"), F.lit(0.0))
    return counted.select(*groups, "percent", gap.alias("gap"))
