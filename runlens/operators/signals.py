"""Per-instance rollups of K runs and the signal they carry.

Runs are long rows: instance_id, repo, run_id, resolved, steps, total_tokens,
wall_clock_seconds, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.schemas import RUN


def instance_rollup(runs: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """One row per instance; with `instances`, those without runs appear with 0.0.

    The repo belongs to the instance: it is a grouping key or comes from
    `instances`, which keeps text out of the aggregation buffers.
    """
    keys = ["instance_id"] if instances is not None else ["instance_id", "repo"]
    rolled = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if("resolved").alias("n_resolved"),
        F.sum(F.col("steps").cast("bigint")).alias("sum_steps"),
        F.sum("total_tokens").alias("sum_tokens"),
    )
    if instances is not None:
        named = instances.select("instance_id", "repo")
        rolled = named.join(rolled, "instance_id", "left").select(
            "instance_id",
            "repo",
            *[
                F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
                for name in ("n_runs", "n_resolved", "sum_steps", "sum_tokens")
            ],
        )

    def per_run(total: str) -> Column:
        return F.coalesce(F.try_divide(F.col(total), F.col("n_runs")), F.lit(0.0))

    return rolled.select(
        "instance_id",
        F.coalesce("repo", F.lit("unknown")).alias("repo"),
        "n_runs",
        "n_resolved",
        per_run("n_resolved").alias("resolve_rate"),
        per_run("sum_steps").alias("avg_steps"),
        per_run("sum_tokens").alias("avg_tokens"),
    )


def nest_runs(runs: DataFrame, per_record: int) -> DataFrame:
    """Result records with their runs nested in order of `run_idx` (dense from 0).

    Long runs are the contract of all reports; this form is for callers that
    want lists. A record is (instance_id, part, repo, runs) whatever the number
    of runs: part p holds the runs from p * `per_record` on. The caller names
    the size, so no list grows with the data unasked.
    """
    fields = ["run_idx", *[f.name for f in RUN.fields if f.name in runs.columns]]
    return (
        runs.withColumn("part", F.floor(F.col("run_idx") / per_record))
        .groupBy("instance_id", "part")
        .agg(
            F.min("repo").alias("repo"),
            F.sort_array(F.collect_list(F.struct(*fields))).alias("runs"),
        )
    )


def explode_runs(results: DataFrame) -> DataFrame:
    """Long runs of nested result records."""
    return results.select(
        "instance_id",
        F.coalesce("repo", F.lit("unknown")).alias("repo"),
        F.explode("runs").alias("run"),
    ).select("instance_id", "repo", "run.*")


def signal_class(n_resolved: Column, n_runs: Column) -> Column:
    """always_fail (also without runs), always_pass or mixed."""
    return (
        F.when(n_resolved == 0, F.lit("always_fail"))
        .when(n_resolved == n_runs, F.lit("always_pass"))
        .otherwise(F.lit("mixed"))
    )


def group_signal(rollup: DataFrame, by: str | None = None) -> DataFrame:
    """Counts and shares of the three signal classes, overall or per `by`.

    `applicable` is false when no instance has more than one run.
    """
    classed = rollup.withColumn("signal", signal_class(F.col("n_resolved"), F.col("n_runs")))
    grouped = classed.groupBy(*([by] if by else []))
    counts = grouped.agg(
        F.max("n_runs").alias("k"),
        F.count(F.lit(1)).alias("instances"),
        *[
            F.count_if(F.col("signal") == name).alias(name)
            for name in ("always_fail", "always_pass", "mixed")
        ],
    )
    return counts.select(
        "*",
        (F.coalesce("k", F.lit(0)) > 1).alias("applicable"),
        *[
            F.try_divide(F.col(name), F.col("instances")).alias(f"{name}_share")
            for name in ("always_fail", "always_pass", "mixed")
        ],
    )


def mixed_histogram(rollup: DataFrame) -> DataFrame:
    """Instances per n/K among the mixed ones, in numeric order of n."""
    return (
        rollup.where((F.col("n_resolved") > 0) & (F.col("n_resolved") < F.col("n_runs")))
        .groupBy("n_resolved", "n_runs")
        .agg(F.count(F.lit(1)).alias("instances"))
        .select(
            F.concat_ws("/", F.col("n_resolved"), F.col("n_runs")).alias("outcome"),
            "n_resolved",
            "n_runs",
            "instances",
        )
        .orderBy("n_resolved", "n_runs")
    )


def eval_summary(rollup: DataFrame) -> DataFrame:
    """One row: macro averages (per instance) beside the micro rate (per run)."""
    return rollup.agg(
        F.count(F.lit(1)).alias("instances"),
        F.count_if(F.col("resolve_rate") > 0).alias("resolved_any"),
        F.avg("resolve_rate").alias("avg_resolve_rate"),
        F.avg("avg_steps").alias("avg_steps"),
        F.avg("avg_tokens").alias("avg_tokens"),
        F.coalesce(F.sum("n_runs"), F.lit(0)).alias("total_runs"),
        F.coalesce(F.sum("n_resolved"), F.lit(0)).alias("resolved_runs"),
    ).select(
        "*",
        F.try_divide("resolved_any", "instances").alias("resolved_any_rate"),
        F.try_divide("resolved_runs", "total_runs").alias("run_resolve_rate"),
    )
