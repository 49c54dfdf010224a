"""Grading and run reports: counts in one row, id lists as rows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.quantiles import histogram, stats_columns, weighted_stats
from runlens.operators.signals import signal_class
from runlens.operators.skew import join_summary


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def grade_class(resolved: Column, patch_exists: Column, error: Column) -> Column:
    """error, empty, passed or failed, tested in this order."""
    return (
        F.when(error.isNotNull(), F.lit("error"))
        .when(~F.coalesce(patch_exists, F.lit(False)), F.lit("empty"))
        .when(F.coalesce(resolved, F.lit(False)), F.lit("passed"))
        .otherwise(F.lit("failed"))
    )


def _graded(grades: DataFrame) -> DataFrame:
    kind = grade_class(F.col("resolved"), F.col("patch_exists"), F.col("error"))
    return grades.select("instance_id", kind.alias("grade"))


def grade_report(grades: DataFrame) -> DataFrame:
    """One row; errors and empty patches also count as failed, rate is over all."""
    kind = F.col("grade")
    return (
        _graded(grades)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(kind == "passed").alias("passed"),
            F.count_if(kind != "passed").alias("failed"),
            F.count_if(kind == "error").alias("errors"),
            F.count_if(kind == "empty").alias("empty"),
        )
        .withColumn("pass_rate", _rate(F.col("passed"), F.col("total")))
    )


def grade_id_lists(grades: DataFrame) -> DataFrame:
    """The report's id lists as (list, instance_id) rows."""
    lists = (
        F.when(F.col("grade") == "error", F.array(F.lit("error"), F.lit("failed")))
        .when(F.col("grade") == "passed", F.array(F.lit("passed")))
        .otherwise(F.array(F.lit("failed")))
    )
    return _graded(grades).select(F.explode(lists).alias("list"), "instance_id")


def _has_error(error: Column) -> Column:
    return F.coalesce(F.length(error), F.lit(0)) > 0


def run_report(results: DataFrame, total: int | None = None) -> DataFrame:
    """One row; rate is over the evaluated results, completion over `total`."""
    failed = _has_error(F.col("error"))
    evaluated = ~failed & F.col("resolved").isNotNull()
    counts = results.agg(
        F.count(F.lit(1)).alias("total_instances"),
        F.count_if(evaluated).alias("evaluated"),
        F.count_if(evaluated & F.col("resolved")).alias("resolved_instances"),
        F.count_if(failed).alias("error_instances"),
    )
    whole = F.col("total_instances") if total is None else F.lit(total)
    return counts.select(
        "total_instances",
        "evaluated",
        _rate(F.col("evaluated"), whole).alias("completion_rate"),
        "resolved_instances",
        (F.col("evaluated") - F.col("resolved_instances")).alias("unresolved_instances"),
        "error_instances",
        _rate(F.col("resolved_instances"), F.col("evaluated")).alias("resolve_rate"),
    )


def run_id_lists(results: DataFrame) -> DataFrame:
    failed = _has_error(F.col("error"))
    which = F.when(failed, F.lit("error")).when(F.col("resolved"), F.lit("resolved"))
    return results.select(which.alias("list"), "instance_id").where(F.col("list").isNotNull())


def functional_report(outcomes: DataFrame) -> DataFrame:
    """One row over executed samples; errors and empty stay 0."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    ).select(
        "total",
        "passed",
        "failed",
        F.lit(0).cast("bigint").alias("errors"),
        F.lit(0).cast("bigint").alias("empty"),
        _rate(F.col("passed"), F.col("total")).alias("pass_rate"),
    )


def generation_report(dataset: DataFrame, predictions: DataFrame) -> DataFrame:
    """How many dataset ids have a prediction, and how many results are errors."""
    errors = predictions.groupBy("instance_id").agg(
        F.count_if(_has_error(F.col("error"))).alias("_errors")
    )
    return dataset.join(errors, "instance_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_errors").isNotNull()).alias("patches_generated"),
        F.coalesce(F.sum("_errors"), F.lit(0)).alias("errors"),
    )


def multi_turn_summary(results: DataFrame) -> DataFrame:
    """Average turns over results without error; early exits over all results."""
    counted = ~_has_error(F.col("error"))
    return results.agg(
        F.avg(F.when(counted, F.coalesce("num_turns", F.lit(1)))).alias("avg_turns"),
        F.count_if(F.coalesce("stopped_early", F.lit(False))).alias("early_exits"),
        F.count_if(counted).alias("counted"),
    )


def overall_stats(runs: DataFrame, instances: DataFrame) -> DataFrame:
    """One row over all runs and all stored instances, those without runs included.

    `instances` has one row per id.
    """
    per_instance = runs.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("resolved").alias("ok"),
        F.sum(F.col("steps").cast("bigint")).alias("steps"),
        F.sum("total_tokens").alias("tokens"),
    )
    stored = instances.agg(F.count(F.lit(1))).scalar()
    return per_instance.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_runs"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("resolved_runs"),
        F.count_if(F.col("ok") > 0).alias("resolved_instances"),
        F.coalesce(F.sum("steps"), F.lit(0)).alias("total_steps"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    ).select(
        stored.alias("instances"),
        "*",
        F.coalesce(F.floor(F.try_divide(F.col("total_runs"), stored)), F.lit(0)).alias("runs_per_instance"),
        F.try_divide("resolved_runs", "total_runs").alias("run_rate"),
        F.try_divide(F.col("resolved_instances"), stored).alias("any_rate"),
    )


def per_repo_table(runs: DataFrame, instances: DataFrame) -> DataFrame:
    """One row per repo that has runs and one for all of them (`scope` = overall).

    Runs are rolled up to instances first; the repo is then joined to one row
    per instance. `instances` counts all stored ones of a repo, those without
    runs included; it has one row per id.
    """
    per_instance = runs.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("resolved").alias("ok"),
        F.sum(F.col("steps").cast("bigint")).alias("steps"),
        F.sum("total_tokens").alias("tokens"),
    )
    repo = F.col("repo")
    return (
        instances.select("instance_id", F.coalesce("repo", F.lit("unknown")).alias("repo"))
        .join(per_instance, "instance_id", "left")
        .groupingSets([[repo], []], repo)
        .agg(
            F.grouping("repo").alias("_all"),
            F.count(F.lit(1)).alias("instances"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("runs"),
            F.coalesce(F.sum("ok"), F.lit(0)).alias("resolved_runs"),
            F.sum("steps").alias("_steps"),
            F.sum("tokens").alias("_tokens"),
        )
        .where((F.col("_all") == 1) | (F.col("runs") > 0))
        .select(
            F.when(F.col("_all") == 1, "overall").otherwise("repo").alias("scope"),
            F.when(F.col("_all") == 1, "").otherwise(repo).alias("repo"),
            "instances",
            "runs",
            "resolved_runs",
            F.try_divide("resolved_runs", "runs").alias("rate"),
            F.try_divide("_steps", "runs").alias("avg_steps"),
            F.try_divide("_tokens", "runs").alias("avg_tokens"),
        )
        .orderBy("scope", "repo")
    )


def outcome_histogram(runs: DataFrame) -> DataFrame:
    """Runs per reason with their share, most frequent first."""
    counts = runs.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(
        F.count(F.lit(1)).alias("runs")
    )
    total = counts.agg(F.sum("runs")).scalar()
    return counts.select(
        "reason", "runs", (F.col("runs") / total).alias("share")
    ).orderBy(F.desc("runs"), "reason")


COHORT_METRICS = ("total_tokens", "steps", "wall_clock_seconds")


COHORTS = ("non_error", "resolved", "unresolved", "mixed")


def cohort_stats(runs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Distribution of tokens, steps and seconds in four cohorts of runs.

    Cohorts: non_error, resolved, unresolved (without errors) and mixed (all
    runs of mixed-outcome instances). Runs are counted per value and set of
    cohorts before they are fanned out to the cohorts. There are twelve groups
    whatever the data, which bounds the rank table that is broadcast.
    """
    signals = rollup.select(
        "instance_id",
        "n_runs",
        (signal_class(F.col("n_resolved"), F.col("n_runs")) == "mixed").alias("_mixed"),
    )
    ok = ~F.col("reason").eqNullSafe("error")
    member = {
        "non_error": ok,
        "resolved": F.col("resolved"),
        "unresolved": ~F.col("resolved") & ok,
        "mixed": F.col("_mixed"),
    }
    flags = [F.coalesce(member[name], F.lit(False)).alias(name) for name in COHORTS]
    columns = ["instance_id", "reason", "resolved", *COHORT_METRICS]
    tagged = join_summary(runs.select(*columns), signals, "instance_id", "n_runs").select(
        *flags, *[F.col(m).cast("double") for m in COHORT_METRICS]
    )
    long = tagged.unpivot(list(COHORTS), list(COHORT_METRICS), "metric", "measure")
    counted = histogram(long, [*COHORTS, "metric"], "measure")
    sets = F.filter(
        F.array(*[F.when(F.col(name), F.lit(name)) for name in COHORTS]),
        lambda cohort: cohort.isNotNull(),
    )
    fanned = counted.select(F.explode(sets).alias("cohort"), "metric", "value", "weight")
    # A cohort without runs has its row, too.
    none = tagged.sparkSession.createDataFrame(
        [(c, m, None, 0) for c in COHORTS for m in COHORT_METRICS], "cohort string, metric string, value double, weight long"
    )
    fanned = fanned.unionByName(none)
    groups = ["cohort", "metric"]
    return stats_columns(weighted_stats(fanned, groups, small_groups=True), groups)


def episode_features(steps: DataFrame, patches: DataFrame) -> DataFrame:
    """Flat metrics per finished episode.

    `steps` has one row per executed step: session_id, exit_code, stdout;
    `patches` one row per episode: session_id, patch, resolved.
    """
    from runlens.functions.answers import binary_reward
    from runlens.functions.patches import patch_stats

    totals = steps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_steps"),
        F.count_if(F.col("exit_code") != 0).alias("_nonzero"),
        F.sum(F.length("stdout").cast("bigint")).alias("_chars"),
    )
    stats = patch_stats(F.col("patch"))
    joined = patches.withColumn("_stats", stats).join(totals, "session_id", "left")
    count = F.coalesce("_steps", F.lit(0))
    return joined.select(
        "session_id",
        binary_reward(F.col("resolved")).alias("resolved"),
        count.alias("steps"),
        F.col("_stats.patch_lines").alias("patch_lines"),
        F.col("_stats.files_changed").alias("files_changed"),
        F.col("_stats.empty_patch").cast("double").alias("empty_patch"),
        (count <= 1).cast("double").alias("immediate_submit"),
        F.coalesce("_nonzero", F.lit(0)).alias("nonzero_exits"),
        F.coalesce("_chars", F.lit(0)).alias("total_output_chars"),
    )
