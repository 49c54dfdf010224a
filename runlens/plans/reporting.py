"""Report queries over runs, grades and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.verdicts import unit_test_feedback as unit_test_feedback_column
from runlens.operators import reports, signals, sketches
from runlens.operators.quantiles import distribution_stats
from runlens.operators.sampling import top_failures
from runlens.operators.sessions import session_replay
from runlens.plans.registry import query
from runlens.session import work_path
from runlens.sources import fixtures as fx

SIGNAL = "case when n_resolved = 0 then 'always_fail' when n_resolved = n_runs then 'always_pass' else 'mixed' end"


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return signals.instance_rollup(fx.bare_runs(spark, sf), fx.instances_of_runs(spark, sf))


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, places) + 0.0 for name in names})


@query(
    "grade_report",
    """
with g as (select case when error is not null then 'error' when not patch_exists then 'empty'
 when resolved then 'passed' else 'failed' end as kind from predictions)
select count(*) as total, count(*) filter (kind = 'passed') as passed, count(*) filter (kind <> 'passed') as failed,
 count(*) filter (kind = 'error') as errors, count(*) filter (kind = 'empty') as empty,
 round(count(*) filter (kind = 'passed') / count(*)::double, 6) as pass_rate from g
""",
)
def grade_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.grade_report(fx.predictions(spark, sf)), "pass_rate")


@query(
    "grade_id_lists",
    """
select 'error' as list, instance_id from predictions where error is not null
union all select 'failed', instance_id from predictions where error is not null or not patch_exists or not resolved
union all select 'passed', instance_id from predictions where error is null and patch_exists and resolved
""",
)
def grade_ids(spark: SparkSession, sf: str) -> DataFrame:
    return reports.grade_id_lists(fx.predictions(spark, sf))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Run results: the evaluation of those without a patch never came back."""
    return fx.predictions(spark, sf).select(
        "instance_id", F.when(F.col("patch_exists"), F.col("resolved")).alias("resolved"), "error"
    )


@query(
    "run_report",
    """
with r as (select error is not null as bad, error is null and patch_exists as evaluated, resolved from predictions)
select count(*) as total_instances, count(*) filter (evaluated) as evaluated,
 round(count(*) filter (evaluated) / count(*)::double, 6) as completion_rate,
 count(*) filter (evaluated and resolved) as resolved_instances,
 count(*) filter (evaluated and not resolved) as unresolved_instances, count(*) filter (bad) as error_instances,
 round(count(*) filter (evaluated and resolved) / count(*) filter (evaluated)::double, 6) as resolve_rate from r
""",
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.run_report(_results(spark, sf)), "completion_rate", "resolve_rate")


@query(
    "run_id_lists",
    """
select 'error' as list, instance_id from predictions where error is not null
union all select 'resolved', instance_id from predictions where error is null and patch_exists and resolved
""",
)
def run_ids(spark: SparkSession, sf: str) -> DataFrame:
    return reports.run_id_lists(_results(spark, sf))


@query(
    "functional_report",
    """
select count(*) as total, count(*) filter (quality = 1 and toxic <> 1) as passed,
 count(*) filter (not (quality = 1 and toxic <> 1)) as failed, 0::bigint as errors, 0::bigint as empty,
 round(count(*) filter (quality = 1 and toxic <> 1) / count(*)::double, 6) as pass_rate from labels
""",
)
def functional_report(spark: SparkSession, sf: str) -> DataFrame:
    from runlens.plans.extraction import classify_exec_result

    return _rounded(reports.functional_report(classify_exec_result(spark, sf)), "pass_rate")


@query(
    "patches_generated",
    """
select count(*) as total, count(p.instance_id) as patches_generated, count(p.error) as errors
from instances left join predictions p using (instance_id)
""",
)
def patches_generated(spark: SparkSession, sf: str) -> DataFrame:
    return reports.generation_report(
        fx.instances(spark, sf).select("instance_id"), fx.predictions(spark, sf)
    )


@query(
    "overall_stats",
    """
select (select count(*) from all_instances) as instances, count(*) as total_runs, count(*) filter (resolved) as resolved_runs,
 count(distinct instance_id) filter (resolved) as resolved_instances, sum(steps)::bigint as total_steps,
 sum(total_tokens)::bigint as total_tokens, count(*) // (select count(*) from all_instances) as runs_per_instance,
 round(count(*) filter (resolved) / count(*)::double, 6) as run_rate,
 round(count(distinct instance_id) filter (resolved) / (select count(*) from all_instances)::double, 6) as any_rate from runs
""",
)
def overall_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = reports.overall_stats(fx.bare_runs(spark, sf), fx.instances_of_runs(spark, sf))
    return _rounded(stats, "run_rate", "any_rate")


@query(
    "per_repo_table",
    """
select case when grouping(i.repo) = 1 then 'overall' else 'repo' end as scope, coalesce(i.repo, '') as repo,
 count(distinct i.instance_id) as instances, count(run_id) as runs, count(*) filter (resolved) as resolved_runs,
 round(count(*) filter (resolved) / count(run_id)::double, 6) as rate, round(sum(steps) / count(run_id)::double, 6) as avg_steps,
 round(sum(total_tokens) / count(run_id)::double, 6) as avg_tokens
from all_instances i left join runs using (instance_id) group by grouping sets ((i.repo), ()) having count(run_id) > 0
""",
)
def per_repo(spark: SparkSession, sf: str) -> DataFrame:
    table = reports.per_repo_table(fx.bare_runs(spark, sf), fx.instances_of_runs(spark, sf))
    return _rounded(table, "rate", "avg_steps", "avg_tokens")


# A mean may end exactly half-way between two rounded values; the nudge lets
# both engines round it the same way whatever their last bit.
NUDGE = 1e-7
STATS_SQL = """
count({v}) as n, round(avg({v}) + 0.0000001, 4) as mean, round(quantile_cont({v}, 0.5), 4) as median,
 round(stddev_pop({v}), 4) as std, round(quantile_cont({v}, 0.1), 4) as p10, round(quantile_cont({v}, 0.25), 4) as p25,
 round(quantile_cont({v}, 0.75), 4) as p75, round(quantile_cont({v}, 0.9), 4) as p90,
 round(min({v}), 4) as min, round(max({v}), 4) as max
"""


def _rounded_stats(stats: DataFrame) -> DataFrame:
    return _rounded(stats.withColumn("mean", F.col("mean") + NUDGE), *STATS, places=4)


STATS = ("mean", "median", "std", "p10", "p25", "p75", "p90", "min", "max")


@query(
    "distribution_stats",
    f"select repo, {STATS_SQL.format(v='wall_clock_seconds').strip()} from runs group by repo",
)
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    stats = distribution_stats(fx.runs(spark, sf), ["repo"], "wall_clock_seconds")
    return _rounded_stats(stats)


@query(
    "cohort_stats",
    f"""
with tagged as (
 select r.*, {SIGNAL} as signal from runs r join rollup_view u using (instance_id)),
cohorts as (
 select 'non_error' as cohort, * from tagged where reason is distinct from 'error'
 union all select 'resolved', * from tagged where resolved
 union all select 'unresolved', * from tagged where not resolved and reason is distinct from 'error'
 union all select 'mixed', * from tagged where signal = 'mixed'),
long as (
 select cohort, 'total_tokens' as metric, total_tokens::double as v from cohorts
 union all select cohort, 'steps', steps::double from cohorts
 union all select cohort, 'wall_clock_seconds', wall_clock_seconds from cohorts)
select cohort, metric, {STATS_SQL.format(v='v').strip()} from long group by cohort, metric
""",
)
def cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_stats(reports.cohort_stats(fx.bare_runs(spark, sf), _rollup(spark, sf)))


@query(
    "outcome_histogram",
    """
select coalesce(reason, 'unknown') as reason, count(*) as runs,
 round(count(*) / (select count(*) from runs)::double, 6) as share from runs group by 1
""",
)
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.outcome_histogram(fx.bare_runs(spark, sf)), "share")


@query(
    "instance_rollup",
    """
select instance_id, repo, n_runs, n_resolved, round(resolve_rate, 6) as resolve_rate,
 round(avg_steps, 6) as avg_steps, round(avg_tokens, 6) as avg_tokens from rollup_view
""",
)
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_rollup(spark, sf), "resolve_rate", "avg_steps", "avg_tokens")


@query(
    "instance_runs",
    """
select instance_id, run_idx // 4 as part, repo, count(*) as n,
 string_agg(concat(run_idx, ':', run_id, ':', steps, ':', total_tokens, ':', case when resolved then 'y' else 'n' end),
  ',' order by run_idx) as runs
from runs group by instance_id, run_idx // 4, repo
""",
)
def nested_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records of at most four runs, flattened to text."""
    nested = signals.nest_runs(fx.indexed_runs(spark, sf), per_record=4)
    shown = F.transform(
        "runs",
        lambda r: F.concat_ws(
            ":",
            r["run_idx"],
            r["run_id"],
            r["steps"],
            r["total_tokens"],
            F.when(r["resolved"], "y").otherwise("n"),
        ),
    )
    return nested.select(
        "instance_id",
        "part",
        "repo",
        F.size("runs").cast("bigint").alias("n"),
        F.array_join(shown, ",").alias("runs"),
    )


@query(
    "eval_summary",
    """
select count(*) as instances, count(*) filter (resolve_rate > 0) as resolved_any,
 round(avg(resolve_rate), 6) as avg_resolve_rate, round(avg(avg_steps), 6) as avg_steps,
 round(avg(avg_tokens), 6) as avg_tokens, sum(n_runs)::bigint as total_runs, sum(n_resolved)::bigint as resolved_runs,
 round(count(*) filter (resolve_rate > 0) / count(*)::double, 6) as resolved_any_rate,
 round(sum(n_resolved) / sum(n_runs)::double, 6) as run_resolve_rate from rollup_view
""",
)
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        signals.eval_summary(_rollup(spark, sf)),
        "avg_resolve_rate",
        "avg_steps",
        "avg_tokens",
        "resolved_any_rate",
        "run_resolve_rate",
    )


SIGNAL_COUNTS = f"""
max(n_runs) as k, count(*) as instances, count(*) filter ({SIGNAL} = 'always_fail') as always_fail,
 count(*) filter ({SIGNAL} = 'always_pass') as always_pass, count(*) filter ({SIGNAL} = 'mixed') as mixed,
 max(n_runs) > 1 as applicable,
 round(count(*) filter ({SIGNAL} = 'always_fail') / count(*)::double, 6) as always_fail_share,
 round(count(*) filter ({SIGNAL} = 'always_pass') / count(*)::double, 6) as always_pass_share,
 round(count(*) filter ({SIGNAL} = 'mixed') / count(*)::double, 6) as mixed_share
"""
SHARES = ("always_fail_share", "always_pass_share", "mixed_share")


@query("group_signal", f"select {SIGNAL_COUNTS.strip()} from rollup_view")
def group_signal(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(signals.group_signal(_rollup(spark, sf)), *SHARES)


@query("group_signal_by_repo", f"select repo, {SIGNAL_COUNTS.strip()} from rollup_view group by repo")
def signal_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(signals.group_signal(_rollup(spark, sf), by="repo"), *SHARES)


@query(
    "mixed_histogram",
    """
select concat(n_resolved, '/', n_runs) as outcome, n_resolved, n_runs, count(*) as instances
from rollup_view where n_resolved > 0 and n_resolved < n_runs group by n_resolved, n_runs
""",
)
def mixed_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return signals.mixed_histogram(_rollup(spark, sf))


@query(
    "multi_turn_summary",
    """
with stops as (select session_id, min(turn) filter (all_passed) as stop, max(turn) as last_turn from generations group by 1),
r as (select case when cast(session_id as bigint) % 3 = 0 then null else coalesce(stop, last_turn) + 1 end as num_turns,
 stop is not null as early, cast(session_id as bigint) % 7 = 0 as bad from stops)
select round(avg(coalesce(num_turns, 1)) filter (not bad), 6) as avg_turns, count(*) filter (early) as early_exits,
 count(*) filter (not bad) as counted from r
""",
)
def multi_turn_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Some results lack the turn count, some are errors."""
    number = F.col("session_id").cast("bigint")
    results = session_replay(fx.generations(spark, sf)).select(
        F.when(number % 3 != 0, F.col("num_turns")).alias("num_turns"),
        "stopped_early",
        F.when(number % 7 == 0, "agent job failed").alias("error"),
    )
    return _rounded(reports.multi_turn_summary(results), "avg_turns")


@query(
    "episode_features",
    """
with steps as (select session_id, count(*) as n, count(*) filter (length(text) % 3 <> 0) as bad, sum(length(text)) as chars
 from turns where role = 'user' group by 1),
patched as (select session_id, arg_max(text, turn) as patch, count(*) % 2 = 0 as ok from turns group by 1)
select p.session_id, case when ok then 1.0::double else 0.0::double end as resolved, coalesce(n, 0) as steps,
 (length(patch) - length(replace(patch, chr(10), '')) + 1)::bigint as patch_lines, 1::bigint as files_changed,
 0.0::double as empty_patch, case when coalesce(n, 0) <= 1 then 1.0::double else 0.0::double end as immediate_submit,
 coalesce(bad, 0) as nonzero_exits, coalesce(chars, 0)::bigint as total_output_chars
from patched p left join steps s using (session_id)
""",
)
def episode_features(spark: SparkSession, sf: str) -> DataFrame:
    """User messages are the outputs of steps, the last message is the patch."""
    turns = fx.turns(spark, sf)
    steps = turns.where(F.col("role") == "user").select(
        "session_id",
        (F.length("text") % 3).alias("exit_code"),
        F.col("text").alias("stdout"),
    )
    patches = turns.groupBy("session_id").agg(
        F.concat(F.lit("diff --git a/x b/x\n"), F.max_by("text", "turn")).alias("patch"),
        (F.count(F.lit(1)) % 2 == 0).alias("resolved"),
    )
    return reports.episode_features(steps, patches).withColumns(
        {
            "patch_lines": F.col("patch_lines").cast("bigint"),
            "files_changed": F.col("files_changed").cast("bigint"),
        }
    )


@query(
    "top_failures",
    """
with f as (select instance_id, test, row_number() over (partition by instance_id order by test) as rn,
  count(*) over (partition by instance_id) as failing from tests where status in ('FAILED', 'ERROR'))
select instance_id, failing, concat('  Failing tests (', failing, '):', chr(10),
  string_agg(concat('    - ', test), chr(10) order by rn) filter (rn <= 3),
  case when failing > 3 then concat(chr(10), '    ... and ', failing - 3, ' more') else '' end) as feedback
from f group by instance_id, failing
""",
)
def failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.tests(spark, sf).withColumn("seq", F.col("test"))
    return top_failures(rows, limit=3)


@query(
    "unit_test_feedback",
    """
with t as (select instance_id, test, max(status) as status, min(line) as line, cast(instance_id as bigint) as n from tests
  group by instance_id, test),
g as (select instance_id, n, count(*) filter (status in ('FAILED', 'ERROR')) as bad,
  string_agg(concat('    - ', test), chr(10) order by line, test) filter (status in ('FAILED', 'ERROR')) as names,
  string_agg(concat(test, ' ', status), chr(10) order by line, test) as stdout from t group by instance_id, n)
select instance_id, case when n % 5 = 0 then '[swe_test] ERROR: ' || case when n % 2 = 0 then 'pod lost' else 'unknown error' end
 when bad = 0 then '[swe_test] PASSED: issue resolved'
 when n % 4 = 0 then '[swe_test] FAILED (score: 0.00)' || chr(10) || '  The patch could not be applied to the repository.'
 else concat('[swe_test] FAILED (score: 0.00)', chr(10), '  Failing tests (', bad, '):', chr(10), names, chr(10), chr(10),
  '  Test output:', chr(10), '  ', replace(stdout, chr(10), chr(10) || '  ')) end as feedback
from g
""",
)
def unit_test_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order are the tests of an instance."""
    n = F.col("instance_id").cast("bigint")
    entries = F.sort_array(F.collect_list(F.struct("line", "test", "status")))
    tests = fx.tests(spark, sf).groupBy("instance_id", "test").agg(
        F.max("status").alias("status"), F.min("line").alias("line")
    )
    grouped = tests.groupBy("instance_id").agg(
        F.transform(entries, lambda e: F.struct(e["test"], e["status"])).alias("entries"),
        F.count_if(F.col("status").isin("FAILED", "ERROR")).alias("bad"),
    )
    stdout = F.array_join(F.transform("entries", lambda e: F.concat_ws(" ", e["test"], e["status"])), "\n")
    feedback = unit_test_feedback_column(
        F.when(n % 5 == 0, "error").otherwise("ok"),
        F.when(F.col("bad") == 0, 1.0).otherwise(0.0),
        F.lit(1.0),
        n % 4 != 0,
        F.map_from_entries("entries"),
        stdout,
        F.when(n % 2 == 0, "pod lost"),
    )
    return grouped.select("instance_id", feedback.alias("feedback"))


@query(
    "sketched_distribution",
    """
select o_orderstatus as status, count(*) as n, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as min, max(o_totalprice) as max,
 5::bigint as within from orders group by o_orderstatus
""",
)
def sketched_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Run times by status from stored sketches per month, the last years added later; `within` counts the percentiles whose exact rank is near."""
    orders = fx.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")
    path, percents = work_path(spark, "sketches"), (10, 25, 50, 75, 90)
    late = F.year("o_orderdate") >= 1996
    for part in (orders.where(~late), orders.where(late)):
        sketches.store_days(sketches.daily_sketches(part, F.trunc("o_orderdate", "month"), ["status"], "o_totalprice"), path)
    found = sketches.merged_distribution(sketches.read_days(spark, path), ["status"])
    gaps = sketches.rank_gaps(orders, found, ["status"], "o_totalprice", percents)
    near = gaps.groupBy("status").agg(F.count_if(F.col("gap") <= 3 * sketches.rank_error()).alias("within"))
    return found.join(near, "status").select("status", "n", F.round("mean", 4).alias("mean"), "min", "max", "within")
