"""End-to-end jobs: stored inputs in, stored tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.prompts import CHAT_TEMPLATE, build_chat_prompt
from runlens.operators import joins, reports, sampling, scoring, sessions, signals
from runlens.session import materialize, scratch
from runlens.sources import readers, writers


def build_training_set(
    instances: DataFrame,
    output: str,
    limit: int = 0,
    shuffle: bool = False,
    seed: int = 42,
    template: str = CHAT_TEMPLATE,
) -> None:
    """Select instances, build their prompts and write {input, label} lines.

    `instances` needs instance_id, problem_statement and, when not shuffled
    and limited, `seq` for the order.
    """
    chosen = instances
    if shuffle and limit > 0:
        chosen = sampling.seeded_sample(instances, limit, seed)
    elif shuffle:
        chosen = instances.orderBy(sampling.shuffle_key(seed, "instance_id"), "instance_id")
    elif limit > 0:
        chosen = sampling.instance_limit(instances, limit)
    prompt = build_chat_prompt(F.col("problem_statement"), template)
    writers.write_training_jsonl(writers.training_lines(chosen, prompt), output)


def analyze_results(spark: SparkSession, results: str, output: str) -> dict[str, str]:
    """Report tables over a folder of instance results; name -> path.

    The runs are stored in long form once, since every table needs them.
    """
    stored = readers.read_jsonl_strict(spark, results, schemas.INSTANCE_RESULT)
    with scratch(spark):
        runs = materialize(signals.explode_runs(stored), "runs")
        # One row per id, also where an id is stored again or once without its repo.
        instances = materialize(stored.groupBy("instance_id").agg(F.min("repo").alias("repo")), "instances")
        rollup = materialize(signals.instance_rollup(runs, instances), "rollup")
        tables = {
            "overall": reports.overall_stats(runs, instances),
            "summary": signals.eval_summary(rollup),
            "outcomes": reports.outcome_histogram(runs),
            "per_repo": reports.per_repo_table(runs, instances),
            "distributions": reports.cohort_stats(runs, rollup),
            "group_signal": signals.group_signal(rollup),
            "mixed_outcomes": signals.mixed_histogram(rollup),
        }
        return _store(tables, output)


def grade_predictions(
    spark: SparkSession, dataset: DataFrame, prediction_root: str, results: DataFrame, output: str
) -> dict[str, str]:
    """Merge stored predictions in dataset order and report on their results.

    `dataset` is (instance_id, seq); `results` has instance_id, resolved,
    patch_exists, error, num_turns and stopped_early.
    """
    predictions = readers.read_prediction_tree(spark, prediction_root)
    named = predictions.withColumn("error", F.lit(None).cast("string"))
    tables = {
        "predictions": writers.merge_predictions(dataset, predictions),
        "generated": reports.generation_report(dataset, named),
        "grades": reports.grade_report(results),
        "grade_ids": reports.grade_id_lists(results),
        "run_report": reports.run_report(results),
        "run_ids": reports.run_id_lists(results),
        "multi_turn": reports.multi_turn_summary(results),
    }
    return _store(tables, output)


def replay_sessions(
    generations: DataFrame,
    verdicts: DataFrame,
    checks: Sequence[str],
    max_turns: int,
    aggregator: str = "mean",
    weights: Mapping[str, float] | None = None,
    final: Sequence[str] = ("swe_test",),
) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) of multi-turn runs that stop at the first passing turn.

    `generations` is (session_id, turn, output), `verdicts` (session_id, turn,
    name, status, score, pass_threshold). `checks` names the intermediate
    verifiers in their order; without any, no session stops early. Turns from
    `max_turns` on were never made. `final` names the verifiers whose verdicts
    on the last kept turn make the final score, 1.0 without any.

    turns: session_id, turn, output, aggregate_score, feedback,
    verifier_results (name, status, score, passed).
    sessions: session_id, final_output, num_turns, stopped_early,
    final_aggregate_score.
    """
    keys = ["session_id", "turn"]
    made = generations.where(F.col("turn") < max_turns)
    judged = scoring.judged_turns(verdicts.where(F.col("name").isin(list(checks))), checks, aggregator, weights)
    scored = made.join(judged, keys, "left").withColumns(
        {
            "all_passed": F.coalesce("all_passed", F.lit(True)),
            "aggregate_score": F.coalesce("aggregate_score", F.lit(1.0)),
            "verifier_results": F.coalesce("verifier_results", F.array().cast(judged.schema["verifier_results"].dataType)),
        }
    )
    # Cut first: feedback is rendered for the turns that stay.
    kept = sessions.kept_turns(scored) if checks else scored
    feedback = F.coalesce(scoring.feedback_of(checks, max_turns), F.lit("")) if checks else F.lit("")
    turns = kept.select(*keys, "output", "aggregate_score", feedback.alias("feedback"), "verifier_results")

    ends = sessions.session_replay(scored.select(*keys, "output", "all_passed"), has_verifiers=bool(checks))
    last = scoring.judged_turns(verdicts.where(F.col("name").isin(list(final))), final, aggregator, weights).select(
        F.col("session_id").alias("_session"),
        (F.col("turn") + 1).alias("_turns"),
        F.col("aggregate_score").alias("_final"),
    )
    finished = ends.join(
        last, (F.col("session_id") == F.col("_session")) & (F.col("num_turns") == F.col("_turns")), "left"
    )
    return turns, finished.select(*ends.columns, F.coalesce("_final", F.lit(1.0)).alias("final_aggregate_score"))


def evaluate_samples(samples: DataFrame, problems: DataFrame, outcomes: DataFrame, output: str) -> dict[str, str]:
    """Report on executed samples; a sample of an unknown problem fails the job.

    `samples` and `problems` share task_id; `outcomes` is (task_id, sample_id,
    timed_out, failure) of the executions, which happen elsewhere.
    """
    from runlens.functions.actions import classify_exec_result

    known = joins.join_samples_problems(samples, problems, "task_id")
    judged = known.join(outcomes, ["task_id", "sample_id"], "left").withColumn(
        "result",
        classify_exec_result(F.coalesce("timed_out", F.lit(True)), F.col("failure")),
    )
    with scratch(samples.sparkSession):
        results = materialize(
            judged.select("task_id", "sample_id", "result", (F.col("result") == "passed").alias("passed")),
            "outcomes",
        )
        return _store({"summary": reports.functional_report(results), "instances": results}, output)


def _store(tables: dict[str, DataFrame], output: str) -> dict[str, str]:
    paths = {name: f"{output}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(paths[name])
    return paths
