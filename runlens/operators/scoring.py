"""Session scores over verdict rows.

Verdicts are (session_id, name, status, score, pass_threshold); sessions hold
one row per session and decide which sessions appear, with or without verdicts.
All groupings are plain partial aggregates, so one large session only sends
its combined rows to the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.verdicts import (
    checked_weight,
    feedback_line,
    score_by_name,
    verifier_passed,
    weight_of,
)
from runlens.operators.skew import join_summary
from runlens.schemas import VERIFIER_STATUSES

# Texts of the feedback message.
FEEDBACK_HEAD = "Your solution was evaluated. Here is the feedback:\n"
ALL_PASSED = "\nAll checks passed."
PLEASE_REVISE = "\nPlease revise your solution to address the issues above."


def session_scores(
    sessions: DataFrame,
    verdicts: DataFrame,
    aggregator: str = "mean",
    weights: Mapping[str, float] | None = None,
    keys: Sequence[str] = ("session_id",),
) -> DataFrame:
    """`aggregate_score` per session; 1.0 without verdicts or without weight."""
    weight = F.lit(1.0)
    if aggregator == "weighted_sum":
        if "weight" in verdicts.columns:
            weight = F.col("weight")
        elif weights:
            weight = weight_of(F.col("name"), weights)
    score = score_by_name(aggregator, F.col("status"), F.col("score"), weight)
    scored = verdicts.groupBy(*keys).agg(score.alias("_score"))
    return sessions.join(scored, list(keys), "left").select(
        *sessions.columns, F.coalesce("_score", F.lit(1.0)).alias("aggregate_score")
    )


def all_passed(
    sessions: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """`all_passed` per session, true without verdicts."""
    passed = verdicts.groupBy(*keys).agg(
        F.bool_and(
            verifier_passed(F.col("status"), F.col("score"), F.col("pass_threshold"))
        ).alias("_all")
    )
    return sessions.join(passed, list(keys), "left").select(
        *sessions.columns, F.coalesce("_all", F.lit(True)).alias("all_passed")
    )


def join_weights(verdicts: DataFrame, weights: DataFrame) -> DataFrame:
    """Attach `weight` by verifier name: 1.0 when unlisted, negative fails."""
    listed = weights.select("name", F.col("weight").alias("_w"))
    return verdicts.join(listed, "name", "left").select(
        *verdicts.columns, checked_weight(F.col("_w"), F.col("name")).alias("weight")
    )


def scheduled_verdicts(
    verdicts: DataFrame,
    intermediate: Sequence[str] = (),
    final: Sequence[str] = (),
    default_final: Sequence[str] = ("swe_test",),
) -> DataFrame:
    """One row per verdict and phase its verifier is scheduled for.

    The flags are configuration: a handful of names that become literals.
    """
    chosen_final = list(final) or list(default_final)
    phases = F.filter(
        F.array(
            F.when(F.col("name").isin(list(intermediate)), F.lit("intermediate")),
            F.when(F.col("name").isin(chosen_final), F.lit("final")),
        ),
        lambda phase: phase.isNotNull(),
    )
    return verdicts.select("*", F.explode(phases).alias("phase"))


def latest_verdicts(
    verdicts: DataFrame, order: Sequence[str], seq: str, keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Last verdict per verifier, for the configured verifiers, with their set order."""
    fields = [c for c in verdicts.columns if c not in (*keys, "name", seq)]
    rank = F.create_map(*[F.lit(item) for i, name in enumerate(order) for item in (name, i)])
    return (
        verdicts.where(F.col("name").isin(list(order)))
        .groupBy(*keys, "name")
        .agg(F.max_by(F.struct(*fields), F.col(seq)).alias("_last"))
        .select(*keys, "name", F.element_at(rank, F.col("name")).alias("set_order"), "_last.*")
    )


def batch_accuracy(rewards: DataFrame, batch: str, reward: str = "reward") -> DataFrame:
    return rewards.groupBy(batch).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(reward).alias("accuracy")
    )


def group_norm_reward(
    rewards: DataFrame,
    prompt: str,
    reward: str = "reward",
    eps: float = 1e-8,
    ddof: int = 0,
) -> DataFrame:
    """`advantage` = (reward - prompt mean) / (prompt std + eps).

    The per-prompt figures are aggregated first and joined back, so that a
    prompt with very many samples is never gathered in one window task.
    """
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = rewards.groupBy(prompt).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(reward).alias("_mean"),
        spread(reward).alias("_std"),
    )
    centred = F.col(reward) - F.col("_mean")
    width = F.coalesce(F.col("_std"), F.lit(0.0)) + F.lit(eps)
    return join_summary(rewards, stats, prompt, "_n").select(
        *rewards.columns, F.coalesce(F.try_divide(centred, width), F.lit(0.0)).alias("advantage")
    )


def judged_turns(
    verdicts: DataFrame,
    order: Sequence[str],
    aggregator: str = "mean",
    weights: Mapping[str, float] | None = None,
    lines: str | None = None,
) -> DataFrame:
    """One row per (session_id, turn): aggregate_score, all_passed, verifier_results and what feedback needs.

    All of it comes from one partial aggregate over codes and numbers.
    `verifier_results` has an entry per verifier of `order` that gave a verdict.
    """
    name, status = F.col("name"), F.col("status")
    score, threshold = F.col("score"), F.col("pass_threshold")
    statuses = F.array(*[F.lit(s) for s in VERIFIER_STATUSES])
    weight = weight_of(name, weights) if weights and aggregator == "weighted_sum" else F.lit(1.0)

    def of(check: str, value: Column) -> Column:
        return F.max(F.when(name == check, value))

    grouped = verdicts.groupBy("session_id", "turn").agg(
        F.coalesce(score_by_name(aggregator, status, score, weight), F.lit(1.0)).alias("aggregate_score"),
        F.bool_and(verifier_passed(status, score, threshold)).alias("all_passed"),
        *[
            column
            for i, check in enumerate(order)
            for column in (
                of(check, F.array_position(statuses, status)).alias(f"_status{i}"),
                of(check, score).alias(f"_score{i}"),
                of(check, threshold).alias(f"_threshold{i}"),
            )
        ],
        *[of(check, F.col(lines)).alias(f"_line{i}") for i, check in enumerate(order) if lines],
    )
    results = []
    for i, check in enumerate(order):
        known = F.element_at(statuses, F.col(f"_status{i}").cast("int"))
        entry = F.struct(
            F.lit(check).alias("name"),
            known.alias("status"),
            F.col(f"_score{i}").alias("score"),
            verifier_passed(known, F.col(f"_score{i}"), F.col(f"_threshold{i}")).alias("passed"),
        )
        results.append(F.when(F.col(f"_status{i}").isNotNull(), entry))
    given = F.filter(F.array(*results), lambda r: r.isNotNull())
    return grouped.withColumn("verifier_results", given)


def feedback_of(order: Sequence[str], max_turns: int, lines: str | None = None) -> Column:
    """Feedback text of a row of `judged_turns`; empty on the last allowed turn and when everything passed."""
    statuses = F.array(*[F.lit(s) for s in VERIFIER_STATUSES])
    shown = []
    for i, check in enumerate(order):
        line = F.when(
            F.col(f"_status{i}").isNotNull(),
            feedback_line(
                F.lit(check),
                F.element_at(statuses, F.col(f"_status{i}").cast("int")),
                F.col(f"_score{i}"),
                F.col(f"_threshold{i}"),
            ),
        )
        shown.append(F.coalesce(F.col(f"_line{i}"), line) if lines else line)
    silent = F.col("all_passed") | (F.col("turn") == max_turns - 1)
    return F.when(silent, F.lit("")).otherwise(feedback_message(shown, F.col("all_passed")))


def turn_feedback(
    verdicts: DataFrame, order: Sequence[str], max_turns: int, lines: str | None = None
) -> DataFrame:
    """`feedback` per turn, one line per verifier in set order.

    Verdicts are (session_id, turn, name, status, score, pass_threshold). The
    text is empty on the last allowed turn and when everything passed. Codes
    and scores are aggregated and the text is built afterwards, so no text
    sits in the aggregation buffers. Verifiers with a feedback of their own
    put it into a column named by `lines`; it replaces the default line where
    it is not null.
    """
    judged = judged_turns(verdicts, order, lines=lines)
    return judged.select("session_id", "turn", feedback_of(order, max_turns, lines).alias("feedback"))


def feedback_message(lines: Sequence[Column], all_pass: Column) -> Column:
    """Feedback text from one line per verifier; null lines are skipped."""
    given = F.filter(F.array(*lines), lambda line: line.isNotNull())
    footer = F.when(all_pass, F.lit(ALL_PASSED)).otherwise(
        F.lit(PLEASE_REVISE)
    )
    return F.array_join(
        F.concat(
            F.array(F.lit(FEEDBACK_HEAD)),
            given,
            F.array(footer),
        ),
        "\n",
    )
