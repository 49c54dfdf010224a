"""Verifier verdicts: pass rule, effective score, aggregates and feedback lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that appear in stored results and prompts.
JOB_TIMED_OUT = "K8s Job timed out"
NO_TEST_OUTPUT = "No test output captured from pod logs"
NOT_APPLIED = "\n  The patch could not be applied to the repository."
ISSUE_RESOLVED = "PASSED: issue resolved"


def verifier_passed(status: Column, score: Column, threshold: Column) -> Column:
    """True for an ok verdict that reaches its threshold; a bad threshold fails."""
    reached = (status == "ok") & (score >= threshold)
    return F.when(
        (threshold < 0) | (threshold > 1),
        F.raise_error(F.concat(F.lit("a threshold lies between 0 and 1, not at "), threshold)),
    ).otherwise(reached).cast("boolean")


def effective_score(status: Column, score: Column) -> Column:
    """The score of an ok verdict; anything else counts as 0.0, skipped too."""
    return F.when(status == "ok", score).otherwise(F.lit(0.0))


def score_mean(status: Column, score: Column) -> Column:
    return F.avg(effective_score(status, score))


def score_min(status: Column, score: Column) -> Column:
    return F.min(effective_score(status, score))


def score_weighted(status: Column, score: Column, weight: Column) -> Column:
    """Weighted mean; null (read as 1.0 by the caller) when all weights are zero."""
    total = F.sum(weight)
    return F.when(total != 0, F.sum(effective_score(status, score) * weight) / total)


def score_by_name(
    name: str, status: Column, score: Column, weight: Column | None = None
) -> Column:
    """Aggregate builder chosen by its configured name."""
    if name == "mean":
        return score_mean(status, score)
    if name == "min":
        return score_min(status, score)
    if name == "weighted_sum":
        return score_weighted(status, score, F.lit(1.0) if weight is None else weight)
    raise ValueError(f"no aggregate named {name!r}: there are mean, min and weighted_sum")


def checked_weight(weight: Column, name: Column) -> Column:
    """Weight 1.0 by default; a negative one fails the job."""
    complaint = F.concat(
        F.lit("verifier "), name, F.lit(" has a weight below 0: "), weight
    )
    return (
        F.when(weight < 0, F.raise_error(complaint))
        .otherwise(F.coalesce(weight, F.lit(1.0)))
        .cast("double")
    )


def weight_of(name: Column, weights: Mapping[str, float]) -> Column:
    """Weight from a configured mapping, which is a literal in the plan."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(
        *[F.lit(item) for pair in weights.items() for item in (pair[0], float(pair[1]))]
    )
    return checked_weight(F.try_element_at(table, name), name)


def verdict_or_default(
    crash: Column,
    verifier_timed_out: Column,
    job_error: Column,
    job_timed_out: Column,
    output: Column,
    grading_error: Column,
    resolved: Column,
) -> Column:
    """struct(status, score, reason): a verdict even when the check did not finish."""

    def verdict(status: str, reason: Column, score: Column | float = 0.0) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            (F.lit(score) if isinstance(score, float) else score).alias("score"),
            reason.cast("string").alias("reason"),
        )

    def given(text: Column) -> Column:
        return F.coalesce(F.length(text), F.lit(0)) > 0

    return (
        F.when(F.coalesce(verifier_timed_out, F.lit(False)), verdict("timeout", F.lit("timeout")))
        .when(crash.isNotNull(), verdict("error", crash))
        .when(given(job_error), verdict("error", job_error))
        .when(
            ~given(output) & F.coalesce(job_timed_out, F.lit(False)),
            verdict("error", F.lit(JOB_TIMED_OUT)),
        )
        .when(~given(output), verdict("error", F.lit(NO_TEST_OUTPUT)))
        .when(grading_error.isNotNull(), verdict("error", grading_error))
        .otherwise(
            verdict("ok", F.lit(None), F.when(resolved, F.lit(1.0)).otherwise(F.lit(0.0)))
        )
    )


def two_decimals(score: Column) -> Column:
    """Text of a score in [0, 1] with two decimals, rounded from its binary value.

    The score times 2**60 is a whole number, so the tie test is exact; Java's
    own formatter rounds the shortest decimal text instead.
    """
    unit = F.lit(2**60).cast("decimal(38,0)")
    hundredths = (score * float(2**60)).cast("bigint").cast("decimal(38,0)") * 100
    rest = hundredths % unit
    down = ((hundredths - rest) / unit).cast("bigint")
    half = F.lit(2**59).cast("decimal(38,0)")
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    rounded = F.when(up, down + 1).otherwise(down)
    return F.concat(
        F.floor(rounded / 100).cast("string"),
        F.lit("."),
        F.lpad((rounded % 100).cast("string"), 2, "0"),
    )


def feedback_line(name: Column, status: Column, score: Column, threshold: Column) -> Column:
    """The default one-line feedback of a verdict."""
    head = F.concat(F.lit("["), name, F.lit("] "))
    label = F.when(verifier_passed(status, score, threshold), F.lit("PASSED")).otherwise(
        F.lit("FAILED")
    )
    return F.when(status != "ok", F.concat(head, F.upper(status))).otherwise(
        F.concat(head, label, F.lit(" (score: "), two_decimals(score), F.lit(")"))
    )


def failing_tests_block(tests_status: Column, limit: int = 20) -> Column:
    """Lines naming the first failing tests of a name -> status map, empty if none."""
    failing = F.transform(
        F.filter(
            F.map_entries(tests_status),
            lambda entry: entry["value"].isin("FAILED", "ERROR"),
        ),
        lambda entry: entry["key"],
    )
    return failing_block(F.slice(failing, 1, limit), F.size(failing), limit)


def failing_block(names: Column, total: Column, limit: int) -> Column:
    listed = F.array_join(
        F.transform(names, lambda name: F.concat(F.lit("    - "), name)), "\n"
    )
    more = F.when(
        total > limit,
        F.concat(F.lit("\n    ... and "), (total - limit).cast("string"), F.lit(" more")),
    ).otherwise(F.lit(""))
    return F.when(
        total > 0,
        F.concat(
            F.lit("  Failing tests ("), total.cast("string"), F.lit("):\n"), listed, more
        ),
    ).otherwise(F.lit(""))


def unit_test_feedback(
    status: Column,
    score: Column,
    threshold: Column,
    applied: Column,
    tests_status: Column,
    stdout: Column,
    error: Column,
    name: str = "swe_test",
) -> Column:
    """Feedback of the test-running verifier with failing tests and an output tail."""
    from runlens.functions.actions import tail_excerpt

    head = f"[{name}] "
    failed = F.concat(F.lit(f"{head}FAILED (score: "), two_decimals(score), F.lit(")"))
    block = failing_tests_block(F.coalesce(tests_status, F.create_map().cast("map<string,string>")))
    excerpt = tail_excerpt(stdout)
    parts = F.filter(F.array(failed, block, excerpt), lambda part: F.length(part) > 0)
    return (
        F.when(
            status != "ok",
            F.concat(
                F.lit(head),
                F.upper(status),
                F.lit(": "),
                F.coalesce(error, F.lit("unknown error")),
            ),
        )
        .when(
            verifier_passed(status, score, threshold), F.lit(f"{head}{ISSUE_RESOLVED}")
        )
        .when(
            ~F.coalesce(applied, F.lit(False)),
            F.concat(failed, F.lit(NOT_APPLIED)),
        )
        .otherwise(F.array_join(parts, "\n"))
    )
