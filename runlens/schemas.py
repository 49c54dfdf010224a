"""Explicit schemas of the stored entities; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

RUN = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("resolved", T.BooleanType()),
        T.StructField("steps", T.IntegerType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("wall_clock_seconds", T.DoubleType()),
    ]
)

INSTANCE_RESULT = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("resolve_rate", T.DoubleType()),
        T.StructField("avg_steps", T.DoubleType()),
        T.StructField("avg_tokens", T.DoubleType()),
    ]
)

# One finished run per line: the long form of INSTANCE_RESULT.
RUN_LINE = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        *RUN.fields,
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("model_patch", T.StringType()),
        T.StructField("model_name_or_path", T.StringType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("full_output", T.StringType()),
        T.StructField("model_name_or_path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

PROMPT_LINE = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("text_inputs", T.StringType()),
    ]
)

TRAINING_LINE = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

TASK_LABEL = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("base_commit", T.StringType()),
        T.StructField("problem_statement", T.StringType()),
        T.StructField("test_patch", T.StringType()),
        T.StructField("FAIL_TO_PASS", T.ArrayType(T.StringType())),
        T.StructField("PASS_TO_PASS", T.ArrayType(T.StringType())),
    ]
)

KEYED_PREDICTIONS = T.MapType(T.StringType(), PREDICTION)

VERIFIER_STATUSES = ("ok", "error", "timeout", "skipped")
EPISODE_REASONS = ("submit", "max_steps", "token_limit", "timeout", "format_error", "error")
