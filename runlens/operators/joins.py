"""Joins by id.

No side carries a broadcast hint: prompts, predictions and completed ids all
grow with the data. AQE turns a join into a broadcast one once it has seen
that a side is small, and splits partitions that turn out skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the error of a result without a prompt.
NO_PROMPT = "No prompt found for instance"


def join_samples_problems(samples: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    """Samples with their problem's columns; an unknown id fails the job."""
    known = problems.withColumn("_known", F.lit(True))
    joined = samples.join(known, key, "left")
    checked = F.when(F.col("_known"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("unknown problem id: "), F.col(key).cast("string")))
    )
    return joined.withColumn(key, checked.cast(samples.schema[key].dataType)).drop("_known")


def join_prompts(instances: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompt and error per instance; a missing or empty prompt is an error row."""
    texts = prompts.select("instance_id", F.col("text_inputs").alias("prompt"))
    joined = instances.join(texts, "instance_id", "left")
    missing = F.coalesce(F.length("prompt"), F.lit(0)) == 0
    return joined.withColumn("error", F.when(missing, F.lit(NO_PROMPT)))


def select_prompt(own_prompt: Column, mapped_prompt: Column | None = None) -> Column:
    """struct(prompt, error): the map's prompt when a map is given, else the row's own."""
    prompt = own_prompt if mapped_prompt is None else mapped_prompt
    return F.struct(
        prompt.alias("prompt"),
        F.when(prompt.isNull(), F.lit(NO_PROMPT)).alias("error"),
    )


def without(rows: DataFrame, done: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows whose id is not in `done`."""
    return rows.join(done.select(key), key, "left_anti")


def missing_prompts(instances: DataFrame, prompts: DataFrame) -> DataFrame:
    return without(instances, prompts).select("instance_id")


def resume_pending(
    instances: DataFrame, completed: DataFrame, retry_errors: bool = False
) -> DataFrame:
    """Instances still to run; error results count as completed unless retried."""
    done = completed.where(F.col("error").isNull()) if retry_errors else completed
    return without(instances, done)


def keep_listed(rows: DataFrame, ids: DataFrame, key: str = "instance_id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def split_overlap(left: DataFrame, right: DataFrame, key: str = "instance_id") -> DataFrame:
    """One row: number of ids in both lists and whether they are disjoint."""
    common = left.select(key).intersect(right.select(key))
    return common.agg(F.count(F.lit(1)).alias("common")).withColumn(
        "disjoint", F.col("common") == 0
    )


def test_status_grade(expected: DataFrame, statuses: DataFrame, applied: DataFrame) -> DataFrame:
    """Resolved flag per instance: every expected test must have passed.

    `expected` is (instance_id, kind, test) with kind FAIL_TO_PASS or
    PASS_TO_PASS, `statuses` (instance_id, test, status), `applied`
    (instance_id, patch_exists, patch_successfully_applied, error). A test
    without status has not passed; a grading error leaves an instance
    unresolved.
    """
    # Expected and seen tests meet in one aggregate; neither is joined to the other.
    no = F.lit(0)
    both = expected.select(
        "instance_id",
        "test",
        (F.col("kind") == "FAIL_TO_PASS").cast("bigint").alias("f2p"),
        (F.col("kind") == "PASS_TO_PASS").cast("bigint").alias("p2p"),
        F.lit(1).alias("wanted"),
        no.alias("passed"),
    ).unionByName(
        statuses.select(
            "instance_id", "test", no.alias("f2p"), no.alias("p2p"), no.alias("wanted"),
            F.coalesce((F.col("status") == "PASSED").cast("int"), no).alias("passed"),
        )
    )
    tests = both.groupBy("instance_id", "test").agg(
        F.sum("f2p").alias("f2p"), F.sum("p2p").alias("p2p"), F.max("wanted").alias("wanted"), F.max("passed").alias("passed")
    )
    graded = tests.where("wanted = 1").groupBy("instance_id").agg(
        (F.min("passed") == 1).alias("_all"),
        F.sum(F.col("f2p") * F.col("passed")).alias("f2p_passed"),
        F.sum("f2p").alias("f2p_total"),
        F.sum(F.col("p2p") * F.col("passed")).alias("p2p_passed"),
        F.sum("p2p").alias("p2p_total"),
    )
    usable = (
        F.col("error").isNull()
        & F.col("patch_exists")
        & F.col("patch_successfully_applied")
    )
    counts = ("f2p_passed", "f2p_total", "p2p_passed", "p2p_total")
    return applied.join(graded, "instance_id", "left").select(
        "instance_id",
        (usable & F.coalesce("_all", F.lit(True))).alias("resolved"),
        "patch_exists",
        (F.col("patch_successfully_applied") & F.col("error").isNull()).alias(
            "patch_successfully_applied"
        ),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in counts],
        "error",
    )


def expected_tests(instances: DataFrame) -> DataFrame:
    """(instance_id, kind, test) rows of the two expected-test lists."""

    def tagged(kind: str) -> Column:
        tests = F.coalesce(F.col(kind), F.array().cast("array<string>"))
        return F.transform(
            tests, lambda test: F.struct(F.lit(kind).alias("kind"), test.alias("test"))
        )

    both = F.concat(tagged("FAIL_TO_PASS"), tagged("PASS_TO_PASS"))
    return instances.select("instance_id", F.explode(both).alias("t")).select(
        "instance_id", "t.kind", "t.test"
    )
