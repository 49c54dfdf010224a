"""DataFrame operators against brute force on small, uneven fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runlens.operators import images, joins, reports, sampling, scoring, sessions, sets, signals
from runlens.operators.quantiles import approx_distribution, distribution_stats, from_ordered_bits, ordered_bits
from runlens.operators.running import running
from runlens.operators import skew
from runlens.operators.skew import join_summary


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- running values ------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 3, 7, 4096])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_brute_force(spark, chunk, inclusive):
    rng = random.Random(chunk)
    data = [
        (key, position, rng.choice([None, *range(-3, 9)]))
        for key, size in (("hot", 60), ("a", 5), ("b", 1))
        for position in sorted(rng.sample(range(100), size))
    ]
    df = spark.createDataFrame(data, "k string, pos int, v int")
    values = {name: (name, F.col("v")) for name in ("sum", "count", "max", "first", "last")}
    got = rows_of(running(df, ["k"], "pos", values, inclusive=inclusive, chunk=chunk), "k", "pos")
    want = []
    for key, position, value in sorted(data):
        seen = [v for k, p, v in data if k == key and (p < position or (inclusive and p == position))]
        seen = [v for v in seen if v is not None]
        want.append(
            (key, position, value, sum(seen), len(seen), max(seen, default=None),
             seen[0] if seen else None, seen[-1] if seen else None)
        )
    assert got == want


def test_running_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("pos"))
    got = running(df, [], "pos", {"n": ("count", F.lit(1))}, chunk=50).orderBy("pos").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_running_rejects_unknown_kinds(spark):
    with pytest.raises(ValueError):
        running(spark.range(1), [], "id", {"x": ("mode", F.lit(1))})


# --- quantiles -----------------------------------------------------------


def test_distribution_equals_numpy_on_uneven_groups(spark):
    rng = random.Random(3)
    groups = {
        "hot": [rng.gauss(0, 1e4) for _ in range(4000)],
        "equal": [7.25] * 500,
        "two": [1.0, 2.0],
        "one": [-3.5],
        "close": [1000 + i * 1e-7 for i in range(300)],
        "signs": [-2.0, -1e-9, 0.0, 1e-9, 5e8],
    }
    data = [(g, v) for g, values in groups.items() for v in values] + [("hot", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    for row in distribution_stats(df, ["g"], "v").collect():
        values = np.array(groups[row.g])
        assert row.n == len(values)
        assert row.mean == pytest.approx(values.mean(), rel=1e-9, abs=1e-9)
        assert row.std == pytest.approx(values.std(), rel=1e-6, abs=1e-7)
        assert (row["min"], row["max"]) == (values.min(), values.max())
        for p, name in ((10, "p10"), (25, "p25"), (50, "median"), (75, "p75"), (90, "p90")):
            assert row[name] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-12)


def test_a_group_without_values_has_n_0(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "g string, v double")
    got = {r.g: (r.n, r["mean"], r["median"]) for r in distribution_stats(df, ["g"], "v").collect()}
    assert got == {"a": (0, None, None), "b": (1, 1.5, 1.5)}
    assert distribution_stats(df.limit(0), ["g"], "v").count() == 0


def test_concentrated_values(spark):
    """A day of epoch seconds, and many tiny scores: few distinct prefixes, many values below them."""
    day = spark.range(1_000_000).select(F.lit("day").alias("g"), (F.lit(1.7e9) + F.col("id") % 86_400).alias("v"))
    tiny = spark.range(100_000).select(F.lit("tiny").alias("g"), (F.col("id") * 2e-9).alias("v"))
    got = {r.g: r for r in distribution_stats(day.union(tiny), ["g"], "v", small_groups=True).collect()}
    seconds = np.sort(1.7e9 + np.arange(1_000_000) % 86_400)
    scores = np.arange(100_000) * 2e-9
    for name, values in (("day", seconds), ("tiny", scores)):
        assert got[name].n == len(values) and got[name]["std"] == pytest.approx(values.std(), rel=1e-9)
        for p, column in ((10, "p10"), (25, "p25"), (50, "median"), (75, "p75"), (90, "p90")):
            assert got[name][column] == pytest.approx(np.percentile(values, p), rel=1e-12)


def test_ordered_bits_keep_the_order_and_come_back(spark):
    rng = random.Random(7)
    edges = [2.0**e * (1 + d) for e in (-1022, -1021, -60, -1, 0, 1, 52, 53, 1022) for d in (-2.0**-53, 0.0, 2.0**-52)]
    drawn = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-320, 300) for _ in range(3000)]
    values = sorted({0.0, -1e-300, 1e-300, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), *edges, *drawn, *(s * 10**e for s in (-1.5, 1.0, 2.5) for e in range(-9, 12))})
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    code = ordered_bits(F.col("v"))
    rows = df.select("i", "v", code.alias("b"), from_ordered_bits(code).alias("back")).orderBy("i").collect()
    assert [r.b for r in rows] == sorted({r.b for r in rows}) and all(r.v == r.back for r in rows)


def test_approximate_distribution_is_close(spark):
    df = spark.range(10001).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    row = approx_distribution(df, ["g"], "v").first()
    assert row.n == 10001 and abs(row.median - 5000) <= 10


# --- skew ----------------------------------------------------------------


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_join_summary_keeps_every_row(spark, share):
    data = [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(200)] + [(None, 1)]
    rows = spark.createDataFrame(data, "k string, i int")
    summary = rows.where("k is not null").groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("i").alias("s")
    )
    got = join_summary(rows, summary, "k", "n", heavy_share=share).collect()
    totals = {}
    for key, i in data:
        totals[key] = totals.get(key, 0) + i
    assert len(got) == len(data)
    for row in got:
        assert row.s == (None if row.k is None else totals[row.k])


def test_rows_of_a_heavy_key_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(skew, "SLOT_ROWS", 20)
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    summary = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    changed = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name) for name in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        joined = join_summary(rows, summary, "k", "n").withColumn("part", F.spark_partition_id())
        spread = [r["count"] for r in joined.where("k = -1 and n = 1334").groupBy("part").count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(spread) == 1334 and len(spread) > 8 and max(spread) < 400


# --- scores --------------------------------------------------------------

VERDICT = "session_id string, name string, status string, score double, pass_threshold double"


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        ("s1", "a", "ok", 1.0, 1.0), ("s1", "b", "ok", 0.5, 1.0), ("s1", "c", "skipped", 1.0, 1.0),
        ("s2", "a", "skipped", 1.0, 1.0), ("s3", "z", "ok", 0.25, 0.25),
    ]
    verdicts = spark.createDataFrame(rows, VERDICT)
    return spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "session_id string"), verdicts


@pytest.mark.parametrize(
    "aggregator, weights, want",
    [
        ("mean", None, [0.5, 0.0, 0.25, 1.0]),
        ("min", None, [0.0, 0.0, 0.25, 1.0]),
        ("weighted_sum", None, [0.5, 0.0, 0.25, 1.0]),
        ("weighted_sum", {"a": 3.0, "c": 0.0, "z": 0.0}, [0.875, 0.0, 1.0, 1.0]),
    ],
)
def test_session_scores(scored, aggregator, weights, want):
    got = scoring.session_scores(*scored, aggregator, weights)
    assert [r.aggregate_score for r in got.orderBy("session_id").collect()] == want


def test_all_passed_and_weights(spark, scored):
    sess, verdicts = scored
    assert [r.all_passed for r in scoring.all_passed(sess, verdicts).orderBy("session_id").collect()] == [
        False, False, True, True,
    ]
    weights = spark.createDataFrame([("a", 0.5), ("q", 2.0)], "name string, weight double")
    joined = scoring.join_weights(verdicts, weights).orderBy("session_id", "name").collect()
    assert [r.weight for r in joined] == [0.5, 1.0, 1.0, 0.5, 1.0]
    bad = spark.createDataFrame([("a", -0.5)], "name string, weight double")
    with pytest.raises(PySparkException, match="a weight below 0"):
        scoring.join_weights(verdicts, bad).collect()


def test_schedule_defaults_to_the_unit_tests(spark):
    rows = [("s", n, "ok", 1.0, 1.0) for n in ("ast_check", "swe_test")]
    df = spark.createDataFrame(rows, VERDICT)
    got = scoring.scheduled_verdicts(df, intermediate=["ast_check"])
    assert rows_of(got.select("name", "phase"), "name") == [("ast_check", "intermediate"), ("swe_test", "final")]


def test_latest_verdicts(spark):
    rows = [("s", "a", 1, "error"), ("s", "a", 2, "ok"), ("s", "x", 9, "ok"), ("s", "b", 0, "ok")]
    df = spark.createDataFrame(rows, "session_id string, name string, seq int, status string")
    got = scoring.latest_verdicts(df, ["b", "a"], "seq")
    assert rows_of(got, "set_order") == [("s", "b", 0, "ok"), ("s", "a", 1, "ok")]


def test_group_norm(spark):
    rows = [("p", float(i % 2)) for i in range(4)] + [("q", 1.0), ("q", 1.0), ("r", 0.0)]
    df = spark.createDataFrame(rows, "prompt string, reward double")
    got = {(r.prompt, r.reward): r.advantage for r in scoring.group_norm_reward(df, "prompt", eps=0.0).collect()}
    assert got == {("p", 0.0): -1.0, ("p", 1.0): 1.0, ("q", 1.0): 0.0, ("r", 0.0): 0.0}
    sample = scoring.group_norm_reward(df.where("prompt = 'p'"), "prompt", eps=0.0, ddof=1)
    assert max(r.advantage for r in sample.collect()) == pytest.approx(0.5 / math.sqrt(1 / 3))


def test_turn_feedback(spark):
    rows = [
        ("s", 0, "b", "ok", 0.5, 1.0), ("s", 0, "a", "timeout", 0.0, 1.0),
        ("s", 1, "a", "ok", 1.0, 1.0), ("s", 2, "a", "ok", 0.0, 1.0), ("s", 3, "b", "ok", 0.0, 1.0),
    ]
    df = spark.createDataFrame(
        rows, "session_id string, turn int, name string, status string, score double, pass_threshold double"
    )
    got = {r.turn: r.feedback for r in scoring.turn_feedback(df, ["a", "b"], max_turns=3).collect()}
    head, foot = "Your solution was evaluated. Here is the feedback:\n\n", "\n\nPlease revise your solution to address the issues above."
    assert got[0] == head + "[a] TIMEOUT\n[b] FAILED (score: 0.50)" + foot
    assert got[1] == "" and got[2] == ""
    assert got[3] == head + "[b] FAILED (score: 0.00)" + foot
    own = df.withColumn("told", F.when(F.col("name") == "b", "see above"))
    told = {r.turn: r.feedback for r in scoring.turn_feedback(own, ["a", "b"], 3, lines="told").collect()}
    assert told[0] == head + "[a] TIMEOUT\nsee above" + foot


# --- runs and reports ----------------------------------------------------

RUNS = ("instance_id string, repo string, run_id long, resolved boolean, steps int, total_tokens long, "
        "wall_clock_seconds double, reason string")


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("a", "r1", 1, True, 2, 10, 1.0, "submit"), ("a", "r1", 2, False, 4, 30, 2.0, "error"),
        ("b", "r1", 3, False, 1, 5, 3.0, None), ("b", "r1", 4, False, 3, 5, 4.0, "timeout"),
        ("c", None, 5, True, 5, 50, 5.0, "submit"),
    ]
    return spark.createDataFrame(rows, RUNS)


def test_rollup_signal_and_summary(spark, runs):
    every = spark.createDataFrame(
        [("a", "r1"), ("b", "r1"), ("c", None), ("d", "r2")], "instance_id string, repo string"
    )
    rollup = signals.instance_rollup(runs, every)
    assert rows_of(rollup, "instance_id") == [
        ("a", "r1", 2, 1, 0.5, 3.0, 20.0), ("b", "r1", 2, 0, 0.0, 2.0, 5.0),
        ("c", "unknown", 1, 1, 1.0, 5.0, 50.0), ("d", "r2", 0, 0, 0.0, 0.0, 0.0),
    ]
    signal = signals.group_signal(rollup).first()
    assert (signal.k, signal.always_fail, signal.always_pass, signal.mixed) == (2, 2, 1, 1)
    assert signal.always_fail_share + signal.always_pass_share + signal.mixed_share == 1.0
    assert signal.applicable
    assert [r.outcome for r in signals.mixed_histogram(rollup).collect()] == ["1/2"]
    summary = signals.eval_summary(rollup).first()
    assert (summary.instances, summary.resolved_any, summary.avg_resolve_rate) == (4, 2, 0.375)
    assert summary.run_resolve_rate == 0.4


def test_signal_needs_several_runs(spark, runs):
    single = signals.instance_rollup(runs.where("instance_id = 'c'"))
    assert not signals.group_signal(single).first().applicable
    nothing = signals.group_signal(signals.instance_rollup(runs.limit(0))).first()
    assert not nothing.applicable and nothing.mixed_share is None


def test_nested_runs_come_in_bounded_parts(spark):
    rows = [("hot", "r", i, i % 2 == 0, i, 1, 0.5, None, i) for i in range(25)] + [("a", "r", 0, True, 1, 1, 0.5, None, 0)]
    df = spark.createDataFrame(rows, RUNS + ", run_idx long")
    nested = signals.nest_runs(df, per_record=10)
    got = {(r.instance_id, r.part): [x.run_idx for x in r.runs] for r in nested.collect()}
    assert got == {
        ("hot", 0): list(range(10)), ("hot", 1): list(range(10, 20)), ("hot", 2): list(range(20, 25)), ("a", 0): [0],
    }
    assert signals.explode_runs(nested).count() == 26


def test_outcomes_and_tables(runs):
    got = [(r.reason, r.runs, r.share) for r in reports.outcome_histogram(runs).collect()]
    assert got == [("submit", 2, 0.4), ("error", 1, 0.2), ("timeout", 1, 0.2), ("unknown", 1, 0.2)]
    ids = runs.groupBy("instance_id").agg(F.min("repo").alias("repo"))
    spark = runs.sparkSession
    stored = ids.union(spark.createDataFrame([("z1", "r1"), ("z2", "never run")], "instance_id string, repo string"))
    table = [
        (r.scope, r.repo, r.instances, r.runs, r.resolved_runs) for r in reports.per_repo_table(runs, stored).collect()
    ]
    assert table == [("overall", "", 5, 5, 2), ("repo", "r1", 3, 4, 1), ("repo", "unknown", 1, 1, 1)]
    overall = reports.overall_stats(runs, stored).first()
    assert (overall.instances, overall.total_runs, overall.runs_per_instance, overall.resolved_runs) == (5, 5, 1, 2)
    assert overall.any_rate == pytest.approx(reports.overall_stats(runs, ids).first().any_rate * 3 / 5)
    empty = reports.overall_stats(runs.limit(0), stored.limit(0)).first()
    assert empty.total_runs == 0 and empty.run_rate is None


def test_cohorts(runs):
    stats = reports.cohort_stats(runs, signals.instance_rollup(runs))
    got = {(r.cohort, r.metric): (r.n, r.mean) for r in stats.collect()}
    assert got[("non_error", "steps")] == (4, pytest.approx(11 / 4))
    assert got[("resolved", "total_tokens")] == (2, pytest.approx(30.0))
    assert got[("unresolved", "wall_clock_seconds")] == (2, pytest.approx(3.5))
    assert got[("mixed", "steps")] == (2, pytest.approx(3.0))


def test_grade_and_run_reports(spark):
    rows = [("a", True, True, None), ("b", True, False, None), ("c", True, True, ""), ("d", False, True, None),
            ("e", None, True, "x")]
    df = spark.createDataFrame(rows, "instance_id string, resolved boolean, patch_exists boolean, error string")
    report = reports.grade_report(df).first()
    assert tuple(report) == (5, 1, 4, 2, 1, 0.2)
    assert report.passed + report.failed == report.total
    lists = rows_of(reports.grade_id_lists(df), "list", "instance_id")
    assert lists == [("error", "c"), ("error", "e"), ("failed", "b"), ("failed", "c"), ("failed", "d"),
                     ("failed", "e"), ("passed", "a")]
    run = reports.run_report(df, total=10).first()
    assert (run.evaluated, run.completion_rate, run.resolved_instances, run.error_instances) == (4, 0.4, 3, 1)
    assert run.resolve_rate == 0.75
    none = reports.run_report(df.limit(0)).first()
    assert (none.resolve_rate, none.completion_rate) == (0.0, 0.0)
    assert reports.grade_report(df.limit(0)).first().pass_rate == 0.0


def test_multi_turn_summary(spark):
    rows = [(2, True, None), (None, False, None), (9, True, "x"), (1, None, "")]
    df = spark.createDataFrame(rows, "num_turns int, stopped_early boolean, error string")
    got = reports.multi_turn_summary(df).first()
    assert (got.avg_turns, got.early_exits, got.counted) == (pytest.approx(4 / 3), 2, 3)


def test_episode_features(spark):
    steps = spark.createDataFrame(
        [("s", 0, "abc"), ("s", 1, "de"), ("t", 0, "x")], "session_id string, exit_code int, stdout string"
    )
    patches = spark.createDataFrame(
        [("s", "diff --git a/x b/x\n+y\n", True), ("t", "", False), ("u", None, False)],
        "session_id string, patch string, resolved boolean",
    )
    assert rows_of(reports.episode_features(steps, patches), "session_id") == [
        ("s", 1.0, 2, 2, 1, 0.0, 0.0, 1, 5), ("t", 0.0, 1, 0, 0, 1.0, 1.0, 0, 1), ("u", 0.0, 0, 0, 0, 1.0, 1.0, 0, 0),
    ]


# --- sessions ------------------------------------------------------------


def test_session_replay(spark):
    rows = [("a", 0, "a0", False), ("a", 1, "a1", True), ("a", 2, "a2", True), ("b", 0, "b0", False),
            ("b", 1, "b1", False), ("c", 0, "c0", True)]
    df = spark.createDataFrame(rows, "session_id string, turn int, output string, all_passed boolean")
    assert rows_of(sessions.session_replay(df), "session_id") == [
        ("a", "a1", 2, True), ("b", "b1", 2, False), ("c", "c0", 1, True),
    ]
    assert rows_of(sessions.session_replay(df, has_verifiers=False), "session_id")[0] == ("a", "a2", 3, False)
    assert [(r[0], r[1]) for r in rows_of(sessions.kept_turns(df), "session_id", "turn")] == [
        ("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0),
    ]


def messages(spark, rows):
    return spark.createDataFrame(rows, "session_id string, turn int, role string, text string")


def test_token_budget_is_tested_before_the_step(spark):
    df = messages(spark, [("a", 0, "user", "one two"), ("a", 1, "assistant", "x " * 5), ("a", 2, "user", "y"),
                          ("a", 3, "assistant", "z"), ("a", 4, "assistant", "z")])
    from runlens.functions.text import word_count

    got = sessions.token_budget(df, word_count(F.col("text")), 8, F.col("role") == "assistant", call_cap=4)
    assert [r[4:] for r in rows_of(got, "turn")] == [(2, 6, True, 4), (8, 0, False, 0), (9, -1, False, 0)]


def test_format_error_streak(spark):
    empty = [1, 1, 0, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([("a", i, e) for i, e in enumerate(empty)], "session_id string, turn int, e int")
    got = sessions.format_error_streak(df, F.col("e") == 1)
    assert [r.streak for r in got.orderBy("turn").collect()] == [1, 2, 0, 1, 2, 3, 4, 5]
    assert rows_of(sessions.streak_end(got), "session_id") == [("a", 6)]


def test_context_blocks(spark):
    df = messages(spark, [
        ("s", 0, "system", "S"), ("s", 1, "assistant", "ignored"), ("s", 2, "user", "not feedback"),
        ("s", 3, "assistant", "A1"), ("s", 4, "user", "F1"), ("s", 5, "user", "skipped"), ("s", 6, "assistant", "A2"),
        ("u", 0, "user", "U"), ("u", 1, "assistant", "B1"), ("u", 2, "user", "G1"), ("u", 3, "assistant", "B2"),
        ("u", 4, "assistant", "B3"),
    ])
    got = [(r[0], r[3]) for r in rows_of(sessions.context_blocks(df), "session_id", "turn")]
    assert got == [
        ("s", "### Attempt 1\nA1"), ("s", "### Feedback on Attempt 1\nF1"), ("s", "### Attempt 2\nA2"),
        ("u", "### Attempt 1\nB1"), ("u", "### Feedback on Attempt 1\nG1"), ("u", "### Attempt 2\nB2"),
        ("u", "### Attempt 3\nB3"),
    ]
    whole = rows_of(sessions.prior_context(df, attempts_per_part=100), "session_id")
    assert whole[1] == ("u", 0, "\n\n".join(b for s, b in got if s == "u"))
    parts = rows_of(sessions.prior_context(df, attempts_per_part=1), "session_id", "part")
    assert "\n\n".join(p[2] for p in parts if p[0] == "u") == whole[1][2]


def test_attempt_index_and_step_flags(spark):
    df = messages(spark, [("s", 0, "system", ""), ("s", 1, "user", ""), ("s", 2, "assistant", ""), ("s", 3, "user", ""),
                          ("s", 4, "assistant", ""), ("u", 0, "user", ""), ("u", 1, "assistant", "")])
    got = [(r[0], r[4]) for r in rows_of(sessions.attempt_index(df), "session_id", "turn")]
    assert got == [("s", 0), ("s", 1), ("u", 0)]
    flags = sessions.step_count_flags(df.select("session_id", "turn"), max_steps=4)
    assert [r[2:] for r in rows_of(flags.where("session_id = 's'"), "turn")] == [
        (1, False), (2, False), (3, False), (4, True), (5, True),
    ]


def test_retry_latest(spark):
    rows = [("a", 0, False, "x"), ("a", 1, True, None), ("a", 2, True, None), ("b", 0, False, "x"),
            ("b", 1, False, "y"), ("b", 2, False, "z"), ("b", 3, True, None), ("c", 0, True, None)]
    df = spark.createDataFrame(rows, "id string, attempt int, ok boolean, error string")
    assert rows_of(sessions.retry_latest(df, ["id"]), "id") == [
        ("a", True, 2, None, None), ("b", False, 3, "Rollout failed after 3 attempts", "z"), ("c", True, 1, None, None),
    ]


def test_episode_reason(spark):
    rows = [("a", 0, None), ("a", 2, "timeout"), ("a", 1, "submit"), ("b", 0, None), ("b", 1, None), ("c", 0, "error")]
    df = spark.createDataFrame(rows, "session_id string, step int, reason string")
    assert rows_of(sessions.episode_reason(df), "session_id") == [
        ("a", "submit", 1), ("b", "max_steps", 1), ("c", "error", 0),
    ]
    flags = spark.createDataFrame(
        [(0, *[bool(mask >> i & 1) for i in range(7)]) for mask in (0, 127, 126, 124, 120, 112, 96, 64)],
        "i int, a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g boolean",
    )
    reason = sessions.step_reason(*[F.col(c) for c in "abcdefg"])
    assert [r[0] for r in flags.select(reason).collect()] == [
        None, "error", "timeout", "token_limit", "submit", "format_error", "submit", "max_steps",
    ]


# --- sampling, joins, sets, images ---------------------------------------


def test_seeded_sample_ignores_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("instance_id"))
    first = [r[0] for r in sampling.seeded_sample(df.repartition(1), 20).collect()]
    again = [r[0] for r in sampling.seeded_sample(df.repartition(13), 20).collect()]
    assert first == again and len(set(first)) == 20
    assert sampling.seeded_sample(df, 9999).count() == 500
    assert [r[0] for r in sampling.seeded_sample(df, 20, seed=1).collect()] != first


def test_limit_and_locality(spark):
    rows = [("b", "2", 0), ("a", "9", 1), (None, "1", 2), ("a", "10", 3)]
    df = spark.createDataFrame(rows, "repo string, instance_id string, seq int")
    assert [r.seq for r in sampling.instance_limit(df, 2).collect()] == [0, 1]
    assert sampling.instance_limit(df, 0).count() == 4
    assert [r.seq for r in sampling.repo_locality_sort(df).collect()] == [2, 3, 1, 0]


def test_round_robin(spark):
    df = spark.range(10).select((F.col("id") * 70_000).alias("seq"))
    got = [r.shard for r in sampling.round_robin_shards(df, 4).orderBy("seq").collect()]
    assert got == [i % 4 for i in range(10)]
    assert {r.shard for r in sampling.round_robin_shards(df.limit(2), 4).collect()} == {0, 1}


def test_top_failures(spark):
    rows = [("hot", f"t{i:03d}", "FAILED", i) for i in range(50)] + [("a", "x", "ERROR", 0), ("b", "y", "PASSED", 0)]
    df = spark.createDataFrame(rows, "instance_id string, test string, status string, seq int")
    got = {r.instance_id: r for r in sampling.top_failures(df).collect()}
    assert set(got) == {"hot", "a"}
    assert got["a"].feedback == "  Failing tests (1):\n    - x"
    assert got["hot"].failing == 50 and got["hot"].feedback.endswith("- t019\n    ... and 30 more")


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "instance_id string, v int")
    prompts = spark.createDataFrame([("a", "p"), ("b", "")], "instance_id string, text_inputs string")
    got = rows_of(joins.join_prompts(left, prompts), "instance_id")
    assert [(r[0], r[2], r[3]) for r in got] == [
        ("a", "p", None), ("b", "", joins.NO_PROMPT), ("c", None, joins.NO_PROMPT),
    ]
    assert rows_of(joins.missing_prompts(left, prompts), "instance_id") == [("c",)]
    done = spark.createDataFrame([("a", None), ("b", "x")], "instance_id string, error string")
    assert [r[0] for r in rows_of(joins.resume_pending(left, done), "instance_id")] == ["c"]
    assert [r[0] for r in rows_of(joins.resume_pending(left, done, retry_errors=True), "instance_id")] == ["b", "c"]
    assert [r[0] for r in rows_of(joins.keep_listed(left, done.union(done)), "instance_id")] == ["a", "b"]
    assert tuple(joins.split_overlap(left, done).first()) == (2, False)
    assert tuple(joins.split_overlap(left, done.limit(0)).first()) == (0, True)
    assert rows_of(sets.completed_diff(left, done), "instance_id") == [("c",)]


def test_unknown_problem_fails(spark):
    samples = spark.createDataFrame([("a",), ("x",)], "task_id string")
    problems = spark.createDataFrame([("a", "t")], "task_id string, test string")
    assert joins.join_samples_problems(samples.where("task_id = 'a'"), problems, "task_id").count() == 1
    with pytest.raises(PySparkException, match="unknown problem id: x"):
        joins.join_samples_problems(samples, problems, "task_id").collect()


def test_status_grade(spark):
    instances = spark.createDataFrame(
        [("a", ["t1"], ["t2"]), ("b", ["t1"], None), ("c", [], []), ("d", ["t1"], []), ("e", ["t1"], [])],
        "instance_id string, FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>",
    )
    statuses = spark.createDataFrame(
        [("a", "t1", "PASSED"), ("a", "t2", "PASSED"), ("b", "t1", "FAILED"), ("d", "t1", "PASSED"),
         ("e", "t1", "PASSED")],
        "instance_id string, test string, status string",
    )
    applied = spark.createDataFrame(
        [("a", True, True, None), ("b", True, True, None), ("c", True, True, None), ("d", True, False, None),
         ("e", True, True, "bad log")],
        "instance_id string, patch_exists boolean, patch_successfully_applied boolean, error string",
    )
    got = rows_of(joins.test_status_grade(joins.expected_tests(instances), statuses, applied), "instance_id")
    assert [(r[0], r[1]) for r in got] == [("a", True), ("b", False), ("c", True), ("d", False), ("e", False)]
    assert got[0][4:8] == (1, 1, 1, 1) and got[4][3] is False


def test_union_drops_failed_batches(spark):
    a = spark.createDataFrame([("a", 1)], "instance_id string, x int")
    b = spark.createDataFrame([("b", "e")], "instance_id string, error string")
    assert rows_of(sets.union_batches([a, None, b]), "instance_id") == [("a", 1, None), ("b", None, "e")]
    with pytest.raises(ValueError):
        sets.union_batches([None])


def test_images(spark):
    rows = [("1", "n/x:latest"), ("2", "n/x:latest"), ("3", "n/y:v2"), ("4", None), ("5", ""), ("6", "bare:latest")]
    df = spark.createDataFrame(rows, "instance_id string, image string")
    assert [r[0] for r in images.unique_images(df.where("image <> ''")).collect()] == ["bare:latest", "n/x:latest", "n/y:v2"]
    assert rows_of(images.failed_images(df), "instance_id") == [("4",)]
    present = spark.createDataFrame([("x:v1",)], "target string")
    plan = images.mirror_plan(df, present)
    assert {(r.image, r.target): r.status for r in plan.collect()} == {
        ("n/x:latest", "x:v1"): "skipped", ("n/y:v2", "y:v2"): "bad_tag", ("bare:latest", "bare:v1"): "to_copy",
    }
    assert sum(r.images for r in images.mirror_counts(plan).collect()) == 4
