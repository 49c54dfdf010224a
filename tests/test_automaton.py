import random

import pytest
from pyspark.sql import functions as F
from runlens.functions.text import word_count
from runlens.operators import automaton, sessions


def plain_scan(rows, start, states):
    out, state, total = [], start, 0
    for position, step, amount, name in sorted(rows):
        after = step[state]
        out.append((position, name, state, after, total))
        state, total = after, total + amount
    return out


@pytest.mark.parametrize("chunk", [2, 3, 7, 1024])
def test_scan_against_a_plain_loop(spark, chunk):
    rng = random.Random(chunk)
    groups = {key: [] for key in ("hot", "short", None, "gap")}
    for key, n in (("hot", 150), ("short", 1), (None, 9), ("gap", 12)):
        places = rng.sample(range(n * 3), n) if key == "gap" else range(n)
        groups[key] = [(p, [rng.randrange(4) for _ in range(4)], rng.randrange(9), f"n{p}") for p in places]
    data = [(key, *row) for key, rows in groups.items() for row in rows]
    df = spark.createDataFrame(data, "g string, p long, f array<int>, a int, name string").repartition(5)
    got = automaton.scan(df, ["g"], "p", F.col("f"), 4, start=2, amounts={"sum": F.col("a")}, columns=["name"], chunk=chunk)
    assert got.columns == ["g", "p", "name", "before", "after", "sum"]
    found = {}
    for r in got.orderBy("p").collect():
        found.setdefault(r["g"], []).append((r["p"], r["name"], r["before"], r["after"], r["sum"]))
    assert found == {key: plain_scan(rows, 2, 4) for key, rows in groups.items()}


def test_empty_table_and_bad_chunk(spark):
    df = spark.createDataFrame([], "g string, p long, f array<int>")
    assert automaton.scan(df, ["g"], "p", F.col("f"), 3).collect() == []
    with pytest.raises(ValueError):
        automaton.scan(df, ["g"], "p", F.col("f"), 3, chunk=1)


def plain_episode(steps, max_len, max_steps, timeout, max_errors, initial, nudge):
    used, streak = initial, 0
    for i, (action, stdout, failed, elapsed) in enumerate(steps):
        said = len(action.split())
        blank = action.startswith("<bash> </bash>")
        submits = "<submit/>" in action and not blank
        answer = nudge if blank else len(f"<returncode>0</returncode>\n<output>\n{stdout}\n</output>".split())
        if timeout is not None and elapsed >= timeout:
            return i, used, "timeout", elapsed
        if used >= max_len:
            return i, used, "token_limit", elapsed
        if failed:
            return i, used, "error", elapsed
        if submits:
            return i + 1, used + said, "submit", elapsed
        streak = streak + 1 if blank else 0
        if streak > max_errors:
            return i + 1, used + said, "format_error", elapsed
        done = "COMPLETE_TASK" in stdout and not blank
        if done or i == max_steps - 1:
            return i + 1, used + said + (0 if done else answer), "submit" if done else "max_steps", elapsed
        used += said + answer
    return len(steps), used, "max_steps", steps[-1][3]


@pytest.mark.parametrize("chunk", [2, 5, 1024])
def test_episodes_against_a_plain_loop(spark, chunk):
    rng = random.Random(11)
    limits = {"max_len": 190, "max_steps": 25, "timeout": 45.0, "max_errors": 2}
    data, want = [], {}
    for episode in range(120):
        steps = []
        loud = 30 if rng.random() < 0.3 else 0
        for i in range(rng.randint(1, 30)):
            action = rng.choice(["<bash> </bash>", "<bash> </bash> x", "<bash> ls -l </bash>", "<bash> a b c d </bash>"])
            if rng.random() < 0.02:
                action = "done <submit/>"
            stdout = "out " * (rng.randint(0, 5) + loud)
            steps.append((action, stdout, rng.random() < 0.01, i * rng.choice([1.0, 2.0, 4.0])))
        steps = [(a, o, f, max(s[3] for s in steps[: i + 1])) for i, (a, o, f, _) in enumerate(steps)]
        data += [(str(episode), i, a, o, 0, f, e) for i, (a, o, f, e) in enumerate(steps)]
        want[str(episode)] = plain_episode(steps, 190, 25, 45.0, 2, 5, 3)
    schema = "session_id string, step long, action string, stdout string, returncode long, failed boolean, elapsed double"
    df = spark.createDataFrame(data, schema)
    options = {**limits, "initial_tokens": 5, "nudge_tokens": 3}
    old = {tuple(r) for r in sessions.episode_result(df, word_count, **options).collect()}
    new = {tuple(r) for r in sessions.episode_scan(df, word_count, **options, chunk=chunk).collect()}
    assert new == old, sorted(new ^ old)[:6]
    assert {r[3] for r in new} == {"timeout", "token_limit", "error", "submit", "format_error", "max_steps"}
    found = {r[0]: (r[1], r[2], r[3], r[4]) for r in new}
    assert found == want
