"""Replay of ordered multi-turn sessions and agent episodes.

`turn` (or `step`) is the 0-based place of a row inside its session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.actions import format_observation, parse_tool_call, submission_sentinel
from runlens.functions.text import py_strip
from runlens.operators import automaton
from runlens.operators.running import running
from runlens.schemas import EPISODE_REASONS

# The parts of a failed rollout's message.
ROLLOUT_FAILED = "Rollout failed after ", " attempts"


def session_replay(turns: DataFrame, has_verifiers: bool = True) -> DataFrame:
    """What a session that stops at its first passing turn keeps.

    Turns are (session_id, turn, output, all_passed), numbered 0, 1, 2, ...,
    so the stop turn gives the number of kept turns and one partial aggregate
    does all the work. The final output is that of the last kept turn, not of
    the best one. Without verifiers nothing stops early.
    """
    passing = F.col("all_passed") if has_verifiers else F.lit(False)
    at = F.when(passing, F.col("turn"))
    # Passing turns come first in ascending order, the others last in
    # descending order, so that one text per session is carried.
    preference = F.coalesce(at, F.lit(2**62) - F.col("turn"))
    return (
        turns.groupBy("session_id")
        .agg(
            F.min(at).alias("_stop"),
            F.max("turn").alias("_last"),
            F.min_by("output", preference).alias("final_output"),
        )
        .select(
            "session_id",
            "final_output",
            (F.coalesce("_stop", "_last") + 1).alias("num_turns"),
            F.col("_stop").isNotNull().alias("stopped_early"),
        )
    )


def kept_turns(turns: DataFrame) -> DataFrame:
    """The turns up to the first passing one of each session."""
    seen = running(
        turns,
        ["session_id"],
        "turn",
        {"_passed_before": ("max", F.col("all_passed"))},
        inclusive=False,
    )
    return seen.where(~F.coalesce("_passed_before", F.lit(False))).drop("_passed_before")


def token_budget(
    messages: DataFrame,
    tokens: Column,
    max_len: int,
    is_step: Column,
    call_cap: int = 4096,
    initial_tokens: int = 0,
) -> DataFrame:
    """Budget before each model call: the test comes before the call's own tokens.

    Adds used_tokens, remaining, allowed and call_limit to the rows for which
    `is_step` holds; every message counts towards the budget.
    """
    counted = messages.withColumn("_tokens", tokens.cast("bigint"))
    used = running(
        counted, ["session_id"], "turn", {"_used": ("sum", F.col("_tokens"))}, inclusive=False
    )
    spent = F.col("_used") + initial_tokens
    left = F.lit(max_len) - spent
    return used.where(is_step).select(
        *messages.columns,
        spent.alias("used_tokens"),
        left.alias("remaining"),
        (left > 0).alias("allowed"),
        F.greatest(F.least(F.lit(call_cap), left), F.lit(0)).cast("bigint").alias("call_limit"),
    )


def format_error_streak(
    steps: DataFrame, is_empty: Column, max_errors: int = 3, position: str = "turn"
) -> DataFrame:
    """Consecutive empty commands up to each step; over `max_errors` ends the episode.

    `position` numbers the steps of an episode without gaps from 0.
    """
    good = F.when(~is_empty, F.col(position))
    marked = running(steps, ["session_id"], position, {"_good": ("max", good)})
    streak = F.col(position) - F.coalesce(F.col("_good"), F.lit(-1))
    return marked.select(
        *steps.columns,
        streak.cast("bigint").alias("streak"),
        (streak > max_errors).alias("ends"),
    )


def streak_end(streaks: DataFrame, position: str = "turn") -> DataFrame:
    """First ending step per episode that has one."""
    return (
        streaks.where("ends")
        .groupBy("session_id")
        .agg(F.min(position).alias("end_step"))
    )


def _opens_with_system(messages: DataFrame, more: dict | None = None) -> DataFrame:
    """Messages with `_start`, the number of initial ones: system and user, or user."""
    system = F.col("role") == "system"
    seen = running(
        messages,
        ["session_id"],
        "turn",
        {"_system": ("first", system), **(more or {})},
        inclusive=False,
    )
    return seen.withColumn("_start", F.when(F.coalesce("_system", system), 2).otherwise(1))


def context_blocks(messages: DataFrame) -> DataFrame:
    """Attempt and feedback blocks of a conversation, one row each.

    The initial messages (system and user, or user alone) are left out; a user
    message counts as feedback only right behind an attempt.
    """
    spoken = F.col("role") == "assistant"
    seen = _opens_with_system(
        messages,
        {
            "_later": ("sum", (spoken & (F.col("turn") >= 2)).cast("bigint")),
            "_second": ("max", F.when(F.col("turn") == 1, spoken)),
            "_previous": ("last", spoken),
        },
    )
    attempt = spoken & (F.col("turn") >= F.col("_start"))
    second = F.coalesce("_second", F.lit(False)) & (F.col("_start") == 1)
    number = F.col("_later") + second.cast("bigint") + attempt.cast("bigint")
    feedback = (
        (F.col("role") == "user")
        & F.coalesce("_previous", F.lit(False))
        & (F.col("turn") > F.col("_start"))
    )
    title = F.when(attempt, F.lit("### Attempt ")).otherwise(F.lit("### Feedback on Attempt "))
    return seen.where(attempt | feedback).select(
        "session_id",
        "turn",
        number.alias("attempt"),
        F.concat(title, number.cast("string"), F.lit("\n"), F.col("text")).alias("block"),
    )


def prior_context(messages: DataFrame, attempts_per_part: int) -> DataFrame:
    """Text of all attempts and feedback so far, as injected into the next call.

    `context_blocks` are the contract; this form is for callers that want
    rendered text. A row is (session_id, part, context) whatever the number of
    attempts: part p holds `attempts_per_part` of them, and the parts joined by
    a blank line are the whole text. The caller names the size.
    """
    blocks = context_blocks(messages)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "block")))
    return (
        blocks.withColumn("part", F.floor((F.col("attempt") - 1) / attempts_per_part))
        .groupBy("session_id", "part")
        .agg(
            F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context")
        )
    )


def attempt_index(messages: DataFrame) -> DataFrame:
    """Index of each model call from the number of messages before it."""
    opened = _opens_with_system(messages)
    return opened.where(F.col("role") == "assistant").select(
        *messages.columns,
        F.floor((F.col("turn") - F.col("_start")) / 2).cast("bigint").alias("attempt_index"),
    )


def step_count_flags(
    steps: DataFrame, max_steps: int = 100, position: str = "turn"
) -> DataFrame:
    """Step number of each call and whether it is forced to submit."""
    counted = running(
        steps, ["session_id"], position, {"step": ("count", F.lit(1))}
    )
    return counted.select(
        *steps.columns, "step", (F.col("step") >= max_steps).alias("force_submit")
    )


def retry_latest(
    attempts: DataFrame, keys: Sequence[str], max_retries: int = 2
) -> DataFrame:
    """Outcome of retrying up to `max_retries` times after the first attempt.

    Attempts are (keys, attempt from 0, ok, error). The first success is kept;
    when all of the allowed ones failed the result is an error.
    """
    allowed = attempts.where(F.col("attempt") <= max_retries)
    first_ok = F.min(F.when(F.col("ok"), F.col("attempt")))
    return (
        allowed.groupBy(*keys)
        .agg(
            first_ok.alias("_ok_at"),
            F.count(F.lit(1)).alias("_tried"),
            F.max_by("error", "attempt").alias("_last_error"),
        )
        .select(
            *keys,
            F.col("_ok_at").isNotNull().alias("ok"),
            F.coalesce(F.col("_ok_at") + 1, F.col("_tried")).cast("bigint").alias("attempts"),
            F.when(
                F.col("_ok_at").isNull(),
                F.concat(
                    F.lit(ROLLOUT_FAILED[0]),
                    F.col("_tried").cast("string"),
                    F.lit(ROLLOUT_FAILED[1]),
                ),
            ).alias("error"),
            F.when(F.col("_ok_at").isNull(), F.col("_last_error")).alias("cause"),
        )
    )


def step_reason(
    exception: Column,
    timed_out: Column,
    budget_spent: Column,
    submit_tag: Column,
    format_error: Column,
    sentinel: Column,
    last_step: Column,
) -> Column:
    """Why an episode would end at this step, null when it goes on.

    An exception replaces whatever outcome the step was about to have.
    """
    return (
        F.when(exception, F.lit("error"))
        .when(timed_out, F.lit("timeout"))
        .when(budget_spent, F.lit("token_limit"))
        .when(submit_tag, F.lit("submit"))
        .when(format_error, F.lit("format_error"))
        .when(sentinel, F.lit("submit"))
        .when(last_step, F.lit("max_steps"))
    )


def episode_reason(steps: DataFrame, reason: str = "reason", position: str = "step") -> DataFrame:
    """First ending step of each episode and its reason, max_steps when none ends it."""
    code = F.array_position(F.array(*[F.lit(r) for r in EPISODE_REASONS]), F.col(reason))
    known = F.when(code > 0, code).otherwise(
        F.raise_error(F.concat(F.lit("unknown reason: "), F.col(reason)))
    )
    # Step and reason in one number keep the aggregate in fixed-size buffers.
    packed = F.when(
        F.col(reason).isNotNull(), F.col(position).cast("bigint") * 16 + known.cast("bigint")
    )
    first = F.col("_first")
    return (
        steps.groupBy("session_id")
        .agg(F.min(packed).alias("_first"), F.max(position).alias("_last"))
        .select(
            "session_id",
            F.coalesce(
                F.try_element_at(
                    F.array(*[F.lit(r) for r in EPISODE_REASONS]), (first % 16).cast("int")
                ),
                F.lit("max_steps"),
            ).alias("reason"),
            F.coalesce(F.floor(first / 16), F.col("_last")).alias("end_step"),
        )
    )


def _read_steps(
    steps: DataFrame, tokens: Callable[[Column], Column], nudge_tokens: int, max_chars: int
) -> DataFrame:
    """Steps with what their command is, and the tokens of the action and of its answer."""
    call = parse_tool_call(F.col("action"))
    parsed = steps.withColumn("_call", call).withColumns(
        {
            "_submits": F.col("_call.type") == "submit",
            "_blank": (F.col("_call.type") != "submit") & (F.length(py_strip(F.col("_call.content"))) == 0),
            "_said": tokens(F.col("action")).cast("bigint"),
            "_seen": tokens(format_observation(F.col("stdout"), F.col("returncode"), max_chars)).cast("bigint"),
        }
    )
    answer = F.when(F.col("_blank"), F.lit(nudge_tokens)).otherwise(F.coalesce("_seen", F.lit(0))).cast("bigint")
    return parsed.withColumn("_answer", answer)


def episode_result(
    steps: DataFrame,
    tokens: Callable[[Column], Column],
    max_len: int = 16384,
    max_steps: int = 100,
    timeout: float | None = None,
    max_errors: int = 3,
    initial_tokens: int = 0,
    nudge_tokens: int = 0,
    max_chars: int = 10000,
) -> DataFrame:
    """(session_id, steps, total_tokens, reason, seconds) of recorded episodes.

    Steps are (session_id, step from 0, action, stdout, returncode, failed,
    elapsed): `elapsed` counts the seconds at the step's begin, `failed` marks
    a step whose model call broke. A step is made if the time and the tokens
    before it allow; its command is the action's tool call. A blank command is
    answered by a nudge of `nudge_tokens`, any other by its observation.
    Episodes end at the first step with a reason; steps recorded behind it don't count.
    """
    before = running(
        _read_steps(steps, tokens, nudge_tokens, max_chars),
        ["session_id"],
        "step",
        {
            "_spent": ("sum", F.col("_said") + F.col("_answer")),
            "_good": ("max", F.when(~F.col("_blank"), F.col("step"))),
        },
        inclusive=False,
    )
    used = F.col("_spent") + initial_tokens
    streak = F.col("step") - F.coalesce(F.col("_good"), F.lit(-1))
    reason = step_reason(
        exception=F.coalesce("failed", F.lit(False)),
        timed_out=F.lit(False) if timeout is None else F.col("elapsed") >= timeout,
        budget_spent=used >= max_len,
        submit_tag=F.col("_submits"),
        format_error=F.col("_blank") & (streak > max_errors),
        sentinel=~F.col("_blank") & submission_sentinel(F.col("stdout")).isNotNull(),
        last_step=F.col("step") == max_steps - 1,
    )
    # A model call is only made, and can only break, while time and tokens last.
    early = F.when(F.lit(False) if timeout is None else F.col("elapsed") >= timeout, F.lit("timeout")).when(
        used >= max_len, F.lit("token_limit")
    )
    named = before.select(
        "session_id", "step", "elapsed", "_said", "_answer", used.alias("_used"), F.coalesce(early, reason).alias("reason")
    )
    return _episode_ends(named)


def episode_scan(
    steps: DataFrame,
    tokens: Callable[[Column], Column],
    max_len: int = 16384,
    max_steps: int = 100,
    timeout: float | None = None,
    max_errors: int = 3,
    initial_tokens: int = 0,
    nudge_tokens: int = 0,
    max_chars: int = 10000,
    chunk: int = automaton.CHUNK,
) -> DataFrame:
    """The same as `episode_result`, by one scan of an automaton over each episode's steps.

    States 0 ... max_errors are the streak of blank commands, the others the reasons that have ended the
    episode. The tokens spent before a step are summed in the same scan.
    """
    read = _read_steps(steps, tokens, nudge_tokens, max_chars)
    reasons = {name: max_errors + 1 + i for i, name in enumerate(EPISODE_REASONS)}
    states = max_errors + 1 + len(reasons)
    live = range(max_errors + 1)

    def ends(reason: str) -> Column:
        return automaton.transition(states, {s: reasons[reason] for s in live})

    late = F.lit(False) if timeout is None else F.col("elapsed") >= timeout
    longer = {s: s + 1 if s < max_errors else reasons["format_error"] for s in live}
    last = F.col("step") == max_steps - 1
    # In the order of `step_reason`; a step that does not end is the last one allowed or goes on.
    blank = F.when(last, automaton.transition(states, {s: reasons["max_steps"] if s < max_errors else longer[s] for s in live}))
    step = (
        F.when(late, ends("timeout"))
        .when(F.coalesce("failed", F.lit(False)), ends("error"))
        .when(F.col("_submits"), ends("submit"))
        .when(F.col("_blank"), F.coalesce(blank, automaton.transition(states, longer)))
        .when(submission_sentinel(F.col("stdout")).isNotNull(), ends("submit"))
        .when(last, ends("max_steps"))
        .otherwise(automaton.transition(states, {s: 0 for s in live}))
    )
    seen = automaton.scan(
        read,
        ["session_id"],
        "step",
        step,
        states,
        amounts={"_spent": F.col("_said") + F.col("_answer")},
        columns=["elapsed", "_said", "_answer"],
        chunk=chunk,
    )
    used = F.col("_spent") + initial_tokens
    timed_out = F.lit(False) if timeout is None else F.col("elapsed") >= timeout
    names = F.array(*[F.lit(r) for r in EPISODE_REASONS])
    ended = F.when(F.col("after") > max_errors, F.get(names, F.col("after") - (max_errors + 1)))
    # The budget is tested behind the time and before the rest; a step behind an end was never made.
    reason = F.when(~timed_out & (used >= max_len), F.lit("token_limit")).otherwise(ended)
    made = seen.where(F.col("before") <= max_errors)
    return _episode_ends(
        made.select("session_id", "step", "elapsed", "_said", "_answer", used.alias("_used"), reason.alias("reason"))
    )


def _episode_ends(named: DataFrame) -> DataFrame:
    """Figures of each episode from its steps: step, elapsed, _said, _answer, _used before it, and a reason if it ends there."""
    unmade = F.col("reason").isin("timeout", "token_limit", "error")
    unanswered = F.col("reason").isin("submit", "format_error")
    total = F.col("_used") + F.when(unmade, 0).otherwise(F.col("_said")) + F.when(unmade | unanswered, 0).otherwise(
        F.col("_answer")
    )
    figures = F.struct(
        "step",
        F.when(unmade, F.col("step")).otherwise(F.col("step") + 1).alias("steps"),
        total.alias("total_tokens"),
        F.array_position(F.array(*[F.lit(r) for r in EPISODE_REASONS]), F.coalesce("reason", F.lit("max_steps"))).alias("code"),
        F.col("elapsed").alias("seconds"),
    )
    ended = named.groupBy("session_id").agg(
        F.min(F.when(F.col("reason").isNotNull(), figures)).alias("_end"), F.max(figures).alias("_last")
    )
    result = F.coalesce("_end", "_last")
    return ended.select("session_id", result.alias("_r")).select(
        "session_id",
        F.col("_r.steps").cast("bigint").alias("steps"),
        F.col("_r.total_tokens").alias("total_tokens"),
        F.element_at(F.array(*[F.lit(r) for r in EPISODE_REASONS]), F.col("_r.code").cast("int")).alias("reason"),
        F.col("_r.seconds").alias("seconds"),
    )
