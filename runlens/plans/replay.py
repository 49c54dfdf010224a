"""Queries over ordered sessions and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import jobs
from runlens.functions.text import word_count
from runlens.operators import scoring, sessions
from runlens.plans.registry import query
from runlens.sources import fixtures as fx

STOPS = """
stops as (select session_id, min(turn) filter (all_passed) as stop, max(turn) as last_turn from generations group by 1)
"""


@query(
    "session_replay",
    f"""
with {STOPS.strip()}
select s.session_id, g.output as final_output, coalesce(stop, last_turn) + 1 as num_turns, stop is not null as stopped_early
from stops s join generations g on g.session_id = s.session_id and g.turn = coalesce(stop, last_turn)
""",
)
def session_replay(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_replay(fx.generations(spark, sf))


@query(
    "kept_turns",
    f"""
with {STOPS.strip()}
select g.session_id, g.turn, g.output, g.all_passed from generations g join stops s using (session_id)
where stop is null or turn <= stop
""",
)
def kept_turns(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.kept_turns(fx.generations(spark, sf)).select(
        "session_id", "turn", "output", "all_passed"
    )


@query(
    "token_budget_cut",
    r"""
with t as (select session_id, turn, role, len(string_split_regex(trim(text, chr(9) || chr(10) || ' '), '\s+')) as tokens from turns),
u as (select *, coalesce(sum(tokens) over (partition by session_id order by turn rows between unbounded preceding and 1 preceding), 0)
 as used from t)
select session_id, turn, used::bigint as used_tokens, (150 - used)::bigint as remaining, 150 - used > 0 as allowed,
 greatest(least(64, 150 - used), 0)::bigint as call_limit from u where role = 'assistant'
""",
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    budget = sessions.token_budget(
        fx.turns(spark, sf),
        word_count(F.col("text")),
        max_len=150,
        is_step=F.col("role") == "assistant",
        call_cap=64,
    )
    return budget.select(
        "session_id", "turn", "used_tokens", "remaining", "allowed", "call_limit"
    )


@query(
    "format_error_streak",
    """
with t as (select session_id, turn, length(text) % 4 = 0 as good from turns),
u as (select *, sum(good::int) over (partition by session_id order by turn rows unbounded preceding) as island from t),
v as (select *, case when good then 0 else row_number() over (partition by session_id, island order by turn)
  - case when island > 0 then 1 else 0 end end as streak from u)
select session_id, turn, streak::bigint as streak, streak > 3 as ends from v
""",
)
def format_streak(spark: SparkSession, sf: str) -> DataFrame:
    streaks = sessions.format_error_streak(fx.turns(spark, sf), F.length("text") % 4 != 0)
    return streaks.select("session_id", "turn", "streak", "ends")


BLOCKS = """
f as (select session_id, case when arg_min(role, turn) = 'system' then 2 else 1 end as start from turns group by 1),
m as (select t.*, role = 'assistant' and turn >= start as attempt from turns t join f using (session_id)),
n as (select *, sum(attempt::int) over (partition by session_id order by turn rows unbounded preceding) as no,
 coalesce(lag(attempt) over (partition by session_id order by turn), false) as after_attempt from m),
blocks as (select session_id, turn, no::bigint as attempt,
 concat(case when attempt then '### Attempt ' else '### Feedback on Attempt ' end, no, chr(10), text) as block
 from n where attempt or (role = 'user' and after_attempt))
"""


@query("context_blocks", f"with {BLOCKS.strip()}\nselect session_id, turn, attempt, block from blocks")
def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.context_blocks(fx.turns(spark, sf))


@query(
    "prior_context",
    f"""
with {BLOCKS.strip()}
select session_id, (attempt - 1) // 3 as part, string_agg(block, chr(10) || chr(10) order by turn) as context
from blocks group by 1, 2
""",
)
def prior_context(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.prior_context(fx.turns(spark, sf), attempts_per_part=3)


CHECKS = ("ast_check", "swe_test")


def _turn_verdicts(generations: DataFrame) -> DataFrame:
    """Two verdicts per generation turn with scores taken from its length."""
    size = F.length("output")
    passing = F.col("all_passed")
    ast = F.struct(
        F.lit("ast_check").alias("name"),
        F.when(size % 11 == 0, "timeout").otherwise("ok").alias("status"),
        F.when(passing, 1.0).otherwise(size % 8 / 8).alias("score"),
    )
    test = F.struct(
        F.lit("swe_test").alias("name"),
        F.lit("ok").alias("status"),
        F.when(size % 3 == 0, 1.0).otherwise(F.round(size % 100 / 100, 2)).alias("score"),
    )
    return generations.select(
        "session_id", "turn", F.explode(F.array(ast, test)).alias("v")
    ).select("session_id", "turn", "v.*", F.lit(1.0).alias("pass_threshold"))


@query(
    "turn_feedback",
    """
with g as (select session_id, turn, length(output) as n, all_passed from generations),
v as (select session_id, turn, case when n % 11 = 0 then 'TIMEOUT' end as bad,
  case when all_passed then 1.0::double else (n % 8) / 8.0::double end as s1,
  case when n % 3 = 0 then 1.0::double else round((n % 100) / 100.0::double, 2) end as s2 from g),
w as (select *, bad is null and s1 >= 1 and s2 >= 1 as every_ok from v)
select session_id, turn, case when every_ok or turn = 2 then '' else concat(
 'Your solution was evaluated. Here is the feedback:', chr(10), chr(10),
 '[ast_check] ', case when bad is not null then bad when s1 >= 1 then concat('PASSED (score: ', printf('%.2f', s1), ')')
  else concat('FAILED (score: ', printf('%.2f', s1), ')') end, chr(10),
 '[swe_test] ', case when s2 >= 1 then 'PASSED' else 'FAILED' end, ' (score: ', printf('%.2f', s2), ')', chr(10), chr(10),
 case when every_ok then 'All checks passed.' else 'Please revise your solution to address the issues above.' end) end as feedback
from w
""",
)
def turn_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.turn_feedback(_turn_verdicts(fx.generations(spark, sf)), CHECKS, max_turns=3)


@query(
    "attempt_index",
    """
with f as (select session_id, arg_min(role, turn) = 'system' as sys from turns group by 1)
select session_id, turn, floor((turn - case when sys then 2 else 1 end) / 2)::bigint as attempt_index
from turns join f using (session_id) where role = 'assistant'
""",
)
def attempt_index(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.attempt_index(fx.turns(spark, sf)).select(
        "session_id", "turn", "attempt_index"
    )


@query(
    "step_count_flags",
    """
select session_id, turn, row_number() over (partition by session_id order by turn) as step,
 row_number() over (partition by session_id order by turn) >= 3 as force_submit
from turns where role = 'assistant'
""",
)
def step_flags(spark: SparkSession, sf: str) -> DataFrame:
    steps = fx.turns(spark, sf).where(F.col("role") == "assistant").select("session_id", "turn")
    return sessions.step_count_flags(steps, max_steps=3)


@query(
    "attempt_retry_latest",
    """
with a as (select l_orderkey as rollout, l_linenumber - 1 as attempt, min(l_returnflag) <> 'R' as ok,
  case when min(l_returnflag) = 'R' then concat('pod ', max(l_partkey)) end as error from lineitem
  where l_linenumber <= 3 group by 1, 2),
s as (select rollout, min(attempt) filter (ok) as ok_at, count(*) as tried, max(attempt) as last_at from a group by 1)
select s.rollout, ok_at is not null as ok, coalesce(ok_at + 1, tried)::bigint as attempts,
 case when ok_at is null then concat('Rollout failed after ', tried, ' attempts') end as error,
 case when ok_at is null then a.error end as cause
from s join a on a.rollout = s.rollout and a.attempt = s.last_at
""",
)
def retry_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order are the attempts of a rollout."""
    attempts = (
        fx.table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("rollout"), (F.col("l_linenumber") - 1).alias("attempt")
        )
        .agg(F.min("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"))
        .select(
            "rollout",
            "attempt",
            (F.col("flag") != "R").alias("ok"),
            F.when(
                F.col("flag") == "R", F.concat(F.lit("pod "), F.col("part").cast("string"))
            ).alias("error"),
        )
    )
    return sessions.retry_latest(attempts, ["rollout"], max_retries=2)


@query(
    "episode_reason",
    """
with t as (select session_id, turn, length(text) as n from turns),
u as (select session_id, turn, case when n % 31 = 0 then 'error' when n % 29 = 0 then 'timeout'
 when n % 23 = 0 then 'token_limit' when n % 13 = 0 then 'submit' when n % 11 = 0 then 'format_error'
 when n % 7 = 0 then 'submit' when turn = 5 then 'max_steps' end as reason from t)
select session_id, coalesce(arg_min(reason, turn) filter (reason is not null), 'max_steps') as reason,
 coalesce(min(turn) filter (reason is not null), max(turn)) as end_step from u group by session_id
""",
)
def episode_reason(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    reason = sessions.step_reason(
        exception=n % 31 == 0,
        timed_out=n % 29 == 0,
        budget_spent=n % 23 == 0,
        submit_tag=n % 13 == 0,
        format_error=n % 11 == 0,
        sentinel=n % 7 == 0,
        last_step=F.col("turn") == 5,
    )
    steps = fx.turns(spark, sf).select("session_id", F.col("turn").alias("step"), reason.alias("reason"))
    return sessions.episode_reason(steps)


EPISODE_SQL = r"""
with t as (select session_id, turn as step, text, length(text) as n, turn * 10 + length(text) % 10 as elapsed from turns),
a as (select *, n % 13 = 0 as submits, n % 13 <> 0 and n % 11 < 4 as blank, n % 31 = 0 as failed, n % 7 = 0 as done from t),
b as (select *, case when submits then concat(text, ' <submit/>') when blank then concat('<bash> </bash> ', text)
  else concat('<bash> ', text, ' </bash>') end as action,
 concat('<returncode>', cast(n % 3 as varchar), '</returncode>', chr(10), '<output>', chr(10),
  case when done then concat('ok', chr(10), 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT', chr(10)) else '' end, text,
  chr(10), '</output>') as seen from a),
c as (select *, len(string_split_regex(trim(action, chr(9) || chr(10) || ' '), '\s+'))::bigint as said,
 case when blank then 9 else len(string_split_regex(trim(seen, chr(9) || chr(10) || ' '), '\s+')) end::bigint as answer from b),
d as (select *, coalesce(sum(said + answer) over w, 0)::bigint + 40 as used,
 step - coalesce(max(case when not blank then step end) over w, -1) as streak from c
 window w as (partition by session_id order by step rows between unbounded preceding and 1 preceding)),
e as (select *, case when elapsed >= 55 then 'timeout' when used >= 400 then 'token_limit' when failed then 'error'
 when submits then 'submit' when blank and streak > 1 then 'format_error' when not blank and done then 'submit'
 when step = 3 then 'max_steps' end as reason from d),
f as (select *, row_number() over (partition by session_id order by case when reason is null then 1 else 0 end,
 case when reason is null then -step else step end) as place from e)
select session_id, case when reason in ('timeout', 'token_limit', 'error') then step else step + 1 end as steps,
 used + case when reason in ('timeout', 'token_limit', 'error') then 0 else said end
  + case when reason in ('timeout', 'token_limit', 'error', 'submit', 'format_error') then 0 else answer end as total_tokens,
 coalesce(reason, 'max_steps') as reason, elapsed as seconds from f where place = 1
"""


def _recorded_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Each message is an action or its output, whole, with tags that its length chooses."""
    n, text = F.length("text"), F.col("text")
    submits, blank = n % 13 == 0, n % 11 < 4
    action = (
        F.when(submits, F.concat(text, F.lit(" <submit/>")))
        .when(blank, F.concat(F.lit("<bash> </bash> "), text))
        .otherwise(F.concat(F.lit("<bash> "), text, F.lit(" </bash>")))
    )
    done = F.when(n % 7 == 0, "ok\nCOMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT\n").otherwise("")
    return fx.turns(spark, sf).select(
        "session_id",
        F.col("turn").alias("step"),
        action.alias("action"),
        F.concat(done, text).alias("stdout"),
        (n % 3).alias("returncode"),
        (n % 31 == 0).alias("failed"),
        (F.col("turn") * 10 + n % 10).alias("elapsed"),
    )


EPISODE_LIMITS = {
    "max_len": 400, "max_steps": 4, "timeout": 55, "max_errors": 1, "initial_tokens": 40, "nudge_tokens": 9
}


@query("episode_result", EPISODE_SQL)
def episode_result(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.episode_result(_recorded_steps(spark, sf), word_count, **EPISODE_LIMITS)


@query("episode_scan", EPISODE_SQL)
def episode_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same episodes by the automaton, in chunks so short that most of them carry over."""
    return sessions.episode_scan(_recorded_steps(spark, sf), word_count, **EPISODE_LIMITS, chunk=3)


@query(
    "multi_turn_record",
    """
with g as (select session_id, turn, output, length(output) as n, all_passed from generations where turn < 3),
v as (select *, case when n % 11 = 0 then 'timeout' else 'ok' end as st1,
  case when all_passed then 1.0::double else (n % 8) / 8.0::double end as s1,
  case when n % 3 = 0 then 1.0::double else round((n % 100) / 100.0::double, 2) end as s2 from g),
w as materialized (select *, st1 = 'ok' and s1 >= 1 as p1, s2 >= 1 as p2, case when st1 = 'ok' then s1 else 0.0 end as e1 from v),
s as (select session_id, min(turn) filter (p1 and p2) as stop, max(turn) as last_turn from w group by 1)
select w.session_id, w.turn, w.output, round((e1 + s2) / 2, 6) as aggregate_score,
 concat('ast_check:', st1, ':', printf('%.4f', s1), ':', p1, ',swe_test:ok:', printf('%.4f', s2), ':', p2) as results,
 case when (p1 and p2) or turn = 2 then 0 else 1 end as has_feedback,
 coalesce(stop, last_turn) + 1 as num_turns, stop is not null as stopped_early,
 round(max(case when turn = coalesce(stop, last_turn) then s2 end) over (partition by w.session_id), 6) as final_aggregate_score
from w join s on s.session_id = w.session_id and w.turn <= coalesce(stop, last_turn)
""",
)
def multi_turn_record(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of each session beside its final figures."""
    generations = fx.generations(spark, sf)
    turns, ends = jobs.replay_sessions(
        generations.select("session_id", "turn", "output"), _turn_verdicts(generations), CHECKS, max_turns=3
    )
    result = F.transform(
        "verifier_results",
        lambda r: F.concat_ws(":", r["name"], r["status"], F.format_string("%.4f", r["score"]), r["passed"].cast("string")),
    )
    return turns.join(ends, "session_id").select(
        "session_id",
        "turn",
        "output",
        (F.round("aggregate_score", 6) + 0.0).alias("aggregate_score"),
        F.array_join(result, ",").alias("results"),
        (F.length("feedback") > 0).cast("int").alias("has_feedback"),
        "num_turns",
        "stopped_early",
        (F.round("final_aggregate_score", 6) + 0.0).alias("final_aggregate_score"),
    )
