"""Reward, verdict and session-score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import verdicts as vd
from runlens.functions.answers import binary_reward, math_reward
from runlens.operators import scoring
from runlens.plans.joining import region_weights
from runlens.plans.registry import query
from runlens.sources import fixtures as fx

REWARD_SQL = """
select *, case when abs(try_cast(answer as double) - n) < 1e-6 then 1.0::double else 0.0::double end as reward
from (select *, cast(substr(label, 6) as double) as n from extracted)
"""


@query("math_reward", f"select doc_id, reward from ({REWARD_SQL.strip()})")
def rewarded(spark: SparkSession, sf: str) -> DataFrame:
    return fx.responses(spark, sf).select(
        "doc_id", math_reward(F.col("response"), F.col("label")).alias("reward")
    )


@query(
    "batch_accuracy",
    f"""
select source, count(*) as samples, round(avg(reward), 6) as accuracy from ({REWARD_SQL.strip()}) group by source
""",
)
def batch_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.responses(spark, sf).select(
        "source", math_reward(F.col("response"), F.col("label")).alias("reward")
    )
    return scoring.batch_accuracy(rows, "source").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "binary_reward",
    "select run_id, case when resolved then 1.0::double else 0.0::double end as reward from runs",
)
def binary(spark: SparkSession, sf: str) -> DataFrame:
    return fx.bare_runs(spark, sf).select("run_id", binary_reward(F.col("resolved")).alias("reward"))


@query("verifier_passed", "select session_id, name, passed from effective")
def passed(spark: SparkSession, sf: str) -> DataFrame:
    flag = vd.verifier_passed(F.col("status"), F.col("score"), F.col("pass_threshold"))
    return fx.verdicts(spark, sf).select("session_id", "name", flag.alias("passed"))


@query("effective_score", "select session_id, name, eff as effective_score from effective")
def effective(spark: SparkSession, sf: str) -> DataFrame:
    score = vd.effective_score(F.col("status"), F.col("score"))
    return fx.verdicts(spark, sf).select("session_id", "name", score.alias("effective_score"))


@query(
    "verifier_schedule",
    """
select session_id, name, status, score, 'intermediate' as phase from verdicts where name in ('v1', 'v2')
union all select session_id, name, status, score, 'final' from verdicts where name in ('v2', 'v5')
""",
)
def schedule(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.verdicts(spark, sf).select("session_id", "name", "status", "score")
    return scoring.scheduled_verdicts(rows, intermediate=["v1", "v2"], final=["v2", "v5"])


@query(
    "verdict_or_default",
    """
select doc_id, case when doc_id % 11 = 0 then 'timeout' when toxic = 1 or doc_id % 5 = 0 or doc_id % 7 = 0
  or doc_id % 3 = 0 then 'error' else 'ok' end as status,
 case when doc_id % 11 = 0 or toxic = 1 or doc_id % 5 = 0 or doc_id % 7 = 0 or doc_id % 3 = 0 then 0.0::double
  else quality::double end as score,
 case when doc_id % 11 = 0 then 'timeout' when toxic = 1 then 'job crashed' when doc_id % 5 = 0 then 'image missing'
  when doc_id % 7 = 0 and doc_id % 2 = 0 then 'K8s Job timed out'
  when doc_id % 7 = 0 then 'No test output captured from pod logs'
  when doc_id % 3 = 0 then concat('unreadable ', lang) end as reason
from labels join documents using (doc_id)
""",
)
def verdict_or_default(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "labels").join(fx.table(spark, sf, "documents"), "doc_id")
    n = F.col("doc_id")
    verdict = vd.verdict_or_default(
        crash=F.when(F.col("toxic") == 1, "job crashed"),
        verifier_timed_out=n % 11 == 0,
        job_error=F.when(n % 5 == 0, "image missing"),
        job_timed_out=n % 2 == 0,
        output=F.when(n % 7 == 0, "").otherwise(F.col("text")),
        grading_error=F.when(n % 3 == 0, F.concat(F.lit("unreadable "), "lang")),
        resolved=F.col("quality") == 1,
    )
    return rows.select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


def _scored(spark: SparkSession, sf: str, aggregator: str, weighted: bool = False) -> DataFrame:
    rows = fx.verdicts(spark, sf)
    if weighted:
        rows = scoring.join_weights(rows, region_weights(spark, sf))
    scores = scoring.session_scores(fx.sessions(spark, sf), rows, aggregator)
    return scores.withColumn("aggregate_score", F.round("aggregate_score", 6) + 0.0)


@query(
    "score_mean",
    """
select s.session_id, round(coalesce(sum(eff) / count(eff), 1.0), 6) as aggregate_score
from sessions s left join effective e using (session_id) group by s.session_id
""",
)
def score_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "mean")


@query(
    "score_min",
    """
select s.session_id, round(coalesce(min(eff), 1.0), 6) as aggregate_score
from sessions s left join effective e using (session_id) group by s.session_id
""",
)
def score_min(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "min")


WEIGHTED_SQL = """
select s.session_id, round(case when coalesce(sum(w), 0) = 0 then 1.0 else sum(eff * w) / sum(w) end, 6) as aggregate_score
from sessions s left join (select e.*, {weight} as w from effective e) e using (session_id) group by s.session_id
"""


@query(
    "score_weighted",
    WEIGHTED_SQL.format(
        weight="case when name in ('v1', 'v2', 'v3', 'v4') then (cast(substr(name, 2) as int) % 3) / 4.0::double else 1.0::double end"
    ),
)
def score_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "weighted_sum", weighted=True)


@query(
    "score_by_name",
    WEIGHTED_SQL.format(
        weight="case name when 'v1' then 0.2::double when 'v2' then 0.8::double when 'v3' then 0.0::double else 1.0::double end"
    ),
)
def score_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted aggregate chosen by name, weights from a mapping."""
    scores = scoring.session_scores(
        fx.sessions(spark, sf),
        fx.verdicts(spark, sf),
        "weighted_sum",
        weights={"v1": 0.2, "v2": 0.8, "v3": 0.0},
    )
    return scores.withColumn("aggregate_score", F.round("aggregate_score", 6) + 0.0)


@query(
    "all_passed",
    """
select s.session_id, coalesce(min(passed::int), 1) = 1 as all_passed
from sessions s left join effective e using (session_id) group by s.session_id
""",
)
def all_passed(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.all_passed(fx.sessions(spark, sf), fx.verdicts(spark, sf))


@query(
    "group_norm_reward",
    """
with r as (select instance_id, run_id, case when resolved then 1.0::double else 0.0::double end as reward from runs)
select instance_id, run_id, reward, round((reward - avg(reward) over w) / (stddev_pop(reward) over w + 0.0001), 6) + 0.0 as advantage
from r window w as (partition by instance_id)
""",
)
def group_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.bare_runs(spark, sf).select(
        "instance_id", "run_id", binary_reward(F.col("resolved")).alias("reward")
    )
    normed = scoring.group_norm_reward(rows, "instance_id", eps=1e-4)
    return normed.withColumn("advantage", F.round("advantage", 6) + 0.0)
