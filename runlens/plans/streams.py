"""Streaming queries, run to the end of their present input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.operators.signals import instance_rollup
from runlens.plans.registry import query
from runlens.schemas import INSTANCE_RESULT
from runlens.session import work_path
from runlens.sources import fixtures as fx
from runlens.sources.readers import read_jsonl_strict
from runlens.streaming import ledger

RESULT_FIELDS = ("instance_id", "repo", "resolve_rate", "avg_steps", "avg_tokens")


def _result_schema() -> StructType:
    return StructType([f for f in INSTANCE_RESULT.fields if f.name in RESULT_FIELDS])


def _write_results(spark: SparkSession, sf: str, path: str) -> None:
    """Finished instances as JSON lines; a third of them is written twice."""
    results = instance_rollup(fx.bare_runs(spark, sf), fx.instances_of_runs(spark, sf))
    rows = results.select(*_result_schema().fieldNames())
    copies = F.when(F.col("instance_id").cast("bigint") % 3 == 0, 2).otherwise(1)
    twice = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    twice.write.mode("append").json(path)


@query(
    "stream_result_ledger",
    """
select instance_id, repo, round(resolve_rate, 6) as resolve_rate, round(avg_steps, 6) as avg_steps,
 round(avg_tokens, 6) as avg_tokens from rollup_view
""",
)
def stream_result_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Results stream in file by file; after a restart the same ones come again."""
    schema = _result_schema()
    source, target = work_path(spark, "stream-in"), work_path(spark, "stream-ledger")
    _write_results(spark, sf, source)
    checkpoint = work_path(spark, "stream-cp")
    _run_stream(spark, source, target, checkpoint)
    repeated = read_jsonl_strict(spark, source, schema)
    repeated.write.mode("append").json(source)
    _run_stream(spark, source, target, checkpoint)
    rounded = [F.round(c, 6).alias(c) for c in ("resolve_rate", "avg_steps", "avg_tokens")]
    return ledger.read_ledger(spark, target, schema).select("instance_id", "repo", *rounded)


def _run_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    results = ledger.stream_results(spark, source, _result_schema(), files_per_trigger=2)
    ledger.run_ledger(results, target, checkpoint, _result_schema()).awaitTermination()


@query(
    "stream_progress",
    """
select count(*) as done, count(*) as total, count(*) filter (resolve_rate > 0) as resolved_any,
 round(avg(resolve_rate), 6) as avg_resolve_rate from rollup_view
""",
)
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    schema = _result_schema()
    source, target = work_path(spark, "progress-in"), work_path(spark, "progress")
    _write_results(spark, sf, source)
    total = fx.table(spark, sf, "customer").count()
    results = ledger.stream_results(spark, source, schema, files_per_trigger=2)
    checkpoint = work_path(spark, "progress-cp")
    ledger.run_ledger(results, target, checkpoint, schema, sums=ledger.progress_sums()).awaitTermination()
    return ledger.ledger_progress(spark, target, total).select(
        "done", "total", "resolved_any", F.round("avg_resolve_rate", 6).alias("avg_resolve_rate")
    )
