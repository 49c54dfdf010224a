"""Source and sink queries: data is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.prompts import build_chat_prompt, split_object_path
from runlens.operators.sampling import shuffle_key
from runlens.plans.registry import query
from runlens.session import work_path
from runlens.sources import fixtures as fx
from runlens.sources import readers, writers

RUN_COLUMNS = "instance_id, repo, run_id, resolved, steps, total_tokens, reason, wall_clock_seconds"
RUN_NAMES = RUN_COLUMNS.split(", ")


@query("scan_jsonl_strict", f"select {RUN_COLUMNS} from runs")
def scan_jsonl_strict(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "strict")
    writers.append_ledger(fx.runs(spark, sf).select(*RUN_NAMES), path)
    return readers.read_jsonl_strict(spark, path, schemas.RUN_LINE).select(*RUN_NAMES)


def _spoilt_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Run lines of which some are cut off, lack their id or are blank."""
    rows = fx.runs(spark, sf).select(*RUN_NAMES)
    whole = F.to_json(F.struct(*RUN_NAMES))
    which = F.col("run_id") % 13
    anonymous = F.to_json(F.struct("repo", "run_id"))
    return rows.select(
        F.when(which == 0, F.left(whole, F.lit(20)))
        .when(which == 1, anonymous)
        .when(which == 2, F.lit("  "))
        .otherwise(whole)
        .alias("value")
    )


@query("scan_jsonl_tolerant", f"select {RUN_COLUMNS} from runs where run_id % 13 > 2")
def scan_jsonl_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "tolerant")
    _spoilt_lines(spark, sf).write.text(path)
    return readers.read_jsonl_tolerant(spark, path, schemas.RUN_LINE).select(*RUN_NAMES)


@query(
    "scan_jsonl_rejects",
    """
select count(*) filter (run_id % 13 <> 2) as lines, count(*) filter (run_id % 13 < 2) as rejected from runs
""",
)
def scan_jsonl_rejects(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "rejects")
    _spoilt_lines(spark, sf).write.text(path)
    return readers.count_rejects(spark, path, schemas.RUN_LINE)


@query(
    "scan_json_array",
    """
select instance_id, case when resolved then 'yes' else 'no' end as prediction, error from predictions
""",
)
def scan_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Files with one array of up to 1000 samples each."""
    path = work_path(spark, "arrays")
    samples = fx.predictions(spark, sf).select(
        F.floor(F.col("instance_id").cast("bigint") / 1000).alias("bucket"),
        F.struct(
            "instance_id",
            F.when(F.col("resolved"), "yes").otherwise("no").alias("prediction"),
            "error",
        ).alias("sample"),
    )
    (
        samples.groupBy("bucket")
        .agg(F.to_json(F.collect_list("sample"), writers.KEEP_NULLS).alias("value"))
        .write.partitionBy("bucket")
        .text(path)
    )
    return readers.read_json_array(spark, path, schemas.SAMPLE).select(
        "instance_id", "prediction", "error"
    )


@query(
    "scan_prediction_tree",
    """
select cast(doc_id as varchar) as instance_id, concat('patch ', quality, toxic) as model_patch, 'm1' as model_name_or_path
from labels where doc_id % 5 > 1
""",
)
def scan_prediction_tree(spark: SparkSession, sf: str) -> DataFrame:
    """One <id>/prediction.json per prediction; some are cut off, some do not name their instance."""
    path = work_path(spark, "tree")
    named = fx.table(spark, sf, "labels").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("instance_id"),
        F.concat(F.lit("patch "), "quality", "toxic").alias("model_patch"),
        F.lit("m1").alias("model_name_or_path"),
    )
    whole = F.to_json(F.struct("instance_id", "model_patch", "model_name_or_path"))
    which = F.col("doc_id") % 5
    text = (
        F.when(which == 0, F.left(whole, F.lit(25)))
        .when(which == 1, F.to_json(F.struct("model_patch")))
        .otherwise(whole)
    )
    writers.write_prediction_tree(named.select("instance_id", text.alias("value")), path)
    return readers.read_prediction_tree(spark, path)


@query(
    "scan_dataset_split",
    "select cast(doc_id as varchar) as instance_id, source as repo, doc_id as seq from documents where lang = 'en'",
)
def scan_dataset_split(spark: SparkSession, sf: str) -> DataFrame:
    """The English documents are the test split, which is the default of this dataset."""
    from runlens.functions.prompts import TEST_SPLIT_DATASET

    root = work_path(spark, "datasets")
    rows = fx.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("instance_id"),
        F.col("source").alias("repo"),
        F.col("doc_id").alias("seq"),
        "lang",
    )
    for split, chosen in (("test", F.col("lang") == "en"), ("train", F.col("lang") != "en")):
        rows.where(chosen).drop("lang").write.parquet(f"{root}/{TEST_SPLIT_DATASET}/{split}")
    return readers.read_split(spark, root, TEST_SPLIT_DATASET)


@query("scan_id_list", "select instance_id from predictions where resolved")
def scan_id_list(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with blanks around them and blank lines between them."""
    path = work_path(spark, "ids")
    ids = fx.predictions(spark, sf).select(
        F.when(F.col("resolved"), F.concat(F.lit(" "), "instance_id", F.lit("\t"))).otherwise(" ").alias("value")
    )
    ids.write.text(path)
    return readers.read_id_list(spark, path)


@query(
    "write_training_jsonl",
    """
select instance_id, concat('<|im_start|>user', chr(10), problem_statement, '<|im_end|>', chr(10),
 '<|im_start|>assistant', chr(10)) as input, repo, problem_statement from instances
""",
)
def write_training(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "training")
    rows = fx.instances(spark, sf).withColumn("base_commit", F.lit(None).cast("string"))
    lines = writers.training_lines(rows, build_chat_prompt(F.col("problem_statement")))
    writers.write_training_jsonl(lines, path)
    stored = readers.read_jsonl_strict(spark, path, schemas.TRAINING_LINE)
    label = readers.parse_label(F.col("label"), schemas.TASK_LABEL)
    return stored.select("input", label.alias("l")).select(
        "l.instance_id", "input", "l.repo", "l.problem_statement"
    )


@query(
    "write_instance_tree",
    """
select instance_id, 'predictions' as output, case when resolved then 'yes' else 'no' end as content from predictions
union all select instance_id, 'reports', error from predictions where error is not null
""",
)
def write_instance_tree(spark: SparkSession, sf: str) -> DataFrame:
    root = work_path(spark, "results")
    results = fx.predictions(spark, sf).select(
        F.lit("run-1").alias("run_id"),
        "instance_id",
        F.when(F.col("resolved"), "yes").otherwise("no").alias("model_patch"),
        F.col("error").alias("report"),
    )
    tables = {"predictions": ["model_patch"], "reports": ["report"]}
    writers.write_result_tables(results, root, tables)
    parts = [
        spark.read.schema(f"instance_id string, {columns[0]} string, run_id string")
        .parquet(f"{root}/{name}")
        .select("instance_id", F.lit(name).alias("output"), F.col(columns[0]).alias("content"))
        for name, columns in tables.items()
    ]
    return parts[0].unionByName(parts[1])


@query("append_ledger", f"select {RUN_COLUMNS} from runs")
def append_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved runs are appended first, the others after them."""
    path = work_path(spark, "appended")
    rows = fx.runs(spark, sf).select(*RUN_NAMES)
    writers.append_ledger(rows.where("resolved"), path)
    writers.append_ledger(rows.where(~F.col("resolved")), path)
    return readers.read_jsonl_strict(spark, path, schemas.RUN_LINE).select(*RUN_NAMES)


@query(
    "write_report_json",
    """
with r as (select error is null and patch_exists as evaluated, resolved from predictions)
select count(*) as total_instances, count(*) filter (evaluated) as evaluated,
 count(*) filter (evaluated and resolved) as resolved_instances from r
""",
)
def write_report(spark: SparkSession, sf: str) -> DataFrame:
    from runlens.plans.reporting import run_report

    path = work_path(spark, "report")
    report = run_report(spark, sf)
    writers.write_report_json(report, path)
    stored = readers.read_json_array(spark, path, report.schema)
    return stored.select("total_instances", "evaluated", "resolved_instances")


@query(
    "object_store_paths",
    """
with u as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as rest from pages)
select page_id, split_part(rest, '/', 1) as bucket,
 ltrim(case when contains(rest, '/') then substr(rest, strpos(rest, '/') + 1) else '' end, '/') as key from u
""",
)
def object_store_paths(spark: SparkSession, sf: str) -> DataFrame:
    uri = F.regexp_replace("url", "^https?:", "s3:")
    return (
        fx.table(spark, sf, "pages")
        .select("page_id", split_object_path(uri).alias("p"))
        .select("page_id", "p.bucket", "p.key")
    )


@query(
    "write_id_list",
    """
select instance_id, row_number() over (order by md5(concat('42-', instance_id)), instance_id) - 1 as place from instances
""",
)
def write_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids in seeded order; the place is read off the stored files."""
    path = work_path(spark, "chosen")
    writers.write_id_list(
        fx.instances(spark, sf), [shuffle_key(42, "instance_id"), "instance_id"], path
    )
    return _numbered(readers.with_line_order(spark.read.text(path)))


def _numbered(lines: DataFrame) -> DataFrame:
    """Place of each line over all files: lines before its split plus place in it."""
    from pyspark.sql import Window

    split = ["path", "block"]
    ordered = lines.select("value", "seq.*")
    first = ordered.groupBy(*split).agg(
        F.min("row").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = first.select(
        *split, "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_offset")
    )
    return ordered.join(offsets, split).select(
        F.col("value").alias("instance_id"),
        (F.col("_offset") + F.col("row") - F.col("_first")).alias("place"),
    )
