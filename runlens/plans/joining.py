"""Join, set and image-list queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import bloom, joins, sets
from runlens.operators import images as im
from runlens.operators.scoring import join_weights, latest_verdicts
from runlens.plans.registry import query
from runlens.session import work_path
from runlens.sources import buckets
from runlens.sources import fixtures as fx
from runlens.sources.readers import load_prompt_map
from runlens.sources.writers import merge_predictions


def _prompt_map(spark: SparkSession, sf: str) -> DataFrame:
    return load_prompt_map(fx.prompts(spark, sf))


@query("load_prompt_map", "select instance_id, text_inputs from prompt_map")
def prompt_map(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_map(spark, sf)


@query(
    "join_samples_problems",
    """
select cast(l.doc_id as varchar) as task_id, l.quality, d.lang, length(d.text) as problem_chars
from labels l join documents d on d.doc_id = l.doc_id
""",
)
def join_samples_problems(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("task_id"), "quality"
    )
    problems = fx.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"),
        "lang",
        F.length("text").cast("bigint").alias("problem_chars"),
    )
    return joins.join_samples_problems(samples, problems, "task_id")


@query(
    "join_prompts",
    """
select instance_id, repo, p.text_inputs as prompt,
 case when coalesce(p.text_inputs, '') = '' then 'No prompt found for instance' end as error
from instances left join prompt_map p using (instance_id)
""",
)
def join_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.instances(spark, sf).select("instance_id", "repo")
    return joins.join_prompts(rows, _prompt_map(spark, sf))


@query(
    "missing_prompts",
    "select instance_id from instances where instance_id not in (select instance_id from prompt_map)",
)
def missing_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return joins.missing_prompts(fx.instances(spark, sf), _prompt_map(spark, sf))


@query(
    "resume_pending",
    """
select instance_id, repo from instances i
where not exists (select 1 from predictions p where p.instance_id = i.instance_id)
""",
)
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.instances(spark, sf).select("instance_id", "repo")
    return joins.resume_pending(rows, fx.predictions(spark, sf))


@query(
    "resume_pending_filtered",
    """
select instance_id, repo, seq from instances i
where not exists (select 1 from predictions p where p.instance_id = i.instance_id)
""",
)
def resume_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same anti-join by a Bloom filter of the finished ids."""
    rows = fx.instances(spark, sf).select("instance_id", "repo", "seq")
    return bloom.without(rows, fx.predictions(spark, sf))


@query(
    "resume_pending_retry_errors",
    """
select instance_id, repo from instances i
where not exists (select 1 from predictions p where p.instance_id = i.instance_id and p.error is null)
""",
)
def resume_retry(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.instances(spark, sf).select("instance_id", "repo")
    return joins.resume_pending(rows, fx.predictions(spark, sf), retry_errors=True)


@query(
    "keep_listed_ids",
    """
select instance_id, repo, seq from instances where instance_id in (select instance_id from predictions where resolved)
""",
)
def keep_listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.instances(spark, sf).select("instance_id", "repo", "seq")
    return joins.keep_listed(rows, fx.predictions(spark, sf).where("resolved"))


@query(
    "split_overlap_check",
    """
select count(*) as common, count(*) = 0 as disjoint from (
 select instance_id from predictions where resolved intersect select instance_id from predictions where not patch_exists)
""",
)
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    graded = fx.predictions(spark, sf)
    return joins.split_overlap(graded.where("resolved"), graded.where(~F.col("patch_exists")))


@query(
    "join_weights",
    """
select v.session_id, v.name, v.score, coalesce(w.weight, 1.0::double) as weight from verdicts v
left join (select concat('v', r_regionkey) as name, (r_regionkey % 3) / 4.0::double as weight from region) w using (name)
""",
)
def weights_joined(spark: SparkSession, sf: str) -> DataFrame:
    return join_weights(fx.verdicts(spark, sf), region_weights(spark, sf)).select(
        "session_id", "name", "score", "weight"
    )


def region_weights(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("r_regionkey")
    return fx.table(spark, sf, "region").select(
        F.concat(F.lit("v"), key.cast("string")).alias("name"), (key % 3 / 4).alias("weight")
    )


def _present_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Images already in the internal registry: those of the labelled documents."""
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("instance_id"))
    name = F.substring_index("image", "/", -1)
    return (
        fx.images(spark, sf)
        .join(labelled, "instance_id", "left_semi")
        .where(F.col("image").isNotNull())
        .select(F.regexp_replace(name, ":latest$", ":v1").alias("target"))
    )


@query(
    "mirror_plan",
    """
with there as (select distinct regexp_replace(split_part(image, '/', 2), ':latest$', ':v1') as target
 from images join labels on instance_id = cast(doc_id as varchar) where image is not null),
wanted as (select distinct image from images where image is not null)
select case when not ends_with(image, ':latest') then 'bad_tag' when t.target is not null then 'skipped'
 else 'to_copy' end as status, count(*) as images
from wanted w left join there t on t.target = regexp_replace(split_part(image, '/', 2), ':latest$', ':v1')
group by 1
""",
)
def mirror_plan(spark: SparkSession, sf: str) -> DataFrame:
    wanted = im.unique_images(fx.images(spark, sf))
    return im.mirror_counts(im.mirror_plan(wanted, _present_targets(spark, sf)))


@query("unique_images", "select distinct image from images where image is not null")
def unique_images(spark: SparkSession, sf: str) -> DataFrame:
    return im.unique_images(fx.images(spark, sf))


@query("failed_images", "select instance_id from images where image is null")
def failed_images(spark: SparkSession, sf: str) -> DataFrame:
    return im.failed_images(fx.images(spark, sf))


@query(
    "images_per_repo",
    """
select regexp_extract(image, 'sweb\\.eval\\.x86_64\\.(.*):[^:]*$', 1) as repo_key, count(distinct image) as images
from images where image is not null group by 1
""",
)
def images_per_repo(spark: SparkSession, sf: str) -> DataFrame:
    return im.images_per_repo(im.unique_images(fx.images(spark, sf)))


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    """Tests an order is expected to pass: lines 1-3 newly, the others still."""
    tests = fx.tests(spark, sf)
    lists = tests.select(
        "instance_id",
        F.when(F.col("line") <= 3, "FAIL_TO_PASS").otherwise("PASS_TO_PASS").alias("kind"),
        "test",
    ).distinct()
    absent = fx.table(spark, sf, "orders").where(F.col("o_orderkey") % 10 == 0).select(
        F.col("o_orderkey").cast("string").alias("instance_id"),
        F.lit("PASS_TO_PASS").alias("kind"),
        F.lit("never run").alias("test"),
    )
    return lists.unionByName(absent)


@query(
    "test_status_grade",
    """
with expected as (
 select distinct instance_id, case when line <= 3 then 'FAIL_TO_PASS' else 'PASS_TO_PASS' end as kind, test from tests
 union all select cast(o_orderkey as varchar), 'PASS_TO_PASS', 'never run' from orders where o_orderkey % 10 = 0),
judged as (
 select e.instance_id, e.kind, exists (select 1 from tests t where t.instance_id = e.instance_id
  and t.test = e.test and t.status = 'PASSED') as ok from expected e),
summed as (
 select instance_id, min(ok::int) as all_ok, count(*) filter (ok and kind = 'FAIL_TO_PASS') as f2p_passed,
  count(*) filter (kind = 'FAIL_TO_PASS') as f2p_total, count(*) filter (ok and kind = 'PASS_TO_PASS') as p2p_passed,
  count(*) filter (kind = 'PASS_TO_PASS') as p2p_total from judged group by instance_id),
applied as (
 select cast(o_orderkey as varchar) as instance_id, o_orderkey % 13 <> 0 as patch_exists,
  o_orderkey % 13 <> 0 and o_orderpriority <> '5-LOW' as fits,
  case when o_orderkey % 17 = 0 then 'log unreadable' end as error from orders)
select a.instance_id, a.error is null and patch_exists and fits and coalesce(all_ok, 1) = 1 as resolved, patch_exists,
 fits and error is null as patch_successfully_applied, coalesce(f2p_passed, 0) as f2p_passed,
 coalesce(f2p_total, 0) as f2p_total, coalesce(p2p_passed, 0) as p2p_passed, coalesce(p2p_total, 0) as p2p_total, error
from applied a left join summed s using (instance_id)
""",
)
def test_status_grade(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    exists = key % 13 != 0
    applied = fx.table(spark, sf, "orders").select(
        key.cast("string").alias("instance_id"),
        exists.alias("patch_exists"),
        (exists & (F.col("o_orderpriority") != "5-LOW")).alias("patch_successfully_applied"),
        F.when(key % 17 == 0, "log unreadable").alias("error"),
    )
    statuses = fx.tests(spark, sf).select("instance_id", "test", "status")
    return joins.test_status_grade(_expected(spark, sf), statuses, applied)


@query(
    "merge_predictions",
    """
select p.instance_id, case when d.doc_id % 7 = 0 then '' else d.source end as model_patch,
 case when d.doc_id % 5 = 0 then 'unknown' else 'm1' end as model_name_or_path
from predictions p join documents d on cast(d.doc_id as varchar) = p.instance_id
""",
)
def merged(spark: SparkSession, sf: str) -> DataFrame:
    stored = fx.predictions(spark, sf).join(
        fx.instances(spark, sf).select("instance_id", "repo", "seq"), "instance_id"
    ).select(
        "instance_id",
        F.when(F.col("patch_exists"), F.col("repo")).alias("model_patch"),
        F.when(F.col("seq") % 5 != 0, "m1").alias("model_name_or_path"),
    )
    return merge_predictions(fx.instances(spark, sf), stored)


@query(
    "union_batches",
    """
select instance_id, resolved, error, null::varchar as prediction from predictions
union all
select concat('b', item_id), null::boolean, null::varchar, text from benchmark
""",
)
def union_batches(spark: SparkSession, sf: str) -> DataFrame:
    graded = fx.predictions(spark, sf).select("instance_id", "resolved", "error")
    written = fx.table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("instance_id"),
        F.col("text").alias("prediction"),
    )
    return sets.union_batches([graded, None, written])


@query(
    "completed_diff",
    "select instance_id from instances except select instance_id from predictions",
)
def completed_diff(spark: SparkSession, sf: str) -> DataFrame:
    return sets.completed_diff(fx.instances(spark, sf), fx.predictions(spark, sf))


@query(
    "dedup_results_by_name",
    """
select session_id, name, case name when 'v3' then 0 when 'v1' then 1 else 2 end as set_order, status, score from (
 select cast(l_orderkey as varchar) as session_id, concat('v', l_linenumber) as name,
  case when l_returnflag = 'R' then 'error' else 'ok' end as status, l_discount + 0.0 as score,
  row_number() over (partition by l_orderkey, l_linenumber
   order by l_partkey desc, l_suppkey desc, l_extendedprice desc) as rn
 from lineitem where l_linenumber in (1, 2, 3)) where rn = 1
""",
)
def dedup_results(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated (order, line) pairs are repeated verdicts of one verifier."""
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"),
        (F.col("l_discount") + 0.0).alias("score"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    return latest_verdicts(rows, ["v3", "v1", "v2"], "seq")


@query(
    "bucketed_joins",
    """
select i.instance_id, i.repo, p.text_inputs as prompt, case when p.text_inputs is null then 'No prompt found for instance' end as error,
 g.resolved, g.instance_id is not null as done
from instances i left join prompt_map p on p.instance_id = i.instance_id left join predictions g on g.instance_id = i.instance_id
""",
)
def bucketed_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts and grades joined to the instances, all three stored once by buckets."""
    tables = {
        "instances": fx.instances(spark, sf).select("instance_id", "repo"),
        "prompts": _prompt_map(spark, sf),
        "graded": fx.predictions(spark, sf).select("instance_id", "resolved").withColumn("done", F.lit(True)),
    }
    stored = {}
    for name, rows in tables.items():
        path = work_path(spark, f"buckets-{name}")
        buckets.write_buckets(rows, path, 8)
        stored[name] = buckets.read_buckets(spark, path, 8, rows.schema)
    with_prompts = joins.join_prompts(stored["instances"], stored["prompts"])
    return with_prompts.join(stored["graded"], "instance_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
