"""Text extraction and projection queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import actions, answers, patches, prompts, sections
from runlens.operators.joins import select_prompt
from runlens.plans.registry import query
from runlens.sources import fixtures as fx
from runlens.sources.readers import load_prompt_map, parse_label

STRIP = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query(
    "parse_label_json",
    """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events
""",
)
def parse_label_json(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table(spark, sf, "events")
    return events.select("event_id", parse_label(F.col("props"), "k bigint").alias("p")).select(
        "event_id", "p.k"
    )


@query(
    "strip_prompt_prefix",
    """
select doc_id, case when starts_with(q, prompt) then substr(q, length(prompt) + 1) else q end as response
from (select doc_id, prompt, case when doc_id % 3 = 0 then response else concat(prompt, response) end as q
 from responses)
""",
)
def strip_prompt_prefix(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.responses(spark, sf)
    full = F.when(F.col("doc_id") % 3 == 0, F.col("response")).otherwise(
        F.concat("prompt", "response")
    )
    return rows.withColumn("q", full).select(
        "doc_id", answers.strip_prompt_prefix(F.col("q"), F.col("prompt")).alias("response")
    )


@query("extract_answer", "select doc_id, answer from extracted")
def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    return fx.responses(spark, sf).select(
        "doc_id", answers.extract_answer(F.col("response")).alias("answer")
    )


def _numeral() -> Column:
    n = F.col("n_chars").cast("string")
    which = F.col("doc_id") % 8
    return (
        F.when(which == 0, n)
        .when(which == 1, F.concat(n, F.lit("d")))
        .when(which == 2, F.concat(F.lit(" \t"), n, F.lit(" \n")))
        .when(which == 3, F.concat(F.lit("1,"), n))
        .when(which == 4, F.concat(F.lit("-"), n, F.lit(".5e1")))
        .when(which == 5, F.concat(F.lit("0x"), n))
        .when(which == 6, F.concat(F.lit("1_0"), n))
        .otherwise(F.col("lang"))
    )


@query(
    "normalize_number",
    """
select doc_id, case doc_id % 8 when 0 then n_chars::double when 2 then n_chars::double
 when 3 then cast(concat('1', n_chars) as double) when 4 then -(n_chars + 0.5::double) * 10
 when 6 then cast(concat('10', n_chars) as double) end as number
from documents
""",
)
def normalize_number(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents").select("doc_id", _numeral().alias("numeral"))
    return docs.select("doc_id", answers.normalize_number(F.col("numeral")).alias("number"))


@query(
    "parse_tool_call",
    f"""
with t as (select doc_id, action, strpos(action, '<bash>') as b,
  strpos(action, regexp_extract(action, '<submit\\s*/>')) as s0,
  regexp_matches(action, '<submit\\s*/>') as has_s,
  regexp_extract(action, '(?s)<bash>(.*?)</bash>', 1) as inner_text,
  regexp_matches(action, '(?s)<bash>.*?</bash>') as has_b from actions),
u as (select *, case when has_s and has_b then s0 < b when has_s then true when has_b then false
  else trim(action, {STRIP}) = '' end as submits from t)
select doc_id, case when submits then 'submit' else 'bash' end as type,
 case when submits then '' when has_b then trim(inner_text, {STRIP}) else trim(action, {STRIP}) end as content
from u
""",
)
def parse_tool_call(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fx.actions(spark, sf)
        .select("doc_id", actions.parse_tool_call(F.col("action")).alias("call"))
        .select("doc_id", "call.type", "call.content")
    )


@query(
    "submission_sentinel",
    f"""
select doc_id, case when contains(stdout, 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT')
 then trim(substr(stdout, strpos(stdout, 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT') + 37), {STRIP}) end as patch
from outputs
""",
)
def submission_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    return fx.outputs(spark, sf).select(
        "doc_id", actions.submission_sentinel(F.col("stdout")).alias("patch")
    )


@query(
    "format_observation",
    """
select doc_id, case when length(stdout) <= 601 then
  concat('<returncode>', returncode, '</returncode>', chr(10), '<output>', chr(10), stdout, chr(10), '</output>')
 else concat('<returncode>', returncode, '</returncode>', chr(10),
  '<warning>Output too long. Use head/tail/grep to get smaller output.</warning>', chr(10),
  '<output_head>', chr(10), left(stdout, 300), chr(10), '</output_head>', chr(10),
  '<elided_chars>', length(stdout) - 601, ' characters elided</elided_chars>', chr(10),
  '<output_tail>', chr(10), right(stdout, 300), chr(10), '</output_tail>') end as observation
from outputs
""",
)
def format_observation(spark: SparkSession, sf: str) -> DataFrame:
    block = actions.format_observation(F.col("stdout"), F.col("returncode"), max_chars=601)
    return fx.outputs(spark, sf).select("doc_id", block.alias("observation"))


@query(
    "extract_fenced_code",
    """
with t as (select doc_id, answer, strpos(answer, '```python') as o,
 substr(answer, strpos(answer, '```python') + 9) as rest from answers)
select doc_id, case when o = 0 then answer when contains(rest, '```') then substr(rest, 1, strpos(rest, '```') - 1)
 else rest end as code from t
""",
)
def extract_fenced_code(spark: SparkSession, sf: str) -> DataFrame:
    return fx.answers(spark, sf).select(
        "doc_id", sections.extract_fenced_code(F.col("answer")).alias("code")
    )


@query(
    "extract_diff",
    f"""
select doc_id, coalesce(
 nullif(regexp_extract(answer, '(?s)<patch>(.*?)</patch>', 1), ''),
 nullif(regexp_extract(answer, '(?s)<diff>(.*?)</diff>', 1), ''),
 nullif(regexp_extract(answer, '(?s)```diff\\n(.*?)```', 1), ''),
 trim(answer, {STRIP})) as diff from answers
""",
)
def extract_diff(spark: SparkSession, sf: str) -> DataFrame:
    return fx.answers(spark, sf).select(
        "doc_id", sections.extract_diff(F.col("answer")).alias("diff")
    )


@query(
    "extract_section",
    f"""
with t as (select page_id, html, strpos(html, '<title>') as s, strpos(html, '</title>') as e from pages)
select page_id, case when s > 0 and e > s + 7 then trim(substr(html, s + 7, e - s - 7), {STRIP}) else '' end as section
from t
""",
)
def extract_section(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "pages").select(
        "page_id",
        sections.extract_section(F.col("html"), "<title>", "</title>").alias("section"),
    )


@query(
    "extract_keyed_prediction",
    """
select case when doc_id % 5 = 1 then 'x' else cast(doc_id as varchar) end as instance_id,
 case doc_id % 5 when 0 then 'own ' || source when 1 then 'other ' || lang else '' end as model_patch,
 'm1' as model_name_or_path from documents
""",
)
def extract_keyed_prediction(spark: SparkSession, sf: str) -> DataFrame:
    found = sections.extract_keyed_prediction(F.col("log"), F.col("instance_id"), F.lit("m1"))
    return fx.job_logs(spark, sf).select(found.alias("p")).select("p.*")


@query(
    "extract_return_code",
    f"""
with t as (select doc_id, stdout, regexp_extract(stdout, '__RC_8372916__:(\\d+)\\n?') as mark,
 regexp_extract(stdout, '__RC_8372916__:(\\d+)\\n?', 1) as code from outputs)
select doc_id, case when mark = '' then stdout else trim(concat(substr(stdout, 1, strpos(stdout, mark) - 1),
  substr(stdout, strpos(stdout, mark) + length(mark))), {STRIP}) end as output,
 case when mark = '' then -1 else cast(code as bigint) end as exit_code from t
""",
)
def extract_return_code(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fx.outputs(spark, sf)
        .select("doc_id", actions.extract_return_code(F.col("stdout")).alias("r"))
        .select("doc_id", "r.output", "r.exit_code")
    )


@query(
    "changed_files",
    """
select doc_id, count(*) as n_files, string_agg(regexp_replace(substr(line, 5), '^b/', ''), ',' order by pos) as files
from patch_lines where starts_with(line, '+++ ') and substr(line, 5) <> '/dev/null' group by doc_id
""",
)
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return fx.patches(spark, sf).select(
        "doc_id", patches.changed_files(F.col("patch_diff")).alias("f")
    ).select(
        "doc_id",
        F.size("f").cast("bigint").alias("n_files"),
        F.array_join("f", ",").alias("files"),
    )


@query(
    "patch_stats",
    """
select doc_id, count(*) - 1 as patch_lines,
 count(distinct case when starts_with(line, 'diff --git ') then regexp_extract(line, '^.*? b/(.*)$', 1) end) as files_changed,
 false as empty_patch from patch_lines group by doc_id
""",
)
def patch_stats(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fx.patches(spark, sf)
        .select("doc_id", patches.patch_stats(F.col("patch_diff")).alias("s"))
        .select(
            "doc_id",
            F.col("s.patch_lines").cast("bigint").alias("patch_lines"),
            F.col("s.files_changed").cast("bigint").alias("files_changed"),
            "s.empty_patch",
        )
    )


@query(
    "render_template",
    """
select instance_id, concat('Repo ', repo, chr(10), problem_statement, ' {open} ', instance_id, repo) as prompt
from instances
""",
)
def render_template(spark: SparkSession, sf: str) -> DataFrame:
    text = prompts.render_template(
        "Repo {repo}\n{problem} {open} {tail}",
        {
            "problem": F.col("problem_statement"),
            "tail": F.concat("instance_id", F.lit("{repo}")),
            "repo": F.col("repo"),
        },
    )
    return fx.instances(spark, sf).select("instance_id", text.alias("prompt"))


@query(
    "build_chat_prompt",
    """
select instance_id, concat('<|im_start|>user', chr(10), problem_statement, '<|im_end|>', chr(10),
 '<|im_start|>assistant', chr(10)) as prompt from instances
""",
)
def build_chat_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return fx.instances(spark, sf).select(
        "instance_id", prompts.build_chat_prompt(F.col("problem_statement")).alias("prompt")
    )


@query(
    "split_system_user",
    """
select instance_id, case when contains(problem_statement, chr(10)) then 2 else 1 end::bigint as messages,
 case when contains(problem_statement, chr(10)) then split_part(problem_statement, chr(10), 1) else '' end as system_text,
 case when contains(problem_statement, chr(10)) then substr(problem_statement, strpos(problem_statement, chr(10)) + 1)
  else problem_statement end as user_text
from instances
""",
)
def split_system_user(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.instances(spark, sf).select(
        "instance_id", prompts.split_system_user(F.col("problem_statement")).alias("m")
    )

    def content(role: str) -> Column:
        spoken = F.filter("m", lambda m: m["role"] == role)
        return F.coalesce(F.get(F.transform(spoken, lambda m: m["content"]), F.lit(0)), F.lit(""))

    return rows.select(
        "instance_id",
        F.size("m").cast("bigint").alias("messages"),
        content("system").alias("system_text"),
        content("user").alias("user_text"),
    )


@query(
    "model_slug",
    """
select doc_id, case when doc_id % 2 = 0 then concat(lang, '-', doc_id, '-b') else concat(source, '-x', doc_id) end as slug
from documents
""",
)
def model_slug(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit("Org.A/"), F.upper("lang"), F.lit("."), F.col("doc_id"), F.lit(".B/tail")),
    ).otherwise(F.concat(F.upper("source"), F.lit(".X"), F.col("doc_id")))
    return fx.table(spark, sf, "documents").select(
        "doc_id", prompts.model_slug(name).alias("slug")
    )


@query(
    "rewrite_image_ref",
    """
select instance_id, concat('registry:5000/ns/', regexp_replace(split_part(image, '/', 2), ':latest$', ':v1')) as image
from images where image is not null
""",
)
def rewrite_image_ref(spark: SparkSession, sf: str) -> DataFrame:
    images = fx.images(spark, sf).where(F.col("image").isNotNull())
    return images.select(
        "instance_id", prompts.rewrite_image_ref(F.col("image"), "registry:5000/ns").alias("image")
    )


def _dataset_name() -> Column:
    which = F.col("doc_id") % 4
    return (
        F.when(which == 0, F.lit("princeton-nlp/SWE-bench_Verified"))
        .when(which == 1, F.lit("SWE-bench/SWE-smith"))
        .when(which == 2, F.lit("nebius/SWE-rebench"))
        .otherwise(F.concat(F.lit("org/"), F.col("source")))
    )


@query(
    "dataset_alias",
    """
select doc_id, case doc_id % 4 when 0 then 'verified' when 1 then 'smith' when 2 then 'rebench'
 else concat('org/', source) end as subset,
 case when doc_id % 4 = 0 then 'test' else 'train' end as split from documents
""",
)
def dataset_alias(spark: SparkSession, sf: str) -> DataFrame:
    named = fx.table(spark, sf, "documents").select("doc_id", _dataset_name().alias("name"))
    return named.select(
        "doc_id",
        prompts.dataset_alias(F.col("name")).alias("subset"),
        prompts.default_split(F.col("name")).alias("split"),
    )


@query(
    "classify_exec_result",
    """
select doc_id as task_id, quality = 1 and toxic <> 1 as passed,
 case when toxic = 1 then 'timed out' when quality = 0 then concat('failed: check ', doc_id) else 'passed' end as result
from labels
""",
)
def classify_exec_result(spark: SparkSession, sf: str) -> DataFrame:
    failure = F.when(F.col("quality") == 0, F.concat(F.lit("check "), F.col("doc_id")))
    rows = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("task_id"),
        actions.classify_exec_result(F.col("toxic") == 1, failure).alias("result"),
    )
    return rows.select("task_id", (F.col("result") == "passed").alias("passed"), "result")


@query(
    "select_prompt_source",
    """
select instance_id, case when i.seq % 2 = 0 then i.problem_statement else p.text_inputs end as prompt,
 case when i.seq % 2 = 1 and p.text_inputs is null then 'No prompt found for instance' end as error
from instances i left join prompt_map p using (instance_id)
""",
)
def select_prompt_source(spark: SparkSession, sf: str) -> DataFrame:
    """Even rows carry their own prompt, odd rows are looked up in the map."""
    rows = fx.instances(spark, sf)
    own = rows.where(F.col("seq") % 2 == 0).select(
        "instance_id", select_prompt(F.col("problem_statement")).alias("s")
    )
    mapped = (
        rows.where(F.col("seq") % 2 == 1)
        .join(load_prompt_map(fx.prompts(spark, sf)), "instance_id", "left")
        .select(
            "instance_id",
            select_prompt(F.col("problem_statement"), F.col("text_inputs")).alias("s"),
        )
    )
    return own.unionByName(mapped).select("instance_id", "s.prompt", "s.error")


@query(
    "tail_excerpt",
    """
select doc_id, case when length(stdout) = 0 then '' when length(stdout) < 4000
 then concat(chr(10), '  Test output:', chr(10), '  ', replace(stdout, chr(10), concat(chr(10), '  ')))
 else concat(chr(10), '  Test output (last 3000 chars):', chr(10), '  ',
  replace(right(stdout, 3000), chr(10), concat(chr(10), '  '))) end as excerpt from outputs
""",
)
def tail_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return fx.outputs(spark, sf).select(
        "doc_id", actions.tail_excerpt(F.col("stdout")).alias("excerpt")
    )
