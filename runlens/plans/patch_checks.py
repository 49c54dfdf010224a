"""Queries that take patches apart and check their syntax."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.apply_patch import apply_patches
from runlens.operators.hunks import explode_hunks, patch_files
from runlens.operators.syntax import (
    error_snippet,
    syntax_checked,
    syntax_errors,
    syntax_feedback,
    syntax_reports,
    syntax_verdicts,
    whole_file_verdicts,
)
from runlens.operators.verifiers import verifier
from runlens.plans.registry import query
from runlens.sources import fixtures as fx

# Lines of new-file content found with windows over the lines of all patches.
HUNK_ROWS = r"""
marked as (
 select doc_id, pos, line, starts_with(line, '+++ ') as is_file,
  regexp_replace(substr(line, 5), '^b/', '') as path,
  sum(case when starts_with(line, '+++ ') then 1 else 0 end)
   over (partition by doc_id order by pos rows unbounded preceding) as sec
 from patch_lines),
bare as (select * from marked where is_file or not starts_with(line, '--- ')),
heads as (
 select *, sum(case when not is_file and starts_with(line, '@@') then 1 else 0 end)
  over (partition by doc_id, sec order by pos rows unbounded preceding) as hk from bare where sec > 0),
ended as (
 select *, max(case when hk > 0 and not starts_with(line, '@@') and not is_file
   and (starts_with(line, '+++') or left(line, 1) not in ('+', ' ', '-', chr(92)))
   then 1 else 0 end) over (partition by doc_id, sec order by pos rows unbounded preceding) as over_,
  max(path) filter (is_file) over (partition by doc_id, sec) as file from heads),
cut as (
 select doc_id, sec, max(over_) as lost, max(hk) filter (over_ = 0) as last_hk from ended group by doc_id, sec),
live as (
 select e.* from ended e join cut c using (doc_id, sec)
 where over_ = 0 and hk > 0 and not (c.lost = 1 and e.hk = c.last_hk)),
body as (
 select doc_id, sec, hk, pos, file, left(line, 1) as prefix, substr(line, 2) as text,
  first_value(line) over (partition by doc_id, sec, hk order by pos) as head
 from live),
recs as (
 select *, row_number() over (partition by doc_id, sec, hk order by pos) as line_no
 from body where prefix in ('+', ' ') and not (prefix = '@')),
python_files as (
 select doc_id, sec, path as file, row_number() over (partition by doc_id order by pos) - 1 as file_no
 from marked where is_file and ends_with(path, '.py')),
chosen as (
 select f.doc_id, f.file_no, f.file, max(s.sec) as sec from python_files f
 join marked s on s.doc_id = f.doc_id and s.is_file and (s.path = f.file or ends_with(s.path, concat('/', f.file)))
 group by f.doc_id, f.file_no, f.file),
hunk_rows as (
 select c.doc_id, c.file_no, c.file, dense_rank() over (partition by c.doc_id, c.file_no order by r.hk) - 1 as hunk_no,
  coalesce(try_cast(nullif(regexp_extract(r.head, '@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@', 1), '') as int), 1) as new_start,
  r.line_no, r.prefix, r.text
 from chosen c join recs r on r.doc_id = c.doc_id and r.sec = c.sec)
"""


@query(
    "explode_hunks",
    f"""
, {HUNK_ROWS.strip()}
select doc_id, file_no, file, hunk_no, new_start, line_no, prefix, text from hunk_rows
""",
)
def hunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = explode_hunks(fx.patches(spark, sf), "doc_id")
    return rows.select(
        "doc_id",
        F.col("file_no").cast("bigint").alias("file_no"),
        "file",
        F.col("hunk_no").cast("bigint").alias("hunk_no"),
        "new_start",
        F.col("line_no").cast("bigint").alias("line_no"),
        "prefix",
        "text",
    )


# What the parser must find in the code patches: a hunk is lost when the git
# header of the text file follows it, all others are parsed.
BROKEN = r"""
d as (select doc_id, n_chars, length(text) - length(replace(text, chr(10), '')) as breaks,
  doc_id % 7 = 0 and not (doc_id % 2 = 1 and doc_id % 5 = 0) as bad_f,
  doc_id % 6 = 0 and doc_id % 5 <> 0 as bad_g, doc_id % 2 = 0 as has_g from documents),
found as (
 select doc_id, 0 as file_no, 'src/f.py' as file, breaks + 4 as line, 5 as "offset", 'invalid syntax' as message,
  concat('        ', printf('%4d', breaks + 2), ' + def f():', chr(10), '        ', printf('%4d', breaks + 3),
   ' +     return ', n_chars, chr(10), '    --> ', printf('%4d', breaks + 4), ' + x = = 1') as snippet
 from d where bad_f
 union all
 select doc_id, 1, 'src/g.py', 6, 12, '''' || '(' || '''' || ' was never closed',
  concat('           5       def g(a):', chr(10), '    -->    6 +         return (a') from d where bad_g)
"""


@query(
    "syntax_check",
    f"""
with {BROKEN.strip()}
select doc_id, file_no, file, 0 as hunk_no, line, "offset", message, snippet from found
""",
)
def syntax_check(spark: SparkSession, sf: str) -> DataFrame:
    checked = syntax_checked(fx.code_patches(spark, sf))
    return syntax_errors(checked, "doc_id")


@query(
    "syntax_score",
    f"""
with {BROKEN.strip()},
s as (select doc_id, 1 + has_g::int as files, bad_f::int + bad_g::int as errored from d)
select doc_id, 'ast_check' as name, 'ok' as status, (files - errored) / files::double as score,
 1.0::double as pass_threshold, files::bigint as files_total, files::bigint as files_checkable,
 (files - errored)::bigint as files_parsed, 0::bigint as files_skipped, errored::bigint as files_errored from s
""",
)
def syntax_score(spark: SparkSession, sf: str) -> DataFrame:
    return syntax_verdicts(syntax_checked(fx.code_patches(spark, sf)), "doc_id").drop("errors")


@query(
    "error_snippet",
    f"""
, {HUNK_ROWS.strip()},
sized as (select *, max(line_no) over (partition by doc_id, file_no, hunk_no) as n,
 1 + doc_id % 4 as at_line from hunk_rows)
select doc_id, file_no, hunk_no, string_agg(concat('    ', case when line_no = at_line then '-->' else '   ' end, ' ',
  printf('%4d', line_no + new_start - 1), ' ', prefix, ' ', text), chr(10) order by line_no) as snippet
from sized where at_line <= n and line_no between at_line - 2 and at_line + 1
group by doc_id, file_no, hunk_no
""",
)
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Snippet around a chosen line of every hunk that is long enough."""
    files = fx.patches(spark, sf).select(
        "doc_id", F.posexplode(patch_files(F.col("patch_diff"))).alias("file_no", "f")
    )
    hunks = files.select("doc_id", "file_no", F.posexplode("f.hunks").alias("hunk_no", "h"))
    at = (1 + F.col("doc_id") % 4).cast("int")
    text = error_snippet(F.col("h.records"), at, F.col("h.new_start") - 1)
    return hunks.select(
        "doc_id",
        F.col("file_no").cast("bigint").alias("file_no"),
        F.col("hunk_no").cast("bigint").alias("hunk_no"),
        text.alias("snippet"),
    ).where(F.col("snippet").isNotNull())


@query(
    "syntax_feedback",
    f"""
with {BROKEN.strip()},
told as (select doc_id, string_agg(concat('  - ', file, ': line ', line, ', offset ', "offset", ': ', message, chr(10), snippet),
  chr(10) order by file_no) as report from found group by doc_id)
select doc_id, case when report is null then '[ast_check] PASSED: no syntax errors detected'
 else concat('[ast_check] FAILED: syntax errors in the following files:', chr(10), report) end as feedback
from d left join told using (doc_id)
""",
)
def feedback(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = syntax_verdicts(syntax_checked(fx.code_patches(spark, sf)), "doc_id")
    return syntax_feedback(verdicts).select("doc_id", "feedback")


@query(
    "syntax_free_text",
    """
select doc_id, 'ast_check' as name, true as consistent, (1 + (doc_id % 2 = 0)::int)::bigint as files_total,
 (1 + (doc_id % 2 = 0)::int)::bigint as files_checkable, 0::bigint as files_skipped from documents
""",
)
def free_text(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of prose: the parser reads every text; its verdict must agree with its own counts."""
    verdicts = syntax_verdicts(syntax_checked(fx.patches(spark, sf)), "doc_id")
    share = (F.col("files_checkable") - F.col("files_errored")) / F.col("files_checkable")
    consistent = F.when(F.col("status") == "error", F.col("score") == 0).otherwise(
        (F.col("status") == "ok") & (F.col("score") == share) & (F.col("files_errored") <= F.col("files_checkable"))
    )
    return verdicts.select(
        "doc_id", "name", consistent.alias("consistent"), "files_total", "files_checkable", "files_skipped"
    )


@query("syntax_free_text_verdicts")
def free_text_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What the parser says to each patch of prose; no SQL can say it, a test compares it with a plain parse."""
    verdicts = syntax_verdicts(syntax_checked(fx.patches(spark, sf)), "doc_id")
    return verdicts.select("doc_id", "name", "status", "score", "files_checkable", "files_parsed", "files_errored")


# What the patches of the stored files must lead to, from the documents alone. Hunk by hunk, the
# broken hunk is lost where a git header follows it.
STORED = r"""
d as (select doc_id, source, n_chars, doc_id % 6 as kind, doc_id % 11 = 0 as note, doc_id % 2 = 0 and doc_id % 11 <> 0 as common,
  translate(text, '"' || chr(92), '''/') as body,
  length(text) - length(replace(text, chr(10), '')) + 1 as k from documents),
t as (select *, not note and (kind = 2 or kind = 4 and not common) as bad, concat('pkg/m', doc_id, '.py') as path,
  case kind when 0 then concat('def f():', chr(10), concat('    ', repeat(chr(34), 3), 'doc of'), chr(10), '    more', chr(10), body, chr(10), concat('    ', repeat(chr(34), 3)), chr(10), '    return ', n_chars, ' + 1', chr(10))
   when 1 then concat('def f():', chr(10), concat('    ', repeat(chr(34), 3), 'doc'), chr(10), body, chr(10), concat('    ', repeat(chr(34), 3)), chr(10), '    return ', n_chars, ' + 1', chr(10))
   when 2 then concat('def f():', chr(10), concat('    ', repeat(chr(34), 3), 'doc'), chr(10), body, chr(10), concat('    ', repeat(chr(34), 3)), chr(10), '    return (', chr(10))
   when 5 then concat(repeat(chr(34), 3), chr(10), body, chr(10), repeat(chr(34), 3), chr(10), 'N = ', n_chars, chr(10)) end as own_text from d)
"""


@query(
    "apply_patches",
    f"""
with {STORED.strip()}
select doc_id, 0 as file_no, path, case kind when 3 then 'rejected' when 4 then 'missing' when 5 then 'created' else 'modified' end as outcome,
 kind not in (3, 4) as whole, case kind when 0 then '0,0' when 1 then '-7' when 3 then 'none' when 4 then null else '0' end as moves,
 sha256(own_text) as text_sha256 from t where not note
union all
select doc_id, 1, 'pkg/common.py', 'modified', kind not in (3, 4), '0',
 sha256(concat('A = 1', chr(10), 'B = ', doc_id, chr(10), 'C = 3', chr(10), 'D = 4', chr(10), 'E = 5', chr(10))) from t where common
union all
select doc_id, 0, 'n.txt', 'created', true, '0', sha256('note' || chr(10)) from t where note
""",
)
def applied(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each file of each patch."""
    rows = apply_patches(fx.stored_patches(spark, sf), fx.stored_files(spark, sf), "doc_id")
    return rows.select("doc_id", "whole", F.explode("sections").alias("s")).select(
        "doc_id",
        "s.file_no",
        "s.path",
        "s.outcome",
        "whole",
        F.array_join("s.moves", ",", "none").alias("moves"),
        F.sha2("s.new_text", 256).alias("text_sha256"),
    )


@query(
    "syntax_whole_files",
    f"""
with {STORED.strip()},
s as (select doc_id, case when note then 0 else 1 + common::int end as files,
 case when bad then 1 else 0 end as errored, kind in (3, 4) and not note as by_hunk from t)
select doc_id, 'ast_check' as name, case when files = 0 then 'skipped' else 'ok' end as status,
 coalesce((files - errored) / nullif(files, 0)::double, 1.0::double) as score, 1.0::double as pass_threshold,
 files::bigint as files_total, files::bigint as files_checkable, (files - errored)::bigint as files_parsed,
 0::bigint as files_skipped, errored::bigint as files_errored, case when by_hunk then 'hunk' else 'full_file' end as method from s
""",
)
def whole_files(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = whole_file_verdicts(fx.stored_patches(spark, sf), fx.stored_files(spark, sf), "doc_id")
    return verdicts.drop("errors")


@query(
    "syntax_whole_file_errors",
    f"""
with {STORED.strip()}
select doc_id, path as file, (case kind when 2 then k + 4 else 2 end)::int as line, 12 as "offset", '''' || '(' || '''' || ' was never closed' as message,
 case kind when 2 then concat('        ', printf('%4d', k + 2), '   ', string_split(body, chr(10))[k], chr(10),
   '        ', printf('%4d', k + 3), '       ', repeat(chr(34), 3), chr(10), '    --> ', printf('%4d', k + 4), '       return (')
  else concat('           1   def f():', chr(10), '    -->    2 +     return (') end as snippet
from t where bad
""",
)
def whole_file_errors(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = whole_file_verdicts(fx.stored_patches(spark, sf), fx.stored_files(spark, sf), "doc_id")
    return syntax_reports(verdicts, "doc_id").select("doc_id", "file", "line", "offset", "message", "snippet")


def _count_lines(row: dict) -> float:
    """A check that fails on some rows in the ways a check can fail."""
    if row["doc_id"] % 499 == 0:
        time.sleep(60)
    if row["doc_id"] % 17 == 0:
        raise ValueError(f"no verdict on {row['doc_id']}")
    return min(1.0, (row["text"] or "").count("\n") / 8)


@query(
    "verifier_harness",
    """
select doc_id, 'line_check' as name, case when doc_id % 499 = 0 then 'timeout' when doc_id % 17 = 0 then 'error' else 'ok' end as status,
 case when doc_id % 499 = 0 or doc_id % 17 = 0 then 0.0::double else score end as score, 0.5::double as pass_threshold,
 doc_id % 499 <> 0 and doc_id % 17 <> 0 and score >= 0.5 as passed,
 case when doc_id % 499 = 0 then null when doc_id % 17 = 0 then concat('ValueError: no verdict on ', doc_id) end as error
from (select doc_id, least(1.0::double, (length(text) - length(replace(text, chr(10), ''))) / 8.0::double) as score from documents)
""",
)
def verifier_harness(spark: SparkSession, sf: str) -> DataFrame:
    """A check over whole texts that raises on some documents and never comes back on others."""
    check = verifier("line_check", _count_lines, key="doc_id", timeout=1.0, pass_threshold=0.5)
    verdicts = check(fx.table(spark, sf, "documents").select("doc_id", "text").asTable())
    said = F.concat_ws(": ", F.col("details")["error_type"], F.col("details")["error"])
    return verdicts.select(
        "doc_id", "name", "status", "score", "pass_threshold", "passed", F.when(F.col("status") == "error", said).alias("error")
    )
