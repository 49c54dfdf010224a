"""The fixture entities in ANSI SQL, written apart from the Spark expressions."""

from __future__ import annotations

import re

VIEWS = {
    "runs": """
select cast(o.o_custkey as varchar) as instance_id, n.n_name as repo, o.o_orderkey as run_id,
 o.o_orderstatus = 'F' as resolved, cast(coalesce(l.n, 0) as int) as steps,
 cast(floor(coalesce(l.q, 0)) as bigint) as total_tokens, o.o_totalprice as wall_clock_seconds,
 case o.o_orderpriority when '1-URGENT' then 'submit' when '2-HIGH' then 'max_steps'
  when '3-MEDIUM' then 'token_limit' when '5-LOW' then 'error' end as reason,
 row_number() over (partition by o.o_custkey order by o.o_orderkey) - 1 as run_idx
from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey
left join (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by l_orderkey) l
 on l.l_orderkey = o.o_orderkey""",
    "all_instances": """
select cast(c_custkey as varchar) as instance_id, n_name as repo
from customer join nation on c_nationkey = n_nationkey""",
    "rollup_view": """
select i.instance_id, i.repo, count(r.run_id) as n_runs,
 coalesce(sum(case when r.resolved then 1 else 0 end), 0)::bigint as n_resolved,
 coalesce(avg(case when r.run_id is null then null when r.resolved then 1.0::double else 0.0::double end), 0.0) as resolve_rate,
 coalesce(sum(r.steps)::double / nullif(count(r.run_id), 0), 0.0) as avg_steps,
 coalesce(sum(r.total_tokens)::double / nullif(count(r.run_id), 0), 0.0) as avg_tokens
from all_instances i left join runs r using (instance_id) group by i.instance_id, i.repo""",
    "verdicts": """
select cast(l_orderkey as varchar) as session_id, concat('v', cast(l_linenumber as varchar)) as name,
 case min(l_returnflag) when 'R' then 'error' else 'ok' end as status,
 round(least(1.0, greatest(0.0, max(l_discount) * 10)), 4) + 0.0 as score,
 cast(0.5 as double) as pass_threshold
from lineitem group by l_orderkey, l_linenumber""",
    "effective": """
select session_id, name, case when status = 'ok' then score else 0.0 end as eff,
 status = 'ok' and score >= pass_threshold as passed from verdicts""",
    "sessions": "select cast(o_orderkey as varchar) as session_id from orders",
    "responses": """
select doc_id, source, text as prompt, concat('#### ', cast(n_chars as varchar)) as label,
 case doc_id % 5 when 0 then concat('so #### ', cast(n_chars as varchar))
 when 1 then concat('so ', chr(92), 'boxed{', cast(n_chars as varchar), '}')
 when 2 then concat('the total is ', cast(n_chars as varchar))
 when 3 then concat('the total is ', cast(n_chars + 1 as varchar)) else 'no answer' end as response
from documents""",
    "extracted": r"""
select *, coalesce(
  trim(regexp_extract_all(response, '\\boxed\{([^}]+)\}', 1)[-1]),
  replace(regexp_extract_all(response, '####\s*(-?[\d,]+\.?\d*)', 1)[-1], ',', ''),
  replace(regexp_extract_all(response, '-?[\d,]+\.?\d*')[-1], ',', '')) as answer
from responses""",
    "instances": """
select cast(doc_id as varchar) as instance_id, source as repo, text as problem_statement,
 doc_id as seq from documents""",
    "predictions": """
select cast(doc_id as varchar) as instance_id, quality = 1 as resolved, doc_id % 7 <> 0 as patch_exists,
 case when toxic = 1 then 'timed_out' end as error from labels""",
    "prompts": """
select cast(doc_id as varchar) as instance_id,
 case when doc_id % 9 = 0 then '' else 'solve ' || doc_id end as text_inputs, doc_id as seq from labels
union all
select cast(doc_id as varchar), 'again ' || doc_id, doc_id + 1000000000 from labels where doc_id % 4 = 0""",
    "prompt_map": """
select instance_id, arg_max(text_inputs, seq) as text_inputs from prompts
where text_inputs <> '' and instance_id <> '' group by instance_id""",
    "patches": """
select doc_id, concat('--- a/', source, '/f.py', chr(10), '+++ b/', source, '/f.py', chr(10),
 '@@ -1,1 +1,9 @@', chr(10), '+', replace(text, chr(10), concat(chr(10), '+')),
 case when doc_id % 2 = 0 then concat(chr(10), '--- a/src/g.py', chr(10), '+++ b/src/g.py', chr(10),
  '@@ -3,2 +5,3 @@ def g():', chr(10), ' def g(a):', chr(10), '-    pass', chr(10), '+    return ',
  case when doc_id % 3 = 0 then '(a' else 'a' end) else '' end,
 case when doc_id % 5 = 0 then concat(chr(10), 'diff --git a/n.txt b/n.txt', chr(10), '--- a/n.txt', chr(10),
  '+++ b/n.txt', chr(10), '@@ -1 +1 @@', chr(10), '+note') else '' end) as patch_diff
from documents""",
    "patch_lines": r"""
select doc_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line
from (select doc_id, string_split(patch_diff, chr(10)) as ls from patches)""",
    "turns": "select cast(conv_id as varchar) as session_id, turn, role, text from conversations",
    "generations": """
select session_id, row_number() over (partition by session_id order by turn) - 1 as turn,
 text as output, length(text) % 5 = 0 as all_passed from turns where role = 'assistant'""",
    "actions": """
select doc_id, case doc_id % 7
 when 0 then concat('think <bash>', chr(10), text, ' </bash> <submit/>')
 when 1 then concat(text, ' <submit  /> <bash>ls</bash>')
 when 2 then concat('<bash>open ', text, '<submit/>')
 when 3 then concat('<bash> </bash>', text)
 when 4 then concat(' ', chr(10), ' ')
 when 5 then concat(chr(9), text, chr(10))
 else concat('<submit/', text, '<bash>a</bash><bash>b</bash>') end as action from documents""",
    "outputs": """
select doc_id, case doc_id % 4
 when 0 then concat(text, chr(10), 'COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT', chr(10), ' diff ', text,
  ' COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT ')
 when 1 then concat(text, chr(10), '__RC_8372916__:', cast(doc_id % 3 as varchar), chr(10), 'rest')
 when 2 then concat('__RC_8372916__:12', chr(10), text, '__RC_8372916__:7')
 else text end as stdout, cast(doc_id % 3 as int) as returncode from documents""",
    "answers": """
select doc_id, case doc_id % 6
 when 0 then concat('Here:', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'done ```')
 when 1 then concat('open ```python', chr(10), text)
 when 2 then concat('a <patch>', chr(10), text, '</patch> <diff>x</diff>')
 when 3 then concat('<diff>', text, '</diff>```diff', chr(10), 'y```')
 when 4 then concat('```diff', chr(10), text, '```<patch></patch>')
 else concat(' ', chr(10), text, chr(10), ' ') end as answer from documents""",
    "images": """
select cast(doc_id as varchar) as instance_id, case when doc_id % 13 <> 0 then
 concat('swebench/sweb.eval.x86_64.', source, '_1776_', lang, '-', cast(doc_id % 50 as varchar),
  case when doc_id % 11 = 0 then ':v2' else ':latest' end) end as image from documents""",
    "tests": """
select cast(l_orderkey as varchar) as instance_id,
 concat(l_linenumber, '::', l_partkey, '::', l_suppkey) as test,
 case l_returnflag when 'R' then 'FAILED' when 'A' then 'ERROR' else 'PASSED' end as status,
 l_linenumber as line from lineitem""",
}

def with_views(sql: str) -> str:
    """Put the views a query names in front of it, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"(?<![\w.']){name}(?![\w'(])", text):
                visit(body)
                needed.append(name)

    visit(sql)
    rest = sql.strip()
    own = rest.startswith("with ")
    rest = rest.removeprefix("with ").removeprefix(",").strip()
    if not needed:
        return f"with {rest}" if own else rest
    views = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed)
    joint = ",\n" if own or sql.strip().startswith(",") else "\n"
    return f"with {views}{joint}{rest}"
