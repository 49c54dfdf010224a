"""Text functions against hand-written cases."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runlens.functions import actions, answers, patches, prompts, sections, verdicts
from runlens.functions.text import py_splitlines, py_strip, word_count


def test_strip_and_splitlines_follow_python(one):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\na", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029",
             " x\u00a0", "\t\u3000x y\x1f\n", "a\r\n", "a\n\r"]
    assert one(py_splitlines, [(t,) for t in texts], "t string") == [t.splitlines() for t in texts]
    assert one(py_strip, [(t,) for t in texts], "t string") == [t.strip() for t in texts]
    assert one(word_count, [(t,) for t in texts], "t string") == [len(t.split()) for t in texts]


def test_strip_prompt_prefix(one):
    rows = [("ab", "a"), ("ab", "b"), ("ab", None), ("a.b", "a."), ("", "")]
    assert one(answers.strip_prompt_prefix, rows, "q string, p string") == ["b", "ab", "ab", "b", ""]


def test_extract_answer(one):
    cases = {
        "x \\boxed{ 12 } y \\boxed{1,2}": "1,2",
        "\\boxed{\\frac{1}{2}}": "\\frac{1",
        "\\boxed{} #### 5": "5",
        "#### 1,234.50 and 7": "1234.50",
        "####-3 #### \u00a0 -4.": "-4.",
        "it is 5 or -6.5 apples": "-6.5",
        "42 dollars, right": "",
        "no number": None,
        "": None,
        "#### \u0664\u0662": "\u0664\u0662",
        "\\boxed{a\nb}": "a\nb",
    }
    got = one(answers.extract_answer, [(t,) for t in cases], "t string")
    assert got == list(cases.values())
    strict = one(lambda t: answers.extract_answer(t, require_digit=True),
                 [("42 dollars, right",), ("a , b",), ("x ,5",)], "t string")
    assert strict == ["42", None, "5"]


def test_normalize_number_matches_float(one):
    texts = ["1", " 1,234 ", "-.5", "5.", "1e3", "1E-3", "1_000", "1__0", "_1", "1d", "1.5f", "0x1p3", "",
             "+7", "--7", "\u00a012\u2003", "\u0664\u0662", "1e999", "1.2.3", "e5", "1e", ".", "1_0.0_1", "abc", "12L"]
    want = []
    for text in texts:
        try:
            want.append(float(text.replace(",", "").strip()))
        except ValueError:
            want.append(None)
    assert one(answers.normalize_number, [(t,) for t in texts], "t string") == want
    odd = one(answers.normalize_number, [("inf",), ("-Infinity",), ("nan",)], "t string")
    assert odd[:2] == [math.inf, -math.inf] and math.isnan(odd[2])


def test_math_reward(one):
    rows = [
        ("#### 42", "#### 42", 1.0),
        ("#### 42.0000001", "42", 1.0),
        ("#### 42.1", "42", 0.0),
        ("42 dollars, right", "42", 0.0),
        ("\\boxed{42}", "1,2", 0.0),
        ("\\boxed{12}", "1,2", 1.0),
        ("", "42", 0.0),
        ("42", None, 0.0),
        ("42", "", 0.0),
        ("\\boxed{1d}", "1", 0.0),
        ("\\boxed{inf}", "\\boxed{inf}", 0.0),
        ("\\boxed{nan}", "\\boxed{nan}", 0.0),
        ("nothing", "nothing", 0.0),
    ]
    got = one(answers.math_reward, [r[:2] for r in rows], "r string, l string")
    assert got == [r[2] for r in rows]


def test_parse_tool_call(one):
    cases = {
        "a <bash> ls </bash> b": ("bash", "ls"),
        "<bash>a\nb</bash><submit/>": ("bash", "a\nb"),
        "<submit/><bash>a</bash>": ("submit", ""),
        "\U0001f600<submit \n/> <bash>a</bash>": ("submit", ""),
        "\U0001f600\U0001f600<bash>a</bash><submit/>": ("bash", "a"),
        "<bash>open <submit/>": ("submit", ""),
        "</bash><bash>x": ("bash", "</bash><bash>x"),
        "</bash> <bash>x</bash>": ("bash", "x"),
        "<bash>a<bash>b</bash>c</bash>": ("bash", "a<bash>b"),
        "<bash></bash>": ("bash", ""),
        "<bash> \n</bash>": ("bash", ""),
        "  \n ": ("submit", ""),
        "": ("submit", ""),
        None: ("submit", ""),
        " plain text\u00a0": ("bash", "plain text"),
        "<submit>": ("bash", "<submit>"),
    }
    got = one(actions.parse_tool_call, [(t,) for t in cases], "t string")
    assert [tuple(r) for r in got] == list(cases.values())


def test_submission_sentinel(one):
    mark = actions.SENTINEL
    rows = [(f"x{mark}\n a {mark} b \n",), ("none",), (mark,)]
    assert one(actions.submission_sentinel, rows, "t string") == [f"a {mark} b", None, ""]


def test_format_observation(one):
    def show(limit):
        return lambda s, r: actions.format_observation(s, r, limit)

    assert one(show(5), [("abcde", 1)], "s string, r int") == [
        "<returncode>1</returncode>\n<output>\nabcde\n</output>"
    ]
    long = one(show(5), [("abcdefg\U0001f600", 0)], "s string, r int")[0]
    assert "<output_head>\nab\n</output_head>" in long
    assert "<elided_chars>3 characters elided</elided_chars>" in long
    assert long.endswith("<output_tail>\ng\U0001f600\n</output_tail>")
    tiny = one(show(1), [("abc", 0)], "s string, r int")[0]
    assert "<output_head>\n\n</output_head>" in tiny and "<output_tail>\nabc\n" in tiny


def test_extract_return_code(one):
    rows = [("out\n__RC_8372916__:0\n",), ("a__RC_8372916__:12\nb__RC_8372916__:3",), (" none ",),
            ("\U0001f600 __RC_8372916__:7 x",)]
    got = [tuple(r) for r in one(actions.extract_return_code, rows, "t string")]
    assert got == [("out", 0), ("ab__RC_8372916__:3", 12), (" none ", -1), ("\U0001f600  x", 7)]


def test_tail_excerpt(one):
    rows = [("",), (None,), ("a\nb",), ("x" * 3999,), ("y" * 1000 + "\n" + "z" * 2999,), ("w" * 4000,)]
    got = one(actions.tail_excerpt, rows, "t string")
    assert got[0] == "" and got[1] == ""
    assert got[2] == "\n  Test output:\n  a\n  b"
    assert got[3] == "\n  Test output:\n  " + "x" * 3999
    assert got[4] == "\n  Test output (last 3000 chars):\n  \n  " + "z" * 2999
    assert got[5].endswith("  " + "w" * 3000)


def test_classify_exec_result(one):
    rows = [(True, None), (True, "x"), (False, "boom"), (False, None)]
    assert one(actions.classify_exec_result, rows, "t boolean, f string") == [
        "timed out", "timed out", "failed: boom", "passed",
    ]


def test_extract_fenced_code(one):
    rows = [("no fence",), ("a ```python\nx\n``` b",), ("```python x",), ("```\ny\n```",), ("```python```",)]
    got = one(sections.extract_fenced_code, rows, "t string")
    assert got == ["no fence", "\nx\n", " x", "```\ny\n```", ""]


def test_extract_diff(one):
    cases = {
        "<diff>d</diff><patch>p</patch>": "p",
        "<patch></patch><diff>d</diff>": "d",
        "```diff\nf\n``` tail": "f\n",
        "<patch>open": "<patch>open",
        " plain\n": "plain",
        "<patch>\na\n</patch>": "\na\n",
    }
    assert one(sections.extract_diff, [(t,) for t in cases], "t string") == list(cases.values())


def test_extract_section(one):
    rows = [("xS a E b E",), ("E S a",), ("S a",), ("a E",), ("SE",), ("S a S b E",), ("E S a E",)]
    got = one(lambda t: sections.extract_section(t, "S", "E"), rows, "t string")
    assert got == ["a", "", "", "", "", "a S b", ""]


def test_extract_keyed_prediction(one):
    start, end = sections.PREDS

    def log(body):
        return f"noise {start}\n{body}\n{end} noise"

    rows = [
        (log('{"i": {"instance_id": "i", "model_patch": "p", "model_name_or_path": "z"}, "k": {}}'), "i", "m"),
        (log('{"k": {"model_patch": "q"}}'), "i", "m"),
        (log('{"k": {"instance_id": "k", "model_patch": "q"}}'), "i", "m"),
        (log('{"a": {"model_patch": "q"}, "b": {"model_patch": "r"}}'), "i", "m"),
        (log('{"i": {"model_patch": "lost"}}'), "i", "m"),
        (log("{oops"), "i", "m"),
        ("no markers", "i", "m"),
    ]
    got = [tuple(r) for r in one(sections.extract_keyed_prediction, rows, "l string, i string, m string")]
    assert got == [
        ("i", "p", "z"), ("i", "q", "m"), ("k", "q", "m"), ("i", "", "m"), ("i", "", "m"), ("i", "", "m"),
        ("i", "", "m"),
    ]


def test_changed_files_and_stats(one):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+a\n" \
           "diff --git a/x.py b/x.py\n+++ b/x.py\n+++ /dev/null\n+++ other\n"
    rows = [(diff,), ("",), (None,), ("no newline",)]
    assert one(patches.changed_files, rows, "t string") == [["x.py", "x.py", "other"], [], None, []]
    stats = [tuple(r) for r in one(patches.patch_stats, rows, "t string")]
    assert stats == [(9, 1, False), (0, 0, True), (0, 0, True), (0, 0, False)]


def test_render_template(one):
    def render(a, b):
        return prompts.render_template("{a}-{b}-{c}", {"a": a, "b": b})

    assert one(render, [("{b}", "x"), ("$1\\", "{a}")], "a string, b string") == ["x-x-{c}", "$1\\-{a}-{c}"]


def test_split_system_user(one):
    rows = [("sys\nuser\nmore",), ("only",), ("\nu",), ("s\n",)]
    got = [[tuple(m) for m in r] for r in one(prompts.split_system_user, rows, "t string")]
    assert got == [
        [("system", "sys"), ("user", "user\nmore")],
        [("user", "only")],
        [("system", ""), ("user", "u")],
        [("system", "s"), ("user", "")],
    ]


def test_model_slug_image_and_dataset_names(one):
    assert one(prompts.model_slug, [("Org/M-1.5/x",), ("Plain.2",), ("a/",)], "t string") == ["m-1-5", "plain-2", ""]
    images = [("ns/a:latest",), ("ns/b/c:v2",), ("bare:latest",)]
    assert one(lambda i: prompts.rewrite_image_ref(i, "r"), images, "t string") == ["r/a:v1", "r/b/c:v2", "r/"]
    names = [("nebius/SWE-rebench",), ("x/y",), ("princeton-nlp/SWE-bench_Verified",)]
    assert one(prompts.dataset_alias, names, "t string") == ["rebench", "x/y", "verified"]
    assert one(prompts.default_split, names, "t string") == ["train", "train", "test"]
    keys = [("s/sweb.eval.x86_64.repo_1776_n-1:latest",), ("s/other:x",), ("plain",)]
    assert one(prompts.image_repo_key, keys, "t string") == ["repo_1776_n-1", "other", "plain"]


def test_object_paths(one, spark):
    rows = [("s3://b/k/x.json",), ("S3://b//k?q=1#f",), ("s3://b",), ("s3:/x/y",)]
    got = [tuple(r) for r in one(prompts.split_object_path, rows, "t string")]
    assert got == [("b", "k/x.json"), ("b", "k"), ("b", ""), ("", "x/y")]
    with pytest.raises(PySparkException, match="only s3"):
        one(prompts.split_object_path, [("http://b/k",)], "t string")


def test_verdict_rules(one):
    rows = [("ok", 0.5, 0.5), ("ok", 0.4, 0.5), ("skipped", 1.0, 0.5), ("error", 1.0, 0.0)]
    schema = "s string, v double, t double"
    assert one(verdicts.verifier_passed, rows, schema) == [True, False, False, False]
    assert one(lambda s, v, t: verdicts.effective_score(s, v), rows, schema) == [0.5, 0.4, 0.0, 0.0]
    with pytest.raises(PySparkException, match="a threshold lies"):
        one(verdicts.verifier_passed, [("ok", 1.0, 1.5)], schema)


def test_two_decimals_round_like_python(one):
    scores = [0.125, 0.375, 0.145, 0.005, 0.015, 0.025, 0.995, 1.0, 0.0, 0.3333333, 2 / 3, 0.285, 0.575]
    got = one(verdicts.two_decimals, [(s,) for s in scores], "v double")
    assert got == [f"{s:.2f}" for s in scores]


def test_feedback_line(one):
    rows = [("n", "ok", 1.0, 1.0), ("n", "ok", 0.125, 0.5), ("n", "timeout", 0.0, 1.0)]
    got = one(verdicts.feedback_line, rows, "n string, s string, v double, t double")
    assert got == ["[n] PASSED (score: 1.00)", "[n] FAILED (score: 0.12)", "[n] TIMEOUT"]


def test_verdict_or_default(one):
    schema = "c string, vt boolean, je string, jt boolean, o string, g string, r boolean"
    rows = [
        (None, True, None, False, "x", None, True),
        ("boom", False, None, False, "x", None, True),
        (None, False, "job", False, "x", None, True),
        (None, False, "", True, "", None, True),
        (None, False, None, None, None, None, True),
        (None, False, None, False, "x", "bad log", True),
        (None, False, None, False, "x", None, True),
        (None, None, None, True, "x", None, False),
    ]
    got = [tuple(r) for r in one(verdicts.verdict_or_default, rows, schema)]
    assert got == [
        ("timeout", 0.0, "timeout"), ("error", 0.0, "boom"), ("error", 0.0, "job"),
        ("error", 0.0, "K8s Job timed out"), ("error", 0.0, "No test output captured from pod logs"),
        ("error", 0.0, "bad log"), ("ok", 1.0, None), ("ok", 0.0, None),
    ]


def test_unit_test_feedback(one):
    def build(status, score, applied, tests, stdout, error):
        return verdicts.unit_test_feedback(status, score, F.lit(1.0), applied, tests, stdout, error)

    schema = "s string, v double, a boolean, t map<string,string>, o string, e string"
    many = {f"t{i:02d}": "FAILED" for i in range(22)}
    rows = [
        ("error", 0.0, None, None, None, None),
        ("timeout", 0.0, None, None, None, "late"),
        ("ok", 1.0, True, None, None, None),
        ("ok", 0.0, False, many, "out", None),
        ("ok", 0.0, True, {"a": "PASSED", "b": "ERROR"}, "x\ny", None),
        ("ok", 0.0, True, many, "", None),
    ]
    got = one(build, rows, schema)
    assert got[0] == "[swe_test] ERROR: unknown error"
    assert got[1] == "[swe_test] TIMEOUT: late"
    assert got[2] == "[swe_test] PASSED: issue resolved"
    assert got[3] == "[swe_test] FAILED (score: 0.00)\n  The patch could not be applied to the repository."
    assert got[4] == (
        "[swe_test] FAILED (score: 0.00)\n  Failing tests (1):\n    - b\n\n  Test output:\n  x\n  y"
    )
    assert "Failing tests (22):" in got[5] and got[5].endswith("... and 2 more")
    assert got[5].count("    - ") == 20


def test_unknown_aggregator_and_weights(one):
    with pytest.raises(ValueError, match="no aggregate named"):
        verdicts.score_by_name("median", F.col("a"), F.col("b"))
    rows = [("a",), ("b",), ("c",)]
    got = one(lambda n: verdicts.weight_of(n, {"a": 0.25, "b": 0.0}), rows, "n string")
    assert got == [0.25, 0.0, 1.0]
    with pytest.raises(PySparkException, match="a weight below 0"):
        one(lambda n: verdicts.weight_of(n, {"a": -1.0}), [("a",)], "n string")
