"""Patches taken apart, against hand-written cases and the windowed SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from runlens.operators.hunks import explode_hunks, patch_files
from runlens.operators.syntax import (
    check_fragment,
    syntax_checked,
    syntax_errors,
    syntax_feedback,
    syntax_verdicts,
)
from runlens.plans.patch_checks import HUNK_ROWS

TWO_HUNKS = """--- a/x/f.py
+++ b/x/f.py
@@ -1,2 +3,3 @@ def a():
 one
-gone
+two
\\ No newline at end of file
@@ -9 +11 @@
+three"""


def hunks_of(spark, patch, **options):
    df = spark.createDataFrame([(1, patch)], "id int, patch_diff string")
    rows = explode_hunks(df, "id", **options).collect()
    return sorted(
        (r.file_no, r.file, r.hunk_no, r.new_start, r.line_no, r.prefix, r.text) for r in rows
    )


def test_lines_of_two_hunks(spark):
    assert hunks_of(spark, TWO_HUNKS) == [
        (0, "x/f.py", 0, 3, 1, " ", "one"),
        (0, "x/f.py", 0, 3, 2, "+", "two"),
        (0, "x/f.py", 1, 11, 1, "+", "three"),
    ]
    assert hunks_of(spark, TWO_HUNKS + "\n") == hunks_of(spark, TWO_HUNKS)
    assert hunks_of(spark, TWO_HUNKS.replace("\n", "\r\n")) == hunks_of(spark, TWO_HUNKS)


@pytest.mark.parametrize("foreign", ["diff --git a/y b/y", "", "+++x", "text"])
def test_open_hunk_is_lost_at_a_foreign_line(spark, foreign):
    patch = TWO_HUNKS + f"\n{foreign}\n@@ -1 +20 @@\n+ignored"
    kept = hunks_of(spark, patch)
    assert [r[6] for r in kept] == ["one", "two"]
    assert [r[6] for r in hunks_of(spark, patch, keep_open=True)] == ["one", "two", "three"]


def test_last_section_of_a_path_counts(spark):
    patch = "+++ b/f.py\n@@ -1 +1 @@\n+old\n+++ b/f.py\n@@ -1 +2 @@\n+new"
    assert [(r[0], r[3], r[6]) for r in hunks_of(spark, patch)] == [(0, 2, "new"), (1, 2, "new")]


def test_path_suffix_matches(spark):
    patch = "+++ b/f.py\n@@ -1 +1 @@\n+short\n+++ b/x/f.py\n@@ -1 +1 @@\n+long"
    assert [(r[1], r[6]) for r in hunks_of(spark, patch)] == [("f.py", "long"), ("x/f.py", "long")]


def test_added_line_that_looks_like_a_header(spark):
    patch = "+++ b/f.py\n@@ -1 +1 @@\n+a\n+++ b\n+c"
    assert [r[6] for r in hunks_of(spark, patch)] == ["a"]


def test_headers_without_numbers_and_deletions(spark):
    patch = "+++ b/f.py\nignored\n@@ broken\n+a\n--- b\n+c\n@@ -1 +5 @@\n-only\n+++ /dev/null\n@@ -1 +1 @@\n-x"
    assert hunks_of(spark, patch) == [
        (0, "f.py", 0, 1, 1, "+", "a"),
        (0, "f.py", 0, 1, 2, "+", "c"),
    ]


def test_given_files_may_be_absent(spark):
    df = spark.createDataFrame([(TWO_HUNKS, ["f.py", "gone.py", "x/f.txt"])], "p string, f array<string>")
    files = df.select(patch_files(F.col("p"), F.col("f")).alias("o")).first()["o"]
    assert [(f["path"], f["in_diff"]) for f in files] == [("f.py", True), ("gone.py", False)]


def test_random_patches_match_the_windowed_sql(spark):
    rng = random.Random(7)
    common = ["+a", " b", "-c", "\\ d", "@@ -1 +4,2 @@", "@@ -2,3 +7 @@ k", "+++ b/f.py", "+++ b/x/f.py"]
    rare = ["@@ x", "+++ g.py", "+++ b/n.txt", "--- q", "+++z", "diff --git a/f.py b/f.py", "", "w", "+++ /dev/null"]

    def patch():
        lines = [rng.choice(common if rng.random() < 0.9 else rare) for _ in range(rng.randint(1, 30))]
        return "\n".join(["+++ b/x/f.py", "@@ -1 +1 @@", *lines, "+end"])

    patches = [(i, patch()) for i in range(300)]
    df = spark.createDataFrame(patches, "doc_id long, patch_diff string")
    got = sorted(
        (r.doc_id, r.file_no, r.file, r.hunk_no, r.new_start, r.line_no, r.prefix, r.text)
        for r in explode_hunks(df, "doc_id").collect()
    )
    con = duckdb.connect()
    con.execute("create table patches (doc_id bigint, patch_diff varchar)")
    con.executemany("insert into patches values (?, ?)", patches)
    want = con.execute(
        f"""with patch_lines as (select doc_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line
        from (select doc_id, string_split(patch_diff, chr(10)) as ls from patches)), {HUNK_ROWS}
        select doc_id, file_no, file, hunk_no, new_start, line_no, prefix, text from hunk_rows"""
    ).fetchall()
    assert len(got) > 500
    assert got == sorted(want)


def test_fragment_readings():
    assert check_fragment("x = 1") is None
    assert check_fragment("    x = 1\n    return x") is None
    assert check_fragment("        x = 1\n    y = 2") is not None
    assert check_fragment("    await f()\n    return 1") is None
    assert check_fragment("x = (") == {"line": 1, "offset": 5, "message": "'(' was never closed", "crash": None}
    late = check_fragment("    x = 1\n    y = = 2")
    assert (late["line"], late["message"]) == (2, "invalid syntax")
    deep = check_fragment("(" * 5000)
    assert deep["crash"] or deep["message"]


def checked(spark, *patches):
    df = spark.createDataFrame(list(enumerate(patches)), "id int, patch_diff string")
    return syntax_checked(df)


GOOD = "+++ b/a.py\n@@ -1 +1 @@\n+x = 1\n"
BAD = "+++ b/b.py\n@@ -1,4 +10,4 @@\n a = 1\n+b = (\n c = 2\n d = 3\n e = 4\n"
TEXT = "+++ b/n.txt\n@@ -1 +1 @@\n+((\n"
BLANK = "+++ b/c.py\n@@ -1 +1 @@\n+   \n"


def test_verdicts(spark):
    df = syntax_verdicts(checked(spark, GOOD, BAD, TEXT, GOOD + BAD, BLANK, "", GOOD + BAD + BAD), "id")
    rows = {r.id: r for r in df.collect()}
    assert [rows[i].status for i in range(7)] == ["ok", "ok", "skipped", "ok", "ok", "skipped", "ok"]
    assert [rows[i].score for i in range(6)] == [1.0, 0.0, 1.0, 0.5, 1.0, 1.0]
    assert rows[6].score == pytest.approx(1 / 3) and rows[6].files_errored == 2
    assert (rows[3].files_total, rows[3].files_parsed, rows[3].files_errored) == (2, 1, 1)


def test_errors_snippets_and_feedback(spark):
    state = checked(spark, BAD, GOOD, TEXT)
    error = syntax_errors(state, "id").collect()
    assert len(error) == 1
    assert (error[0].file, error[0].line, error[0].offset) == ("b.py", 11, 5)
    assert error[0].snippet == (
        "          10   a = 1\n    -->   11 + b = (\n          12   c = 2"
    )
    texts = {r.id: r.feedback for r in syntax_feedback(syntax_verdicts(state, "id")).collect()}
    assert texts[0] == (
        "[ast_check] FAILED: syntax errors in the following files:\n"
        "  - b.py: line 11, offset 5: '(' was never closed\n" + error[0].snippet
    )
    assert texts[1] == "[ast_check] PASSED: no syntax errors detected"
    assert texts[2] == "[ast_check] SKIPPED"


def test_checked_columns_can_be_taken_alone(spark):
    assert checked(spark, BAD).select("_found").collect()[0]["_found"][0]["line"] == 2
