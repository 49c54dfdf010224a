"""Entities of the data model, derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.running import running


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the repo of their instance."""
    columns = bare_runs(spark, sf).columns
    repos = instances_of_runs(spark, sf)
    return bare_runs(spark, sf).join(repos, "instance_id").select("instance_id", "repo", *columns[1:])


def bare_runs(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a run, its customer the instance; every eleventh customer has no runs.

    Lines are counted per order before the join, so order keys are unique on
    both sides of it.
    """
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.floor(F.sum("l_quantity")).cast("bigint").alias("_q"),
        )
    )
    reasons = {
        "1-URGENT": "submit",
        "2-HIGH": "max_steps",
        "3-MEDIUM": "token_limit",
        "5-LOW": "error",
    }
    reason = F.lit(None)
    for name, meaning in reasons.items():
        reason = F.when(F.col("o_orderpriority") == name, meaning).otherwise(reason)
    orders = table(spark, sf, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_custkey").cast("string").alias("instance_id"),
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_orderstatus") == "F").alias("resolved"),
        F.coalesce("_n", F.lit(0)).cast("int").alias("steps"),
        F.coalesce("_q", F.lit(0)).cast("bigint").alias("total_tokens"),
        F.col("o_totalprice").alias("wall_clock_seconds"),
        reason.cast("string").alias("reason"),
    )


def instances_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    """All customers as instances, also those without runs."""
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("instance_id"), F.col("n_name").alias("repo")
    )


def indexed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with `run_idx`, their dense place inside the instance."""
    placed = running(
        runs(spark, sf), ["instance_id"], "run_id", {"_place": ("count", F.lit(1))}, chunk=1 << 20
    )
    return placed.withColumn("run_idx", F.col("_place") - 1).drop("_place")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """An (order, line number) pair is a verdict of verifier v1 .. v7."""
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("l_discount") * 10)), 4)
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.when(F.bool_and(F.col("l_returnflag") == "R"), "error").otherwise("ok").alias("status"),
            (score + 0.0).alias("score"),
        )
        .select(
            F.col("l_orderkey").cast("string").alias("session_id"),
            F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name"),
            "status",
            "score",
            F.lit(0.5).alias("pass_threshold"),
        )
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("session_id")
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Answers at all cascade levels, a wrong one and a missing one."""
    n = F.col("n_chars").cast("string")
    which = F.col("doc_id") % 5
    response = (
        F.when(which == 0, F.concat(F.lit("so #### "), n))
        .when(which == 1, F.concat(F.lit("so \\boxed{"), n, F.lit("}")))
        .when(which == 2, F.concat(F.lit("the total is "), n))
        .when(which == 3, F.concat(F.lit("the total is "), (F.col("n_chars") + 1).cast("string")))
        .otherwise(F.lit("no answer"))
    )
    return table(spark, sf, "documents").select(
        "doc_id",
        "source",
        F.col("text").alias("prompt"),
        F.concat(F.lit("#### "), n).alias("label"),
        response.alias("response"),
    )


def instances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("instance_id"),
        F.col("source").alias("repo"),
        F.col("text").alias("problem_statement"),
        F.col("doc_id").alias("seq"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Graded predictions for the labelled documents."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("instance_id"),
        (F.col("quality") == 1).alias("resolved"),
        (F.col("doc_id") % 7 != 0).alias("patch_exists"),
        F.when(F.col("toxic") == 1, "timed_out").alias("error"),
    )


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt lines for the labelled documents; a few are empty, some ids repeat."""
    lines = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("instance_id"),
        F.when(F.col("doc_id") % 9 == 0, "")
        .otherwise(F.concat(F.lit("solve "), F.col("doc_id").cast("string")))
        .alias("text_inputs"),
        F.col("doc_id").alias("seq"),
    )
    again = lines.where(F.col("seq") % 4 == 0).select(
        "instance_id",
        F.concat(F.lit("again "), F.col("instance_id")).alias("text_inputs"),
        (F.col("seq") + 1_000_000_000).alias("seq"),
    )
    return lines.unionByName(again)


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a patch of one or two Python files and a text file."""
    text = F.col("text")
    path = F.concat(F.col("source"), F.lit("/f.py"))
    body = F.replace(text, F.lit("\n"), F.lit("\n+"))
    second = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(
            F.lit("\n--- a/src/g.py\n+++ b/src/g.py\n@@ -3,2 +5,3 @@ def g():\n def g(a):\n-    pass\n+    return "),
            F.when(F.col("doc_id") % 3 == 0, F.lit("(a")).otherwise(F.lit("a")),
        ),
    ).otherwise(F.lit(""))
    third = F.when(
        F.col("doc_id") % 5 == 0,
        F.lit("\ndiff --git a/n.txt b/n.txt\n--- a/n.txt\n+++ b/n.txt\n@@ -1 +1 @@\n+note"),
    ).otherwise(F.lit(""))
    diff = F.concat(
        F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,1 +1,9 @@\n+"), body,
        second, third,
    )
    return table(spark, sf, "documents").select("doc_id", diff.alias("patch_diff"))


def code_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of real code: each document as comments above a function.

    Some first files end in a broken line, some second files (an indented
    method) leave a bracket open, and some patches go on with a text file in
    git format.
    """
    n = F.col("doc_id")
    comments = F.concat(F.lit("+# "), F.replace("text", F.lit("\n"), F.lit("\n+# ")))
    first = F.concat(
        F.lit("--- a/src/f.py\n+++ b/src/f.py\n@@ -1,1 +1,9 @@\n"),
        comments,
        F.lit("\n+def f():\n+    return "),
        F.col("n_chars").cast("string"),
        F.when(n % 7 == 0, F.lit("\n+x = = 1")).otherwise(F.lit("")),
    )
    second = F.when(
        n % 2 == 0,
        F.concat(
            F.lit("\n--- a/src/g.py\n+++ b/src/g.py\n@@ -3,2 +5,2 @@ class G:\n     def g(a):\n"),
            F.lit("-        pass\n+        return "),
            F.when(n % 3 == 0, F.lit("(a")).otherwise(F.lit("a")),
        ),
    ).otherwise(F.lit(""))
    third = F.when(
        n % 5 == 0,
        F.lit("\ndiff --git a/n.txt b/n.txt\n--- a/n.txt\n+++ b/n.txt\n@@ -1 +1 @@\n+note"),
    ).otherwise(F.lit(""))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(first, second, third).alias("patch_diff")
    )


def stored_files(spark: SparkSession, sf: str) -> DataFrame:
    """Base files: per document a function with the text as its documentation, per source a module that many patches change."""
    docs = table(spark, sf, "documents").where(~(F.col("doc_id") % 6).isin(4, 5))
    own = docs.select(
        F.col("source").alias("repo"),
        F.lit("c1").alias("commit"),
        F.concat(F.lit("pkg/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.concat(
            F.lit('def f():\n    """doc\n'), plain_text(), F.lit('\n    """\n    return '), F.col("n_chars").cast("string"), F.lit("\n")
        ).alias("content"),
    )
    common = table(spark, sf, "documents").select(
        F.col("source").alias("repo"),
        F.lit("c1").alias("commit"),
        F.lit("pkg/common.py").alias("path"),
        F.lit("A = 1\nB = 2\nC = 3\nD = 4\nE = 5\n").alias("content"),
    )
    return own.unionByName(common.distinct())


def plain_text() -> Column:
    """A document's text that can stand inside a string."""
    # Searches for bytes; `translate` looks up every character and takes several times as long.
    unquoted = F.replace(F.col("text"), F.lit('"'), F.lit("'"))
    return F.replace(unquoted, F.lit("\\"), F.lit("/"))


def stored_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of the stored files: exact, moved, broken, rejected, without a base file, of a new file, and of no Python file."""
    n, text, count = F.col("doc_id"), plain_text(), F.col("n_chars").cast("string")
    lines = F.size(F.split(text, "\n", -1))
    path = F.concat(F.lit("pkg/m"), n.cast("string"), F.lit(".py"))

    def last(at: Column, context: str, new: Column) -> Column:
        """A hunk that replaces the last line."""
        place = (at + lines).cast("string")
        return F.concat(
            F.lit("@@ -"), place, F.lit(",2 +"), place, F.lit(f",2 @@\n     {context}\n-    return "), count, F.lit("\n+    return "), new, F.lit("\n")
        )

    more = F.concat(count, F.lit(" + 1"))
    first = F.concat(
        F.lit('@@ -1,3 +1,4 @@ def f():\n def f():\n-    """doc\n+    """doc of\n+    more\n '),
        F.get(F.split(text, "\n", -1), F.lit(0)), F.lit("\n"),
    )
    kind = n % 6
    hunks = (
        F.when(kind == 0, F.concat(first, last(F.lit(3), '"""', more)))
        .when(kind == 1, last(F.lit(10), '"""', more))
        .when(kind == 2, last(F.lit(3), '"""', F.lit("(")))
        .when(kind == 3, last(F.lit(3), "x = 1", more))
        .when(kind == 4, F.lit("@@ -1,2 +1,2 @@\n def f():\n-    pass\n+    return (\n"))
        .otherwise(
            F.concat(
                F.lit("@@ -0,0 +1,"), (lines + 3).cast("string"), F.lit(' @@\n+"""\n+'),
                F.replace(text, F.lit("\n"), F.lit("\n+")), F.lit('\n+"""\n+N = '), count, F.lit("\n"),
            )
        )
    )
    old = F.when(kind == 5, F.lit("/dev/null")).otherwise(F.concat(F.lit("a/"), path))
    own = F.concat(F.lit("--- "), old, F.lit("\n+++ b/"), path, F.lit("\n"), hunks)
    common = F.when(
        n % 2 == 0,
        F.concat(
            F.lit("diff --git a/pkg/common.py b/pkg/common.py\n--- a/pkg/common.py\n+++ b/pkg/common.py\n@@ -1,4 +1,4 @@\n A = 1\n-B = 2\n+B = "),
            n.cast("string"), F.lit("\n C = 3\n D = 4\n"),
        ),
    ).otherwise(F.lit(""))
    note = F.lit("--- /dev/null\n+++ b/n.txt\n@@ -0,0 +1 @@\n+note\n")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("repo"),
        F.lit("c1").alias("commit"),
        F.when(n % 11 == 0, note).otherwise(F.concat(own, common)).alias("patch_diff"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text"
    )


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant messages as generation turns numbered from 0, with a pass flag."""
    spoken = (
        turns(spark, sf)
        .where(F.col("role") == "assistant")
        .withColumn("all_passed", F.length("text") % 5 == 0)
    )
    numbered = running(spoken, ["session_id"], "turn", {"_place": ("count", F.lit(1))})
    return numbered.select(
        "session_id",
        (F.col("_place") - 1).alias("turn"),
        F.col("text").alias("output"),
        "all_passed",
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs around whole documents: commands, submissions and plain text."""
    text = F.col("text")
    which = F.col("doc_id") % 7
    action = (
        F.when(which == 0, F.concat(F.lit("think <bash>\n"), text, F.lit(" </bash> <submit/>")))
        .when(which == 1, F.concat(text, F.lit(" <submit  /> <bash>ls</bash>")))
        .when(which == 2, F.concat(F.lit("<bash>open "), text, F.lit("<submit/>")))
        .when(which == 3, F.concat(F.lit("<bash> </bash>"), text))
        .when(which == 4, F.lit(" \n "))
        .when(which == 5, F.concat(F.lit("\t"), text, F.lit("\n")))
        .otherwise(F.concat(F.lit("<submit/"), text, F.lit("<bash>a</bash><bash>b</bash>")))
    )
    return table(spark, sf, "documents").select("doc_id", action.alias("action"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Command outputs around whole documents, with markers in some of them."""
    text = F.col("text")
    which = F.col("doc_id") % 4
    sentinel = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT"
    stdout = (
        F.when(which == 0, F.concat(text, F.lit(f"\n{sentinel}\n diff "), text, F.lit(f" {sentinel} ")))
        .when(which == 1, F.concat(text, F.lit("\n__RC_8372916__:"), (F.col("doc_id") % 3).cast("string"), F.lit("\nrest")))
        .when(which == 2, F.concat(F.lit("__RC_8372916__:12\n"), text, F.lit("__RC_8372916__:7")))
        .otherwise(text)
    )
    return table(spark, sf, "documents").select(
        "doc_id",
        stdout.alias("stdout"),
        (F.col("doc_id") % 3).cast("int").alias("returncode"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers with fences, patch tags and bare text around whole documents."""
    text = F.col("text")
    which = F.col("doc_id") % 6
    answer = (
        F.when(which == 0, F.concat(F.lit("Here:\n```python\n"), text, F.lit("\n```\ndone ```")))
        .when(which == 1, F.concat(F.lit("open ```python\n"), text))
        .when(which == 2, F.concat(F.lit("a <patch>\n"), text, F.lit("</patch> <diff>x</diff>")))
        .when(which == 3, F.concat(F.lit("<diff>"), text, F.lit("</diff>```diff\ny```")))
        .when(which == 4, F.concat(F.lit("```diff\n"), text, F.lit("```<patch></patch>")))
        .otherwise(F.concat(F.lit(" \n"), text, F.lit("\n ")))
    )
    return table(spark, sf, "documents").select("doc_id", answer.alias("answer"))


def job_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Job logs with a delimited JSON map of predictions, some of them broken."""
    n = F.col("doc_id").cast("string")
    which = F.col("doc_id") % 5

    def entry(key: Column, patch: Column) -> Column:
        return F.concat(
            F.lit('"'), key, F.lit('": {"instance_id": "'), key,
            F.lit('", "model_patch": "'), patch, F.lit('"}'),
        )

    own = entry(n, F.concat(F.lit("own "), F.col("source")))
    other = entry(F.lit("x"), F.concat(F.lit("other "), F.col("lang")))
    start, end = "<<PREDS_JSON_START_7829361>>", "<<PREDS_JSON_END_7829361>>"
    body = (
        F.when(which == 0, F.concat(F.lit("{"), own, F.lit(", "), other, F.lit("}")))
        .when(which == 1, F.concat(F.lit("{"), other, F.lit("}")))
        .when(which == 2, F.concat(F.lit("{"), other, F.lit(", "), entry(F.lit("y"), F.lit("p")), F.lit("}")))
        .when(which == 3, F.lit("{broken"))
    )
    log = F.when(
        body.isNotNull(), F.concat(F.col("text"), F.lit(f"\n{start}\n"), body, F.lit(f"\n{end}\nbye"))
    ).otherwise(F.concat(F.lit(end), F.col("text"), F.lit(start)))
    return table(spark, sf, "documents").select(n.alias("instance_id"), log.alias("log"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Container images of the instances; some tags are odd, some are missing."""
    tag = F.when(F.col("doc_id") % 11 == 0, ":v2").otherwise(":latest")
    ref = F.concat(
        F.lit("swebench/sweb.eval.x86_64."), F.col("source"), F.lit("_1776_"), F.col("lang"),
        F.lit("-"), (F.col("doc_id") % 50).cast("string"), tag,
    )
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("instance_id"),
        F.when(F.col("doc_id") % 13 != 0, ref).alias("image"),
    )


def tests(spark: SparkSession, sf: str) -> DataFrame:
    """Test statuses: a line of an order is a test, its return flag the status."""
    flag = F.col("l_returnflag")
    status = F.when(flag == "R", "FAILED").when(flag == "A", "ERROR").otherwise("PASSED")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("instance_id"),
        F.concat_ws("::", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias(
            "test"
        ),
        status.alias("status"),
        F.col("l_linenumber").alias("line"),
    )
