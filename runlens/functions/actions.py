"""Model actions and the command output fed back to the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import SPACE_CLASS, find, first_match, let, py_strip

# Fixed values of the tool protocol.
BASH_OPEN = "<bash>"
BASH_CLOSE = "</bash>"
SUBMIT_TAG = rf"<submit{SPACE_CLASS}*/>"
SENTINEL = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT"
RETURN_CODE = r"__RC_8372916__:(\p{Nd}+)\n?"
TOO_LONG = "<warning>Output too long. Use head/tail/grep to get smaller output.</warning>"


def parse_tool_call(text: Column) -> Column:
    """struct(type, content) of the first tag in `text`.

    Without any tag the whole trimmed text is the command; a blank text submits.
    """

    def placed(p: Column) -> Column:
        stop = F.when(
            p["start"] > 0, find(p["body"], BASH_CLOSE, p["start"] + len(BASH_OPEN))
        ).otherwise(0)
        return let(F.struct(p["body"], p["start"], p["submit"], stop.alias("stop")), decided)

    def decided(p: Column) -> Column:
        start, stop, submit = p["start"], p["stop"], p["submit"]
        whole = py_strip(p["body"])
        command = F.substr(
            p["body"], start + len(BASH_OPEN), stop - start - len(BASH_OPEN)
        )
        submits = (
            F.when((submit > 0) & (stop > 0), submit < start)
            .when(submit > 0, True)
            .when(stop > 0, False)
            .otherwise(F.length(whole) == 0)
        )
        content = F.when(stop > 0, py_strip(command)).otherwise(whole)
        return F.when(submits, call("submit", F.lit(""))).otherwise(call("bash", content))

    def call(kind: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), content.alias("content"))

    body = F.coalesce(text, F.lit(""))
    return let(
        F.struct(
            body.alias("body"),
            find(body, BASH_OPEN).alias("start"),
            first_match(body, SUBMIT_TAG)["at"].alias("submit"),
        ),
        placed,
    )


def submission_sentinel(output: Column) -> Column:
    """Trimmed text behind the first sentinel, null when it is absent."""
    return let(
        find(output, SENTINEL),
        lambda at: F.when(at > 0, py_strip(F.substr(output, at + len(SENTINEL)))),
    )


def format_observation(stdout: Column, returncode: Column, max_chars: int = 10000) -> Column:
    """Command output as a tagged block; long output keeps its head and tail."""
    half = max_chars // 2
    code = F.concat(F.lit("<returncode>"), returncode.cast("string"), F.lit("</returncode>\n"))
    size = F.length(stdout)
    # A zero-length tail slice means the whole text in Python.
    tail = F.right(stdout, F.lit(half)) if half else stdout
    return F.when(
        size <= max_chars,
        F.concat(code, F.lit("<output>\n"), stdout, F.lit("\n</output>")),
    ).otherwise(
        F.concat(
            code,
            F.lit(f"{TOO_LONG}\n<output_head>\n"),
            F.left(stdout, F.lit(half)),
            F.lit("\n</output_head>\n<elided_chars>"),
            (size - max_chars).cast("string"),
            F.lit(" characters elided</elided_chars>\n<output_tail>\n"),
            tail,
            F.lit("\n</output_tail>"),
        )
    )


def extract_return_code(raw: Column) -> Column:
    """struct(output, exit_code): the first code marker is cut out of the text."""

    def cut(match: Column) -> Column:
        mark, at = match["found"], match["at"]
        joined = F.concat(F.left(raw, at - 1), F.substr(raw, at + F.length(mark)))
        code = F.regexp_extract(mark, RETURN_CODE, 1)
        return F.struct(
            F.when(at > 0, py_strip(joined)).otherwise(raw).alias("output"),
            F.when(at > 0, code.try_cast("bigint")).otherwise(F.lit(-1)).alias("exit_code"),
        )

    return let(first_match(raw, RETURN_CODE), cut)


def classify_exec_result(timed_out: Column, failure: Column) -> Column:
    """Outcome text of one executed sample: passed, timed out or failed."""
    return (
        F.when(timed_out, F.lit("timed out"))
        .when(failure.isNotNull(), F.concat(F.lit("failed: "), failure))
        .otherwise(F.lit("passed"))
    )


def tail_excerpt(stdout: Column, whole_below: int = 4000, tail: int = 3000) -> Column:
    """Indented test output; only its last part when it is long, empty when blank."""

    def indent(text: Column) -> Column:
        return F.replace(text, F.lit("\n"), F.lit("\n  "))

    size = F.length(F.coalesce(stdout, F.lit("")))
    return (
        F.when(size == 0, F.lit(""))
        .when(size < whole_below, F.concat(F.lit("\n  Test output:\n  "), indent(stdout)))
        .otherwise(
            F.concat(
                F.lit(f"\n  Test output (last {tail} chars):\n  "),
                indent(F.right(stdout, F.lit(tail))),
            )
        )
    )
