import ast
import textwrap
import warnings

from runlens.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def parses(source):
    """Plain reading of a hunk: as it stands, dedented, inside a block; only a first line's indentation leads on."""
    flat = textwrap.dedent(source)
    for reading in (source, flat, "async def _():\n    if True:\n" + textwrap.indent(flat, " " * 8)):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(reading)
            return True
        except IndentationError as error:
            if error.lineno != 1:
                return False
        except SyntaxError:
            return False
    return False


def test_verdicts_on_prose_are_the_parsers(spark):
    got = {r["doc_id"]: r for r in QUERIES["syntax_free_text_verdicts"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    errors = 0
    for doc in docs:
        n, text = doc["doc_id"], doc["text"]
        # A hunk that a git header follows is lost, and its file then has nothing wrong.
        hunks = [text]
        if n % 2 == 0:
            hunks.append("def g(a):\n    return " + ("(a" if n % 3 == 0 else "a"))
        lost = len(hunks) - 1 if n % 5 == 0 else None
        bad = sum(i != lost and bool(h.strip()) and not parses(h) for i, h in enumerate(hunks))
        row = got[n]
        assert (row["status"], row["files_checkable"], row["files_errored"]) == ("ok", len(hunks), bad), n
        assert (row["files_parsed"], row["score"]) == (len(hunks) - bad, (len(hunks) - bad) / len(hunks))
        errors += bad
    assert 0 < errors


def test_texts_reach_the_parser_by_the_hundred(spark):
    """An Arrow batch holds thousands of whole texts, in several copies in each worker."""
    for name in ("syntax_free_text", "syntax_whole_files"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan, name


def test_feedback_gets_its_texts_by_the_hundred(spark):
    for name in ("syntax_feedback", "syntax_score", "syntax_check"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan, name
