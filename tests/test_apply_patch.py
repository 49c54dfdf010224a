import difflib
import random

import pytest
from pyspark.sql import functions as F
from runlens.operators import apply_patch, skew, syntax
from runlens.operators.hunks import last_sections
from runlens.plans import QUERIES

PATCH = "key long, repo string, commit string, patch_diff string"
BASE = "repo string, commit string, path string, content string"


def run(spark, patches, bases):
    df = spark.createDataFrame(patches, PATCH)
    rows = apply_patch.apply_patches(df, spark.createDataFrame(bases, BASE), "key").collect()
    return {r["key"]: (r["whole"], [s.asDict() for s in r["sections"] or []]) for r in rows}


def diff(old, new, path="f.py", context=3):
    lines = [x.splitlines(keepends=True) for x in (old, new)]
    out = []
    for line in difflib.unified_diff(*lines, f"a/{path}", f"b/{path}", n=context):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


def edited(rng, text):
    lines = text.splitlines(keepends=True)
    for _ in range(rng.randint(1, 4)):
        at = rng.randint(0, len(lines))
        lines[at : at + rng.randint(0, 2)] = [rng.choice("abcxyz") + "\n" for _ in range(rng.randint(0, 3))]
    return "".join(lines)


def file_of(rng, n):
    text = "".join(rng.choice("abcdefgh") * rng.randint(0, 2) + "\n" for _ in range(n))
    return text[:-1] if text and rng.random() < 0.3 else text


def plain_apply(base, patch):
    """New text of a one-file patch by stepping through it, or None."""
    lines = base.splitlines(keepends=True)
    out, done, shift = [], 0, 0
    rows = patch.splitlines()[2:]
    hunks = []
    for row in rows:
        if row.startswith("@@"):
            first = int(row.split()[1].split(",")[0][1:])
            hunks.append((first, []))
        elif row.startswith("\\"):
            mark, text = hunks[-1][1][-1]
            hunks[-1][1][-1] = (mark, text[:-1])
        else:
            hunks[-1][1].append((row[:1] or " ", row[1:] + "\n"))
    for first, body in hunks:
        old = [t for m, t in body if m in " -"]
        new = [t for m, t in body if m in " +"]
        last = len(lines) - len(old)
        fits = [
            at for at in range(done, last + 1)
            if lines[at : at + len(old)] == old and (first > 1 or at == 0) and (body[-1][0] == " " or at == last)
        ]
        if not fits:
            return None
        at = min(fits, key=lambda x: (abs(x - max(first - 1, 0) - shift), -x))
        out += lines[done:at] + new
        done, shift = at + len(old), at - max(first - 1, 0)
    return "".join(out + lines[done:])


def test_diffs_of_random_files_come_out_again(spark):
    rng = random.Random(6)
    patches, bases, want = [], [], {}
    for key in range(150):
        old = file_of(rng, rng.choice([0, 1, 3, 12, 60]))
        new = edited(rng, old)
        if old == new:
            continue
        patches.append((key, "r", str(key), diff(old, new)))
        bases.append(("r", str(key), "f.py", old))
        want[key] = new
    got = run(spark, patches, bases)
    for key, text in want.items():
        whole, (section,) = got[key]
        assert whole and section["outcome"] == "modified" and section["new_text"] == text, key
        assert not any(section["moves"]) and section["rejected"] == []


def test_diffs_on_changed_files_against_a_plain_applier(spark):
    rng = random.Random(9)
    patches, bases, want = [], [], {}
    for key in range(200):
        old = file_of(rng, rng.choice([5, 12, 60]))
        patch = diff(old, edited(rng, old), context=rng.choice([1, 2, 3]))
        if not patch:
            continue
        now = edited(rng, old)
        patches.append((key, "r", str(key), patch))
        bases.append(("r", str(key), "f.py", now))
        want[key] = plain_apply(now, patch)
    got = run(spark, patches, bases)
    outcomes = set()
    for key, text in want.items():
        whole, (section,) = got[key]
        outcomes.add((text is None, any(section["moves"] or [])))
        assert section["new_text"] == text and whole == (text is not None), key
        assert bool(section["rejected"]) == (text is None)
    assert len(outcomes) > 2


def test_outcomes(spark):
    old = "a\nb\nc\nd\ne\n"
    change = diff(old, old.replace("c", "C"))
    new_file = "--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+x\n+y\n\\ No newline at end of file\n"
    gone = "--- a/f.py\n+++ /dev/null\n@@ -1,5 +0,0 @@\n-a\n-b\n-c\n-d\n-e\n"
    renamed = change.replace("+++ b/f.py", "+++ b/g.py")
    bases = [("r", "c", "f.py", old), ("r", "c", "there.py", "z\n"), ("r", "d", "f.py", old + "more\n")]
    cases = [
        (0, "c", change, True, ["modified"]),
        (1, "c", new_file, True, ["created"]),
        (2, "c", gone, True, ["deleted"]),
        (3, "c", renamed, True, ["modified"]),
        (4, "none", change, False, ["missing"]),
        (5, "c", new_file.replace("n.py", "there.py"), False, ["exists"]),
        (6, "c", change.replace("-1,5", "-1,6"), False, ["malformed"]),
        (7, "c", change.replace("\n a\n", "\n q\n"), False, ["rejected"]),
        (8, "d", gone, False, ["rejected"]),
        (9, "c", "diff --git a/f.py b/f.py\nindex 1..2\n" + change + "diff --git a/n.py b/n.py\n" + new_file, True, ["modified", "created"]),
        (10, "c", change + change, False, ["modified", "modified"]),
        (11, "c", change + new_file.replace("n.py", "there.py"), False, ["modified", "exists"]),
        (12, "c", None, False, []),
        (13, "c", "no patch", False, []),
        (14, None, change, False, ["missing"]),
        (15, "c", change.replace("@@ -1,5 +1,5 @@", "@@ -x +y @@"), False, ["malformed"]),
    ]
    got = run(spark, [(k, "r", c, p) for k, c, p, _, _ in cases], bases)
    for key, _, _, whole, outcomes in cases:
        assert (got[key][0], [s["outcome"] for s in got[key][1]]) == (whole, outcomes), key
    assert got[1][1][0]["new_text"] == "x\ny" and got[3][1][0]["path"] == "g.py"
    assert got[7][1][0]["rejected"] == [0] and got[7][1][0]["new_text"] is None
    assert got[9][1][0]["new_text"] == "a\nb\nC\nd\ne\n"


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, "r", "c", diff("a\n", "b\n"))], []) == {1: (False, run(spark, [(1, "r", "c", diff("a\n", "b\n"))], [])[1][1])}


@pytest.mark.parametrize("slot_rows", [1000, 3])
def test_join_of_hot_keys(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(skew, "SLOT_ROWS", slot_rows)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}", i % 2) for i in range(60)] + [(99, None, 0)], "i int, k string, m int")
    table = spark.createDataFrame([("hot", 0, "big"), ("hot", 1, "bigger"), ("k0", 0, "x"), (None, 0, "never")], "k string, m int, v string")
    got = sorted((r["i"], r["v"]) for r in skew.join_replicated(rows, table, ["k", "m"]).collect())
    known = {("hot", 0): "big", ("hot", 1): "bigger", ("k0", 0): "x"}
    assert got == sorted((r["i"], known.get((r["k"], r["m"]))) for r in rows.collect())


def test_last_sections_against_plain_search(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(150):
        paths = ["/".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 7))]
        wanted = [rng.choice([*paths, "a", "b/a", "", "x", "/a"]) for _ in range(rng.randint(0, 6))]
        rows.append((paths, wanted))
    df = spark.createDataFrame(rows, "paths array<string>, wanted array<string>")
    for r in df.withColumn("got", last_sections(F.col("paths"), F.col("wanted"))).collect():
        want = [max((i for i, p in enumerate(r["paths"]) if p == w or p.endswith("/" + w)), default=None) for w in r["wanted"]]
        assert r["got"] == want, r


def test_verdicts_over_whole_files(spark):
    base = 'def f():\n    """words that\n    are no code\n    at all\n    """\n    return 1\n'
    good = diff(base, base.replace("are no", "are not"), context=1)
    bad = diff(base, base.replace("return 1", "return (1"), "f.py")
    text = "--- /dev/null\n+++ b/n.txt\n@@ -0,0 +1 @@\n+note\n"
    crash = "--- /dev/null\n+++ b/deep.py\n@@ -0,0 +1 @@\n+" + "(" * 150 + "1" + ")" * 150 + "\n"
    gone = diff(base, "").replace("+++ b/f.py", "+++ /dev/null")
    cases = [
        (0, "c", good, "full_file", "ok", 1.0),
        (1, "c", bad, "full_file", "ok", 0.0),
        (2, "other", bad, "hunk", "ok", 0.0),
        (3, "c", text, "full_file", "skipped", 1.0),
        (4, "c", None, "hunk", "skipped", 1.0),
        (5, "c", bad + text, "full_file", "ok", 0.0),
        (6, "c", gone, "full_file", "skipped", 1.0),
        (7, "c", crash, "full_file", "ok", 1.0),
        (8, "other", good, "hunk", "ok", 0.0),
    ]
    patches = spark.createDataFrame([(k, "r", c, p) for k, c, p, *_ in cases], PATCH)
    bases = spark.createDataFrame([("r", "c", "f.py", base)], BASE)
    verdicts = syntax.whole_file_verdicts(patches, bases, "key")
    rows = {r["key"]: r for r in syntax.syntax_feedback(verdicts).collect()}
    for key, _, _, method, status, score in cases:
        assert (rows[key]["method"], rows[key]["status"], rows[key]["score"]) == (method, status, score), key
    (error,) = rows[1]["errors"]
    assert (error["file"], error["line"], error["offset"]) == ("f.py", 6, 12)
    assert error["snippet"] == '           4       at all\n           5       """\n    -->    6       return (1'
    assert rows[1]["feedback"].splitlines()[1] == "  - f.py: line 6, offset 12: '(' was never closed"
    assert rows[0]["feedback"].endswith("no syntax errors detected")


@pytest.mark.parametrize(
    "source, ending",
    [("x = 1", "fine"), ("  x = 1", "shifted"), ("x = = 1", "broken"), ("if x:\n  a\n b", "broken"), ("", "fine"), (" \tx\n\ty", "shifted")],
)
def test_reading_of_a_source(source, ending):
    """An indentation error of the first line is told by its class: the messages of others never speak of indents there."""
    found, error = syntax.read_source(source)
    assert found == ending
    if error is not None and error.lineno == 1:
        assert ("indent" in error.msg.lower()) == isinstance(error, IndentationError)


def test_patches_are_taken_apart_once(spark):
    """The join counts its keys before it joins; the sections must not be made for both."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    patches = spark.createDataFrame([(k, "r", "c", diff("a\n", "b\n")) for k in range(20)], PATCH)
    read = patches.withColumn("patch_diff", F.udf(counted, "string")("patch_diff"))
    bases = spark.createDataFrame([("r", "c", "f.py", "a\n")], BASE)
    rows = apply_patch.apply_sections(apply_patch.patch_sections(read, "key"), bases, "key").collect()
    assert {r["new_text"] for r in rows} == {"b\n"} and len(rows) == 20
    assert seen.value == 20


@pytest.mark.parametrize("name", ["syntax_check", "syntax_whole_file_errors"])
def test_sources_are_read_once(spark, name):
    """An emptiness test pushed below the parser made it run twice."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython [") == 1


def test_patches_without_errors_have_no_reports(spark):
    base = "x = 1\n"
    cases = [(0, "r", "c", diff(base, "x = 2\n")), (1, "r", "c", diff(base, "x = (\n")), (2, "r", "c", None)]
    verdicts = syntax.whole_file_verdicts(
        spark.createDataFrame(cases, PATCH), spark.createDataFrame([("r", "c", "f.py", base)], BASE), "key"
    )
    (row,) = syntax.syntax_reports(verdicts, "key").collect()
    assert (row["key"], row["file"], row["line"]) == (1, "f.py", 1)
