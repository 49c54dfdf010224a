"""Unified diffs applied to stored base files.

A patch is cut into file sections inside its row; each section meets its base
file in a join by (repo, commit, path), and the new text is put together with array
functions from the lines of the base between the hunks and the hunks' own lines.

Rules of application:

- A hunk's old lines (context and removed ones, with their line ends) must be in the base
  exactly. They are looked for where the header says, moved by as much as the
  hunk before had to be moved, then at the nearest place after the hunks before; of two
  places equally near the later one is taken.
- A hunk of the first line or of an empty file must match at the start of the file, one
  without context behind its last change at the end.
- A hunk whose lines are not as many as its header says makes its section malformed.
- A patch is applied as a whole or not at all: one section that can't be applied keeps
  the others' texts from counting (`whole` is false), but they are given.

Null or empty patches have no sections. Base files are unique by (repo, commit, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.patches import header_path
from runlens.functions.text import let
from runlens.operators.skew import join_replicated
from runlens.session import materialize

OLD, NEW = "--- ", "+++ "
NOWHERE = "/dev/null"
#: Numbers of a hunk header: old start, old count, new start, new count.
HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_TEXTS = "array<string>"


def _starts(line: Column, prefix: str) -> Column:
    return F.startswith(line, F.lit(prefix))


def _old_path(line: Column) -> Column:
    """The path behind `--- `, without its `a/` and a time stamp behind a tab."""
    bare = F.split_part(F.substr(line, F.lit(5)), F.lit("\t"), F.lit(1))
    return F.when(_starts(bare, "a/"), F.substr(bare, F.lit(3))).otherwise(bare)


def whole_lines(text: Column) -> Column:
    """Lines with their line feeds, so that a missing last one is a difference."""
    return F.filter(F.split(text, "(?<=\n)", -1), lambda line: line != "")


def _hunk(lines: Column, head: Column, end: Column) -> Column:
    """One hunk: its header's numbers, old and new lines, and whether the numbers hold."""

    def number(group: int, absent: int | None) -> Column:
        found = F.nullif(F.regexp_extract(F.get(lines, head), HEADER, group), F.lit("")).try_cast("int")
        return found if absent is None else F.coalesce(found, F.lit(absent))

    def from_body(body: Column) -> Column:
        def side(mark: str) -> Column:
            """Context lines and those with the mark; a marker behind a line takes its line feed away."""
            placed = F.transform(
                body,
                lambda line, i: F.struct(
                    line.alias("line"), F.coalesce(_starts(F.get(body, i + 1), "\\"), F.lit(False)).alias("open")
                ),
            )
            wanted = F.filter(
                placed, lambda x: _starts(x["line"], mark) | _starts(x["line"], " ") | (x["line"] == "")
            )
            return F.transform(
                wanted,
                lambda x: F.concat(F.substr(x["line"], F.lit(2)), F.when(x["open"], "").otherwise("\n")),
            )

        real = F.filter(body, lambda line: ~_starts(line, "\\"))
        last = F.coalesce(F.try_element_at(real, F.lit(-1)), F.lit("+"))
        return let(
            F.struct(side("-").alias("old"), side("+").alias("new")),
            lambda both: F.struct(
                number(1, None).alias("old_start"),
                number(3, None).alias("new_start"),
                both["old"].alias("old"),
                both["new"].alias("new"),
                (number(1, None) <= 1).alias("at_start"),
                (_starts(last, "+") | _starts(last, "-")).alias("at_end"),
                F.coalesce(
                    (F.size(both["old"]) == number(2, 1)) & (F.size(both["new"]) == number(4, 1)), F.lit(False)
                ).alias("sound"),
            ),
        )

    return let(F.slice(lines, head + 2, end - head - 1), from_body)


def file_sections(patch: Column) -> Column:
    """array of (file_no, old_path, new_path, hunks) of a patch, in order.

    A section starts at `--- ` and `+++ ` lines with a hunk header behind them. Lines behind a
    hunk that can't belong to it (such as the next `diff --git`) are left out.
    """

    def from_lines(lines: Column) -> Column:
        def is_section(line: Column, i: Column) -> Column:
            return (
                _starts(line, OLD)
                & F.coalesce(_starts(F.get(lines, i + 1), NEW), F.lit(False))
                & F.coalesce(_starts(F.get(lines, i + 2), "@@"), F.lit(False))
            )

        def places(found) -> Column:
            return F.filter(F.transform(lines, lambda line, i: F.when(found(line, i), i)), lambda i: i.isNotNull())

        def from_places(at: Column) -> Column:
            def section(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(at["sections"], k + 1), F.size(lines))

                def hunks(bounds: Column) -> Column:
                    heads = F.filter(at["heads"], lambda h: (h > bounds["start"]) & (h < bounds["end"]))

                    def from_heads(own: Column) -> Column:
                        def one(head: Column, j: Column) -> Column:
                            upto = F.coalesce(F.get(own, j + 1), bounds["end"])
                            body = F.slice(lines, head + 2, upto - head - 1)
                            foreign = F.transform(
                                body, lambda line, n: F.when(~line.rlike(r"\A([ +\\-]|\z)"), n)
                            )
                            cut = F.coalesce(F.array_min(foreign), F.size(body))
                            return let(cut, lambda n: _hunk(lines, head, head + 1 + n))

                        return F.transform(own, one)

                    return let(heads, from_heads)

                return F.struct(
                    k.alias("file_no"),
                    _old_path(F.get(lines, start)).alias("old_path"),
                    header_path(F.get(lines, start + 1)).alias("new_path"),
                    let(F.struct(start.alias("start"), end.alias("end")), hunks).alias("hunks"),
                )

            return F.transform(at["sections"], section)

        found = F.struct(
            places(is_section).alias("sections"), places(lambda line, _: _starts(line, "@@")).alias("heads")
        )
        return let(found, from_places)

    bare = F.coalesce(patch, F.lit(""))
    closed = F.when(F.endswith(bare, F.lit("\n")), F.left(bare, F.length(bare) - 1)).otherwise(bare)
    return let(F.split(closed, "\n", -1), from_lines)


def _place(base: Column, hunk: Column, first: Column, shift: Column) -> Column:
    """0-based line of `base` from `first` on at which the hunk's old lines stand, null when nowhere."""
    old = hunk["old"]

    def from_limits(limits: Column) -> Column:
        def fits(at: Column) -> Column:
            return (
                (at >= first)
                & (at <= limits["last"])
                & (~hunk["at_start"] | (at == 0))
                & (~hunk["at_end"] | (at == limits["last"]))
                & (F.slice(base, at + 1, F.size(old)) == old)
            )

        def from_expected(expected: Column) -> Column:
            some = F.when(limits["last"] >= first, F.sequence(first, limits["last"]))
            likely = F.filter(some, lambda at: F.get(base, at) == F.get(old, F.lit(0)))
            places = F.transform(
                F.filter(likely, fits), lambda at: F.struct(F.abs(at - expected).alias("far"), (-at).alias("back"))
            )
            return F.when(F.coalesce(fits(expected), F.lit(False)), expected).otherwise(-F.array_min(places)["back"])

        return let(F.greatest(hunk["old_start"] - 1, F.lit(0)) + shift, from_expected)

    return let(F.struct((F.size(base) - F.size(old)).alias("last")), from_limits)


def _walked(base: Column, hunks: Column) -> Column:
    """The hunks applied one after the other: pieces of the new text, moves and rejected hunks."""
    start = F.struct(
        F.lit(0).alias("done"),
        F.lit(0).alias("shift"),
        F.array().cast("array<int>").alias("moves"),
        F.array().cast("array<int>").alias("rejected"),
        F.array().cast(_TEXTS).alias("pieces"),
    )

    def step(state: Column, hunk: Column) -> Column:
        def taken(at: Column) -> Column:
            between = F.array_join(F.slice(base, state["done"] + 1, at - state["done"]), "")
            expected = F.greatest(hunk["old_start"] - 1, F.lit(0))
            hit = F.struct(
                (at + F.size(hunk["old"])).alias("done"),
                (at - expected).alias("shift"),
                F.array_append(state["moves"], at - expected).alias("moves"),
                state["rejected"].alias("rejected"),
                F.array_append(
                    F.array_append(state["pieces"], between), F.array_join(hunk["new"], "")
                ).alias("pieces"),
            )
            miss = F.struct(
                state["done"].alias("done"),
                state["shift"].alias("shift"),
                F.array_append(state["moves"], F.lit(None).cast("int")).alias("moves"),
                F.array_append(state["rejected"], F.size(state["moves"])).alias("rejected"),
                state["pieces"].alias("pieces"),
            )
            return F.when(at.isNotNull(), hit).otherwise(miss)

        return let(_place(base, hunk, state["done"], state["shift"]), taken)

    def finish(state: Column) -> Column:
        rest = F.slice(base, state["done"] + 1, F.size(base) - state["done"])
        return F.struct(
            F.concat(F.array_join(state["pieces"], ""), F.array_join(rest, "")).alias("text"),
            state["moves"].alias("moves"),
            state["rejected"].alias("rejected"),
        )

    return F.aggregate(hunks, start, step, finish)


def patch_sections(patches: DataFrame, key: str, patch: str = "patch_diff") -> DataFrame:
    """One row per file section: key, repo, commit, file_no, old_path, new_path, hunks."""
    return patches.select(key, "repo", "commit", F.explode(file_sections(F.col(patch))).alias("s")).select(
        key, "repo", "commit", "s.*"
    )


def apply_sections(sections: DataFrame, bases: DataFrame, key: str) -> DataFrame:
    """Sections with the text they lead to.

    `bases` has repo, commit, path and content. `outcome` is modified, created, deleted, or why not:
    missing (no base file), exists (the file to be created is there), malformed, rejected (a hunk
    is nowhere, or the deleted file keeps lines). `moves` says how far each hunk was from its header's
    place, `rejected` which ones were not found; `new_text` is null unless a file comes out.
    """
    created = F.col("old_path") == NOWHERE
    wanted = sections.withColumn("path", F.when(created, F.col("new_path")).otherwise(F.col("old_path")))
    # Stored, since the join counts its keys first: patches are taken apart once.
    joined = join_replicated(
        materialize(wanted, "sections"), bases.select("repo", "commit", "path", "content"), ["repo", "commit", "path"]
    )
    base = F.when(created, F.array().cast(_TEXTS)).otherwise(whole_lines(F.col("content")))
    sound = F.forall("hunks", lambda h: h["sound"])
    ready = sound & (created == F.col("content").isNull())
    done = joined.withColumn(
        "_done", F.when(ready, let(base, lambda lines: _walked(lines, F.col("hunks"))))
    )
    left = F.length("_done.text") > 0
    outcome = (
        F.when(~created & F.col("content").isNull(), "missing")
        .when(created & F.col("content").isNotNull(), "exists")
        .when(~sound, "malformed")
        .when((F.size("_done.rejected") > 0) | ((F.col("new_path") == NOWHERE) & left), "rejected")
        .when(created, "created")
        .when(F.col("new_path") == NOWHERE, "deleted")
        .otherwise("modified")
    )
    return done.select(
        key,
        "file_no",
        F.when(F.col("new_path") == NOWHERE, F.col("old_path")).otherwise(F.col("new_path")).alias("path"),
        outcome.alias("outcome"),
        F.size("hunks").alias("hunks"),
        F.col("_done.moves").alias("moves"),
        F.col("_done.rejected").alias("rejected"),
        F.when(outcome.isin("modified", "created"), F.col("_done.text")).alias("new_text"),
    )


APPLIED = ("modified", "created", "deleted")


def apply_patches(patches: DataFrame, bases: DataFrame, key: str, patch: str = "patch_diff") -> DataFrame:
    """One row per patch: `whole` and its `sections` (file_no, path, outcome, hunks, moves, rejected, new_text).

    `key` is unique. `whole` is true if there is a section, all were applied and no path comes twice.
    """
    sections = apply_sections(patch_sections(patches, key, patch), bases, key)
    fields = [c for c in sections.columns if c != key]
    gathered = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sections"))
    all_applied = F.forall("sections", lambda s: s["outcome"].isin(*APPLIED))
    once = F.size(F.array_distinct(F.transform("sections", lambda s: s["path"]))) == F.size("sections")
    return (
        patches.join(gathered, key, "left")
        .withColumn("whole", F.coalesce(all_applied & once, F.lit(False)))
        .select(*patches.columns, "whole", "sections")
    )
