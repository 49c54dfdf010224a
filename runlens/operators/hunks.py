"""New-file content of unified diffs, hunk by hunk.

A patch is taken apart inside its own row with array functions, so nothing is
shuffled and a patch is never spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.patches import FILE_HEADER, header_path
from runlens.functions.text import let, py_splitlines

HUNK_HEADER = r"@@ -\p{Nd}+(?:,\p{Nd}+)? \+(\p{Nd}+)(?:,\p{Nd}+)? @@"


def _starts(line: Column, prefix: str) -> Column:
    return F.startswith(line, F.lit(prefix))


def _places(lines: Column, wanted) -> Column:
    """0-based places of the lines for which `wanted` holds."""
    marked = F.transform(lines, lambda line, i: F.when(wanted(line), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _is_body(line: Column) -> Column:
    """Lines that may stand inside a hunk; any other one closes the file."""
    added = _starts(line, "+") & ~_starts(line, "+++")
    return added | _starts(line, " ") | _starts(line, "-") | _starts(line, "\\")


def _records(body: Column) -> Column:
    """Added and context lines as (prefix, text)."""
    kept = F.filter(
        body, lambda line: (_starts(line, "+") & ~_starts(line, "+++")) | _starts(line, " ")
    )
    return F.transform(
        kept,
        lambda line: F.struct(
            F.left(line, F.lit(1)).alias("prefix"), F.substr(line, F.lit(2)).alias("text")
        ),
    )


def _new_start(header: Column) -> Column:
    digits = F.nullif(F.regexp_extract(header, HUNK_HEADER, 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(1))


def _section_hunks(section: Column, keep_open: bool) -> Column:
    """Hunks of one file section: array of (new_start, records).

    A line that cannot belong to a hunk (such as the next `diff --git`) ends
    the file, and the hunk still open at that line is lost unless `keep_open`.
    """

    def from_lines(lines: Column) -> Column:
        def from_heads(heads: Column) -> Column:
            first = F.get(heads, F.lit(0))
            foreign = F.filter(
                _places(lines, lambda line: ~_is_body(line) & ~_starts(line, "@@")),
                lambda i: i > first,
            )
            stop = F.coalesce(F.get(foreign, F.lit(0)), F.size(lines))

            def bounded(end: Column) -> Column:
                live = F.filter(heads, lambda h: h < end)
                closed = (
                    live
                    if keep_open
                    else F.when(
                        end < F.size(lines), F.slice(live, F.lit(1), F.greatest(F.size(live) - 1, F.lit(0)))
                    ).otherwise(live)
                )
                return F.transform(
                    closed,
                    lambda head, i: F.struct(
                        _new_start(F.get(lines, head)).alias("new_start"),
                        _records(
                            F.slice(
                                lines,
                                head + 2,
                                F.coalesce(F.get(live, i + 1), end) - head - 1,
                            )
                        ).alias("records"),
                    ),
                )

            return F.when(F.size(heads) > 0, let(stop, bounded))

        return let(_places(lines, lambda line: _starts(line, "@@")), from_heads)

    bare = F.filter(section, lambda line: ~_starts(line, "--- "))
    found = F.coalesce(
        let(bare, from_lines),
        F.array().cast("array<struct<new_start:int,records:array<struct<prefix:string,text:string>>>>"),
    )
    return F.filter(found, lambda hunk: F.size(hunk["records"]) > 0)


def path_suffixes(path: Column) -> Column:
    """The path and what follows each of its slashes."""
    return let(
        F.split(path, "/", -1),
        lambda parts: F.transform(
            parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts) - i), "/")
        ),
    )


def last_sections(paths: Column, wanted: Column) -> Column:
    """For each wanted path the 0-based place of the last of `paths` that equals it or ends in `/path`.

    All suffixes of the paths and the wanted paths are sorted together. Equal
    names then stand side by side, so each group of them is looked at once and
    a patch of many files costs little more than their number.
    """

    def entry(name: Column, place: Column | None, asked: Column | None) -> Column:
        return F.struct(
            name.alias("name"),
            (F.lit(None).cast("int") if place is None else place).alias("place"),
            (F.lit(None).cast("int") if asked is None else asked).alias("asked"),
        )

    known = F.flatten(
        F.transform(
            paths, lambda p, i: F.transform(path_suffixes(p), lambda name: entry(name, i, None))
        )
    )
    asked = F.transform(wanted, lambda name, i: entry(name, None, i))

    def from_names(names: Column) -> Column:
        def is_first(_: Column, i: Column) -> Column:
            return (i == 0) | ~F.get(names, i)["name"].eqNullSafe(F.get(names, i - 1)["name"])

        def from_firsts(firsts: Column) -> Column:
            def answers(first: Column, k: Column) -> Column:
                end = F.coalesce(F.get(firsts, k + 1), F.size(names))

                def of_group(group: Column) -> Column:
                    last = F.array_max(F.transform(group, lambda e: e["place"]))
                    return F.transform(
                        F.filter(group, lambda e: e["asked"].isNotNull()),
                        lambda e: F.struct(e["asked"].alias("asked"), last.alias("place")),
                    )

                return let(F.slice(names, first + 1, end - first), of_group)

            return F.transform(
                F.array_sort(F.flatten(F.transform(firsts, answers))), lambda a: a["place"]
            )

        marked = F.transform(names, lambda e, i: F.when(is_first(e, i), i))
        return let(F.filter(marked, lambda i: i.isNotNull()), from_firsts)

    return let(F.array_sort(F.concat(known, asked)), from_names)


def patch_files(
    patch: Column, files: Column | None = None, suffix: str = ".py", keep_open: bool = False
) -> Column:
    """array of (path, in_diff, hunks) for the files to check.

    `files` defaults to the patch's own changed files; only paths ending in
    `suffix` are taken. A path is looked up among the patch's sections: equal
    or ending in `/path`, and the last matching section counts (`last_sections`).
    """

    def from_lines(lines: Column) -> Column:
        def from_heads(heads: Column) -> Column:
            sections = F.transform(
                heads,
                lambda head, i: F.struct(
                    header_path(F.get(lines, head)).alias("path"),
                    (head + 2).alias("start"),
                    (F.coalesce(F.get(heads, i + 1), F.size(lines)) - head - 1).alias("size"),
                ),
            )

            def from_sections(known: Column) -> Column:
                paths = F.transform(known, lambda s: s["path"])
                listed = files
                if listed is None:
                    listed = F.filter(paths, lambda p: p != "/dev/null")
                wanted = F.filter(listed, lambda p: F.endswith(p, F.lit(suffix)))

                def one(path: Column, at: Column) -> Column:
                    return let(
                        F.get(known, at),
                        lambda s: F.struct(
                            path.alias("path"),
                            s.isNotNull().alias("in_diff"),
                            F.when(
                                s.isNotNull(),
                                _section_hunks(
                                    F.slice(lines, s["start"], s["size"]), keep_open
                                ),
                            ).alias("hunks"),
                        ),
                    )

                return let(wanted, lambda w: F.zip_with(w, last_sections(paths, w), one))

            return let(sections, from_sections)

        return let(_places(lines, lambda line: _starts(line, FILE_HEADER)), from_heads)

    return let(py_splitlines(F.coalesce(patch, F.lit(""))), from_lines)


def explode_hunks(
    patches: DataFrame, key: str, patch: str = "patch_diff", keep_open: bool = False
) -> DataFrame:
    """One row per new-file line: file, hunk and line number, prefix and text."""
    files = patches.select(
        key, F.posexplode(patch_files(F.col(patch), keep_open=keep_open)).alias("file_no", "f")
    )
    hunks = files.select(
        key, "file_no", F.col("f.path").alias("file"), F.posexplode("f.hunks").alias("hunk_no", "h")
    )
    return hunks.select(
        key,
        "file_no",
        "file",
        "hunk_no",
        F.col("h.new_start").alias("new_start"),
        F.posexplode("h.records").alias("_line", "r"),
    ).select(
        key,
        "file_no",
        "file",
        "hunk_no",
        "new_start",
        (F.col("_line") + 1).alias("line_no"),
        F.col("r.prefix").alias("prefix"),
        F.col("r.text").alias("text"),
    )
