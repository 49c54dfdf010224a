"""Facts read off a unified diff without expanding it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import py_splitlines

FILE_HEADER = "+++ "


def header_path(line: Column) -> Column:
    """Path on a new-file header line, without the `b/` in front."""
    path = F.substr(line, F.lit(len(FILE_HEADER) + 1))
    return F.when(F.startswith(path, F.lit("b/")), F.substr(path, F.lit(3))).otherwise(path)


def changed_files(patch: Column) -> Column:
    """Changed paths in order of appearance, repeats kept, deletions left out."""
    headers = F.filter(py_splitlines(patch), lambda line: F.startswith(line, F.lit(FILE_HEADER)))
    return F.filter(F.transform(headers, header_path), lambda path: path != "/dev/null")


def patch_stats(patch: Column) -> Column:
    """struct(patch_lines, files_changed, empty_patch)."""
    text = F.coalesce(patch, F.lit(""))
    git_lines = F.filter(
        py_splitlines(text),
        lambda line: F.startswith(line, F.lit("diff --git ")) & F.contains(line, F.lit(" b/")),
    )
    paths = F.transform(
        git_lines, lambda line: F.substr(line, F.position(F.lit(" b/"), line) + 3)
    )
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.struct(
        breaks.alias("patch_lines"),
        F.size(F.array_distinct(paths)).alias("files_changed"),
        (F.length(text) == 0).alias("empty_patch"),
    )
