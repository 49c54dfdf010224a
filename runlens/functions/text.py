"""String building blocks that follow Python's text rules inside Catalyst.

Positions are counted in code points throughout (`position`, `length`,
`substr`); regex offsets count UTF-16 units and are never mixed in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What str.strip() and \s treat as blank; Spark's own trim drops U+0020 only.
PY_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
SPACE_CLASS = f"[{PY_SPACE}]"

# What str.splitlines() breaks on, the plain line feed apart.
RARE_BREAKS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = f"\r\n|[\n{RARE_BREAKS}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times in `body`.

    Without the binding Catalyst may inline a costly expression into a lambda
    and run it again for every array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_SPACE))


def py_splitlines(text: Column) -> Column:
    """Lines without their ends; a final line break opens no further line."""
    any_closed = F.regexp_replace(text, F.lit(f"(?:{LINE_BREAK})\\z"), F.lit(""))
    feed_closed = F.when(
        F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)
    ).otherwise(text)
    # Byte searches and a split on one plain character are several times
    # cheaper than a pattern, and the other line ends are rare.
    rare = reduce(or_, [F.contains(text, F.lit(end)) for end in RARE_BREAKS])
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(rare, F.split(any_closed, LINE_BREAK, -1))
        .otherwise(F.split(feed_closed, "\n", -1))
    )


def find(text: Column, needle: str, start: Column | int = 1) -> Column:
    """1-based position of `needle` from `start` on, 0 when absent."""
    begin = F.lit(start) if isinstance(start, int) else start
    return F.position(F.lit(needle), text, begin)


def first_match(text: Column, pattern: str) -> Column:
    """struct(found, at): text of the first match (or null) and its place (or 0).

    The matched text cannot stand earlier than the match itself, so looking it
    up gives its place in code points.
    """
    return let(
        F.regexp_substr(text, F.lit(pattern)),
        lambda found: F.struct(
            found.alias("found"), F.coalesce(F.position(found, text), F.lit(0)).alias("at")
        ),
    )


def last_match(text: Column, pattern: str, group: int) -> Column:
    """The last match of `pattern`, null when there is none."""
    return F.try_element_at(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1)
    )


def word_count(text: Column) -> Column:
    """Whitespace tokens, the default token counter."""
    bare = py_strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(
        F.size(F.split(bare, f"{SPACE_CLASS}+", -1))
    )
