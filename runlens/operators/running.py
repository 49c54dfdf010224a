"""Running values inside ordered groups of any size.

A plain window sorts a whole group in one task. Here the integer position cuts
a group into chunks: each chunk is a window of its own, and only one row per
chunk takes part in the window that carries values across chunks. A session
that fits into one chunk adds nothing to the carried side, which is then empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
_CHUNK_COL = "_chunk"

_KINDS = ("sum", "count", "max", "first", "last")


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add one running column per entry of `values` (name -> (kind, expression)).

    `position` is a non-negative integer, unique inside a group. With
    `inclusive=False` the current row is left out. Kinds: sum and count start
    at 0; max, first and last start at null and skip nulls.
    """
    for kind, _ in values.values():
        if kind not in _KINDS:
            raise ValueError(f"unknown running kind '{kind}'")
    chunked = df.withColumn(_CHUNK_COL, F.floor(F.col(position) / chunk))
    groups = [*keys, _CHUNK_COL]
    frame = (
        Window.partitionBy(*groups)
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    inner = chunked.select(
        "*",
        *[_merge(kind, expr).over(frame).alias(f"_in_{name}") for name, (kind, expr) in values.items()],
    )

    totals = chunked.groupBy(*groups).agg(
        *[_total(kind, expr, position).alias(name) for name, (kind, expr) in values.items()],
    )
    before = Window.partitionBy(*keys).orderBy(_CHUNK_COL).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *groups,
        *[
            _merge("sum" if kind == "count" else kind, F.col(name)).over(before).alias(f"_base_{name}")
            for name, (kind, _) in values.items()
        ],
        F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(_CHUNK_COL)).alias("_follows"),
    ).where("_follows").drop("_follows")

    # Null keys form a group like any other.
    renamed = carried.withColumnsRenamed({g: f"_of_{g}" for g in groups})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    same.append(F.col(_CHUNK_COL) == F.col(f"_of_{_CHUNK_COL}"))
    joined = inner.join(renamed, same, "left")
    return joined.select(
        *df.columns,
        *[
            _combine(kind, F.col(f"_base_{name}"), F.col(f"_in_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def _merge(kind: str, expr: Column) -> Column:
    if kind == "sum":
        return F.sum(expr)
    if kind == "count":
        return F.count(expr)
    if kind == "max":
        return F.max(expr)
    return (F.first if kind == "first" else F.last)(expr, ignorenulls=True)


def _total(kind: str, expr: Column, position: str) -> Column:
    if kind == "first":
        return F.min_by(expr, F.when(expr.isNotNull(), F.col(position)))
    if kind == "last":
        return F.max_by(expr, F.when(expr.isNotNull(), F.col(position)))
    return _merge(kind, expr)


def _combine(kind: str, base: Column, inner: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(base, F.lit(0)) + F.coalesce(inner, F.lit(0))
    if kind == "max":
        return F.greatest(base, inner)
    return F.coalesce(base, inner) if kind == "first" else F.coalesce(inner, base)
