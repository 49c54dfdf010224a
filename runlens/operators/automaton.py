"""Finite automata over ordered groups of any size, by an associative scan.

A row is a function from states to states (an array: the next state for each one).
Functions one after the other are again such an array, and putting them together is
associative. So a group is cut into chunks by position: each chunk is folded
into one function (and one sum per amount), the chunks' functions are scanned in the
same way until one chunk is left, and then every chunk is walked from the state it starts
in. A task holds CHUNK rows at a time, and what carries over is one row per chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import let
from runlens.session import materialize

CHUNK = 1024


def transition(states: int, rules: Mapping[int, Column | int]) -> Column:
    """The function that sends each state of `rules` to its value and leaves the others as they are."""
    return F.array(*[(rules[s] if isinstance(rules.get(s), Column) else F.lit(rules.get(s, s))).cast("int") for s in range(states)])


def composed(first: Column, second: Column) -> Column:
    """What `second` makes of the results of `first`."""
    return F.transform(first, lambda state: F.get(second, state))


def scan(
    rows: DataFrame,
    keys: Sequence[str],
    position: str,
    step: Column,
    states: int,
    start: int = 0,
    amounts: Mapping[str, Column] | None = None,
    columns: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """keys, position, `columns`, `before` and `after` (states) and the sums of `amounts` over the earlier rows.

    `position` is a non-negative integer, unique inside a group; null keys form a group. `step` is
    an array of `states` next states. `columns` are carried through chunks and should be small.
    """
    if chunk < 2:
        raise ValueError("a chunk has two rows at least")
    amounts = dict(amounts or {})
    values = [F.coalesce(expr, F.lit(0)).cast("bigint").alias(name) for name, expr in amounts.items()]
    prepared = rows.select(
        *keys,
        F.floor(F.col(position) / chunk).alias("_chunk"),
        F.struct(
            F.col(position).cast("bigint").alias("position"),
            step.cast("array<int>").alias("step"),
            *values,
            *[F.col(c).alias(f"c_{c}") for c in columns],
        ).alias("_row"),
    )
    chunks = materialize(
        prepared.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list("_row"), _by_position).alias("_rows")),
        "chunks",
    )
    starts = _chunk_starts(chunks, keys, states, start, amounts, chunk)

    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_chunk"]]
    joined = chunks.join(starts, same, "left")
    state = F.coalesce("_state", F.lit(start))
    sums = [F.coalesce(f"_sum_{name}", F.lit(0)).cast("bigint") for name in amounts]

    def walk(seen: Column, row: Column) -> Column:
        def moved(after: Column) -> Column:
            line = F.struct(
                row["position"],
                *[row[f"c_{c}"].alias(c) for c in columns],
                seen["state"].alias("before"),
                after.alias("after"),
                *[seen[name].alias(name) for name in amounts],
            )
            return F.struct(
                after.alias("state"),
                *[(seen[name] + row[name]).alias(name) for name in amounts],
                F.array_append(seen["out"], line).alias("out"),
            )

        return let(F.get(row["step"], seen["state"]), moved)

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema["_rows"].dataType.elementType.fields}
    line = [f"position:{kinds['position']}", *[f"{c}:{kinds[f'c_{c}']}" for c in columns], "before:int", "after:int"]
    line += [f"{name}:bigint" for name in amounts]
    first = F.struct(
        state.alias("state"),
        *[value.alias(name) for value, name in zip(sums, amounts)],
        F.array().cast(f"array<struct<{','.join(line)}>>").alias("out"),
    )
    walked = joined.select(*keys, F.aggregate("_rows", first, walk, lambda seen: seen["out"]).alias("_out"))
    return walked.select(*keys, F.inline("_out")).withColumnRenamed("position", position)


def _by_position(a: Column, b: Column) -> Column:
    return F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0)


def _total(name: str) -> Column:
    return F.aggregate("_rows", F.lit(0).cast("bigint"), lambda total, row: total + row[name]).alias(name)


def _chunk_starts(
    chunks: DataFrame, keys: Sequence[str], states: int, start: int, amounts: Mapping[str, Column], chunk: int
) -> DataFrame:
    """State and sums at the begin of each chunk but a group's first, by `_of_` columns of the keys and the chunk."""
    same = F.array(*[F.lit(s) for s in range(states)])
    later = chunks.where("_chunk > 0").select(*keys).distinct()
    named = later.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    # Groups of one chunk have nothing to carry.
    long = chunks.join(named, [chunks[k].eqNullSafe(named[f"_of_{k}"]) for k in keys], "left_semi")
    folded = long.select(
        *keys,
        "_chunk",
        F.aggregate("_rows", same, lambda f, row: composed(f, row["step"])).alias("_step"),
        *[_total(name) for name in amounts],
    )
    folded = materialize(folded, "chunk-steps")
    most = folded.agg(F.max("_chunk")).first()[0]
    if most is None:
        names = {k: f"_of_{k}" for k in [*keys, "_chunk"]}
        empty = folded.select(*keys, "_chunk", F.lit(None).cast("int").alias("_state"))
        empty = empty.withColumns({f"_sum_{name}": F.lit(None).cast("bigint") for name in amounts})
        return empty.withColumnsRenamed(names)
    wider = chunk if most >= chunk else most + 1
    carried = scan(
        folded, keys, "_chunk", F.col("_step"), states, start, {name: F.col(name) for name in amounts}, chunk=wider
    )
    return carried.select(
        *[F.col(k).alias(f"_of_{k}") for k in [*keys, "_chunk"]],
        F.col("before").alias("_state"),
        *[F.col(name).alias(f"_sum_{name}") for name in amounts],
    )
