"""Delimited parts of model answers and job logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import find, let, py_strip
from runlens.schemas import KEYED_PREDICTIONS

# Fixed log delimiters.
PREDS = ("<<PREDS_JSON_START_7829361>>", "<<PREDS_JSON_END_7829361>>")
PATCH = ("<<PATCH_START_7829361>>", "<<PATCH_END_7829361>>")
EVAL = ("<<EVAL_OUTPUT_START_7829361>>", "<<EVAL_OUTPUT_END_7829361>>")
TRAJECTORY = ("<<TRAJ_JSON_START_7829361>>", "<<TRAJ_JSON_END_7829361>>")


def extract_fenced_code(text: Column, opening: str = "```python", closing: str = "```") -> Column:
    """Body of the first fence; the rest when it stays open, all text without one."""

    def body(start: Column, stop: Column) -> Column:
        begin = start + len(opening)
        return (
            F.when(start == 0, text)
            .when(stop > 0, F.substr(text, begin, stop - begin))
            .otherwise(F.substr(text, begin))
        )

    return _marked(text, opening, closing, body)


def _marked(
    text: Column, opening: str, closing: str, body: Callable[[Column, Column], Column]
) -> Column:
    """`body` of the places of `opening` and of the `closing` behind it, 0 if absent."""

    def with_stop(start: Column) -> Column:
        stop = F.when(start > 0, find(text, closing, start + len(opening))).otherwise(0)
        return let(stop, lambda place: body(start, place))

    return let(find(text, opening), with_stop)


def _between(text: Column, opening: str, closing: str) -> Column:
    """Text after `opening` up to the next `closing`, null when absent or empty."""

    def body(start: Column, stop: Column) -> Column:
        begin = start + len(opening)
        return F.when(stop > begin, F.substr(text, begin, stop - begin))

    return _marked(text, opening, closing, body)


def extract_diff(response: Column) -> Column:
    """Patch in a model answer: patch tag, diff tag, diff fence, else all of it."""
    marked = [
        _between(response, opening, closing)
        for opening, closing in (
            ("<patch>", "</patch>"),
            ("<diff>", "</diff>"),
            ("```diff\n", "```"),
        )
    ]
    return F.coalesce(*marked, py_strip(response))


def extract_section(log: Column, start: str, end: str) -> Column:
    """Trimmed text from the first START to the first END of the whole log.

    Empty when a marker is missing or END comes first.
    """

    def cut(place: Column) -> Column:
        begin = place["opened"] + len(start)
        inside = (place["opened"] > 0) & (place["closed"] > begin)
        return F.when(
            inside, py_strip(F.substr(log, begin, place["closed"] - begin))
        ).otherwise(F.lit(""))

    return let(F.struct(find(log, start).alias("opened"), find(log, end).alias("closed")), cut)


def extract_keyed_prediction(
    log: Column, instance_id: Column, model_name: Column, markers: tuple[str, str] = PREDS
) -> Column:
    """struct(instance_id, model_patch, model_name_or_path) from a JSON map in a log.

    Own entry first, then the only entry there is, else an empty prediction.
    """
    entries = F.from_json(extract_section(log, *markers), KEYED_PREDICTIONS)
    own = F.try_element_at(entries, instance_id)
    only = F.when(F.size(entries) == 1, F.get(F.map_values(entries), F.lit(0)))
    has_own = F.coalesce(F.map_contains_key(entries, instance_id), F.lit(False))
    entry = F.when(has_own, F.when(own["instance_id"].isNotNull(), own)).otherwise(only)
    return F.struct(
        F.coalesce(entry["instance_id"], instance_id).alias("instance_id"),
        F.coalesce(entry["model_patch"], F.lit("")).alias("model_patch"),
        F.coalesce(entry["model_name_or_path"], model_name).alias("model_name_or_path"),
    )
