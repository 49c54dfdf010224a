"""Verifiers as table functions: any Python check, with a time limit and an error verdict per row.

    unit = verifier("unit_check", check, key="instance_id", timeout=5.0)
    unit(patches.asTable())                        # a DataFrame of verdicts
    spark.udtf.register("unit_check", unit)
    spark.sql("select * from unit_check(table(patches))")

`check` gets a row as a dict and returns a score, or a `Checked` with a status and
details. It runs in a process of its own beside the worker: a row on which it raises, dies or
does not come back in time gets its verdict and the next row a fresh process if need
be. Rows stay in the partition they are in; `partition_by` asks for all rows of a key to
meet in one task instead.

Null cells reach the check as None. An empty table gives no rows, a score outside 0 ... 1 is an error.
"""

from __future__ import annotations

import math
import multiprocessing
import sys
import time
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, UserDefinedTableFunction

# Ship the harness itself, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATUSES = ("ok", "skipped")


class Checked(NamedTuple):
    """What a check says: a score, and `skipped` where it does not apply."""

    score: float
    status: str = "ok"
    details: dict[str, str] = {}


def _verdict(check: Callable[[dict], Any], row: dict) -> tuple[str, float, dict[str, str]]:
    try:
        found = check(row)
        found = found if isinstance(found, Checked) else Checked(float(found))
        if found.status not in STATUSES:
            raise ValueError(f"unknown status '{found.status}'")
        if not 0.0 <= found.score <= 1.0 or math.isnan(found.score):
            raise ValueError(f"score {found.score} is outside 0 ... 1")
        return found.status, float(found.score), {k: str(v) for k, v in found.details.items()}
    except Exception as failure:
        return "error", 0.0, {"error": str(failure), "error_type": type(failure).__name__}


class _Runner:
    """The process that runs the check."""

    def __init__(self, check: Callable[[dict], Any]) -> None:
        self.check = check
        self.process: multiprocessing.process.BaseProcess | None = None

    def _loop(self, mine, other) -> None:
        other.close()
        while True:
            try:
                row = mine.recv()
            except EOFError:
                return
            mine.send(_verdict(self.check, row))

    def start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.line, mine = context.Pipe()
        self.process = context.Process(target=self._loop, args=(mine, self.line), daemon=True)
        self.process.start()
        mine.close()

    def stop(self) -> None:
        if self.process is not None:
            self.line.close()
            self.process.kill()
            self.process.join()
            self.process = None

    def run(self, row: dict, timeout: float) -> tuple[str, float, dict[str, str]]:
        if self.process is None:
            self.start()
        try:
            self.line.send(row)
            if self.line.poll(timeout):
                return self.line.recv()
            self.stop()
            return "timeout", 0.0, {"timeout": str(timeout)}
        except (EOFError, OSError):
            self.process.join(1.0)
            code = self.process.exitcode
            self.stop()
            return "error", 0.0, {"error": f"the check ended its process with code {code}", "error_type": "ProcessDied"}


def verifier(
    name: str,
    check: Callable[[dict], Any],
    key: str = "instance_id",
    timeout: float = 60.0,
    pass_threshold: float = 1.0,
    partition_by: tuple[str, ...] = (),
) -> UserDefinedTableFunction:
    """A table function: one verdict (key, name, status, score, pass_threshold, passed, seconds, details) per row."""
    if not 0.0 <= pass_threshold <= 1.0:
        raise ValueError(f"pass_threshold must lie in 0 ... 1, got {pass_threshold}")

    class Verifier:
        def __init__(self) -> None:
            self.runner = _Runner(check)

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or key not in table.dataType.fieldNames():
                raise ValueError(f"{name} needs a table with the column {key}")
            schema = (
                T.StructType()
                .add(key, table.dataType[key].dataType)
                .add("name", T.StringType())
                .add("status", T.StringType())
                .add("score", T.DoubleType())
                .add("pass_threshold", T.DoubleType())
                .add("passed", T.BooleanType())
                .add("seconds", T.DoubleType())
                .add("details", T.MapType(T.StringType(), T.StringType()))
            )
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(c) for c in partition_by])

        def eval(self, row) -> Iterator[tuple]:
            begin = time.monotonic()
            status, score, details = self.runner.run(row.asDict(recursive=True), timeout)
            passed = status == "ok" and score >= pass_threshold
            yield row[key], name, status, score, pass_threshold, passed, time.monotonic() - begin, details

        def terminate(self) -> Iterator[tuple]:
            self.runner.stop()
            yield from ()

    return udtf(Verifier)
