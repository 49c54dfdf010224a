import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from runlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "runlens-tests",
        master="local[4]",
        extra={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column builder on each of the given argument tuples."""

    def run(build, rows, schema):
        from pyspark.sql import functions as F

        names = [part.split()[0] for part in schema.split(", ")]
        data = [(i, *row) for i, row in enumerate(rows)]
        df = spark.createDataFrame(data, f"_i int, {schema}")
        out = df.select("_i", build(*[F.col(n) for n in names]).alias("out")).collect()
        return [r["out"] for r in sorted(out, key=lambda r: r["_i"])]

    return run
