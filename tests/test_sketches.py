import random
from pathlib import Path

from pyspark.sql import functions as F
from runlens.operators import quantiles, sketches

PERCENTS = (10, 25, 50, 75, 90)


def days(spark, rows):
    return sketches.daily_sketches(spark.createDataFrame(rows, "at string, g string, x double"), F.col("at"), ["g"], "x")


def test_merged_days_against_exact_figures(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"2024-01-{rng.randint(1, 28):02d}", "a" if rng.random() < 0.8 else "b", rng.gauss(0, 100)) for _ in range(30_000)]
    rows += [("2024-01-03", "a", 7.0)] * 9000 + [("2024-01-03", "a", None), ("2024-01-03", "c", None), ("2024-01-04", "b", float("nan"))]
    path = str(tmp_path / "s")
    sketches.store_days(days(spark, rows), path)
    stored = sketches.read_days(spark, path)
    assert stored.count() == 56
    found = sketches.merged_distribution(stored, ["g"])
    df = spark.createDataFrame(rows, "at string, g string, x double").where("x is not null and not isnan(x)")
    exact = {r["g"]: r for r in quantiles.distribution_stats(df, ["g"], "x").collect()}
    for r in found.collect():
        e = exact[r["g"]]
        assert (r["n"], r["min"], r["max"]) == (e["n"], e["min"], e["max"]) and abs(r["mean"] - e["mean"]) < 1e-9
    gaps = sketches.rank_gaps(df, found, ["g"], "x", PERCENTS).collect()
    assert len(gaps) == 10 and max(r["gap"] for r in gaps) < 3 * sketches.rank_error()


def test_a_new_or_repeated_day_writes_itself_only(spark, tmp_path):
    path = tmp_path / "s"
    sketches.store_days(days(spark, [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 2.0)]), str(path))

    def files():
        return {d.name: sorted((f.name, f.stat().st_mtime_ns) for f in d.glob("*.parquet")) for d in Path(path).glob("day=*")}

    before = files()
    sketches.store_days(days(spark, [("2024-01-02", "a", 5.0), ("2024-01-03", "a", 9.0)]), str(path))
    after = files()
    assert after["day=2024-01-01"] == before["day=2024-01-01"] and after["day=2024-01-02"] != before["day=2024-01-02"]
    row = sketches.merged_distribution(sketches.read_days(spark, str(path)), ["g"]).first()
    assert (row["n"], row["min"], row["max"], row["mean"], row["p50"]) == (3, 1.0, 9.0, 5.0, 5.0)


def test_no_rows(spark):
    assert sketches.merged_distribution(days(spark, []), ["g"]).collect() == []
