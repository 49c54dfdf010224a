import pytest
from pyspark.sql import functions as F
from runlens.operators import joins
from runlens.session import MIB
from runlens.sources import buckets


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_buckets_have_no_exchange(spark, tmp_path, no_broadcast):
    instances = spark.range(500).select(F.concat(F.lit("i"), "id").alias("instance_id"), F.col("id").alias("n"))
    prompts = instances.where("n % 3 = 0").select("instance_id", F.concat(F.lit("solve "), "n").alias("text_inputs"))
    done = instances.where("n % 4 = 0").select("instance_id", F.lit(None).cast("string").alias("error"))
    stored = []
    for name, rows in (("a", instances), ("b", prompts), ("c", done)):
        buckets.write_buckets(rows, str(tmp_path / name), 4)
        stored.append(buckets.read_buckets(spark, str(tmp_path / name), 4, rows.schema))
    cases = [
        (joins.join_prompts(*stored[:2]), joins.join_prompts(instances, prompts)),
        (joins.resume_pending(stored[0], stored[2]), joins.resume_pending(instances, done)),
        (joins.keep_listed(stored[0], stored[1]), joins.keep_listed(instances, prompts)),
        (stored[0].groupBy("instance_id").count(), instances.groupBy("instance_id").count()),
    ]
    for got, want in cases:
        assert "Exchange" not in plan_of(got) and "Exchange" in plan_of(want)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert len(list((tmp_path / "a" / "known").glob("*.parquet"))) == 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_buckets_")]


def test_null_ids_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), (None, 4)], "instance_id string, n int")
    path = str(tmp_path / "t")
    buckets.write_buckets(rows, path, 2)
    known = buckets.read_buckets(spark, path, 2, rows.schema)
    assert sorted(r.n for r in known.collect()) == [1, 3]
    assert sorted(r.n for r in buckets.with_null_ids(known, path).collect()) == [1, 2, 3, 4]
    buckets.write_buckets(rows.where("false"), str(tmp_path / "e"), 2)
    assert buckets.read_buckets(spark, str(tmp_path / "e"), 2, rows.schema).collect() == []


def test_counts_divide_each_other():
    counts = [buckets.bucket_count(n * MIB) for n in (0, 1, 256, 257, 5000, 10**8)]
    assert counts[:4] == [1, 1, 1, 2] and all(n & (n - 1) == 0 for n in counts)
