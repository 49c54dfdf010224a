import pytest
from pyspark.sql import functions as F
from runlens.operators import bloom


def test_filter_holds_all_ids_and_few_others(spark):
    ids = spark.range(5000).select(F.concat(F.lit("i"), "id").alias("k"))
    size = bloom.filter_words(5000)
    held = bloom.may_hold(bloom.bloom_filter(ids, "k", size), size, "k")
    assert ids.where(held).count() == 5000
    others = spark.range(20000).select(F.concat(F.lit("new"), "id").alias("k"))
    assert others.where(held).count() < 20000 / 60
    assert spark.createDataFrame([(None,)], "k string").where(held).count() == 0


@pytest.mark.parametrize("most", [bloom.MOST_WORDS, 1])
def test_anti_join(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "MOST_WORDS", most)
    rows = spark.createDataFrame([(f"i{k % 300}", k) for k in range(900)] + [(None, -1)], "instance_id string, n int")
    done = spark.createDataFrame([(f"i{k}",) for k in range(0, 600, 2)] + [(None,), ("i4",)], "instance_id string")
    got = sorted(r["n"] for r in bloom.without(rows, done).collect())
    assert got == [-1] + [k for k in range(900) if (k % 300) % 2]
    assert bloom.without(rows, done.where("false")).count() == 901
    assert bloom.without(rows.where("false"), done).count() == 0


def test_sizes():
    assert bloom.filter_words(0) == 1
    assert all(bloom.filter_words(n) * 64 >= n * bloom.BITS_PER_ID for n in (1, 7, 100, 6400, 10**6))
    assert bloom.filter_words(10**9) > bloom.MOST_WORDS


def test_new_rows_are_not_shuffled(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("instance_id"))
    plan = bloom.without(rows, rows.where("id < 3"))._jdf.queryExecution().executedPlan().toString()
    nodes = [line.lstrip(" :+-") for line in plan.splitlines()]
    start = next(i for i, node in enumerate(nodes) if node.startswith("Union"))
    end = next(i for i, node in enumerate(nodes) if "LeftAnti" in node)
    branch = [node.split()[0] for node in nodes[start + 1 : end]]
    # The filter stands right on the scan; the exchanges below are those of its subquery.
    assert branch[:2] == ["Project", "Filter"] and branch[branch.index("Range") - 1] != "Exchange"
