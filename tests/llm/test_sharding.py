import random
import zlib
from collections import defaultdict

import llm_rows
from runlens.llm import sharding


def check(rows, got, shards, slack):
    want = sorted([(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows], key=repr)
    assert sorted([(r["id"], r["size"], r["crc"]) for r in got], key=repr) == want
    slots, sums = defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sums.values()) / shards
    assert max(abs(s - mean) for s in sums.values()) <= slack
    return sums


def test_odd_rows(spark):
    rows = llm_rows.odd_rows()
    largest = max(len((r[1] or "").encode()) + 8 for r in rows)
    for shards in (1, 2, 5):
        check(rows, sharding.shard(llm_rows.odd_documents(spark), shards=shards).collect(), shards, largest)


def test_empty_table(spark):
    assert sharding.shard(llm_rows.no_documents(spark)).collect() == []
    assert sharding.shard(llm_rows.no_documents(spark), target_bytes=100).collect() == []


def test_bytes_are_near_equal_and_small_groups_stay_together(spark):
    rng = random.Random(9)
    rows = [(i, llm_rows.prose(i % 2900, 5 + rng.randrange(60) ** 2 // 30 if i < 2900 else 5)) for i in range(3000)]
    texts = {i: t for i, t in rows[:2900]}
    rows = [(i, t if i < 2900 else texts[i - 2900]) for i, t in rows]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    total = sum(r["size"] for r in got)
    check(rows, got, 24, 0.03 * total / 24)
    where = defaultdict(set)
    for r in got:
        where[dict(rows)[r["id"]]].add(r["shard"])
    assert sum(len(w) > 1 for w in where.values()) == 0


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text number {i}") for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check(rows, got, 8, 0.02 * sum(r["size"] for r in got) / 8)


def test_target_bytes_set_the_number_of_shards(spark):
    rows = [(i, "x" * 92) for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), target_bytes=2500).collect()
    assert {r["shard"] for r in got} == {0, 1, 2, 3}


def test_no_python_in_the_plan(spark):
    plan = sharding.shard(llm_rows.odd_documents(spark), shards=3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
