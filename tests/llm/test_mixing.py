import hashlib
import math
import random
import time
from collections import Counter

import llm_rows
from runlens.llm import mixing


def copies(rate, name, seed="42"):
    u = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:13], 16)
    if rate <= 0:
        return 0
    total = n = 0
    while True:
        total += math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1))
        if u < math.floor(total * 2**52):
            return n
        n += 1


def name(row):
    return str(row[0]) if row[0] is not None else hashlib.md5((row[1] or "").encode()).hexdigest()


def test_odd_rows_are_drawn_as_by_brute_force(spark):
    rows = llm_rows.odd_rows()
    bytes_of = Counter()
    for r in rows:
        bytes_of[r[3]] += len((r[1] or "").encode())
    total, weights = sum(bytes_of.values()), {s: b**0.5 for s, b in bytes_of.items()}
    rates = {s: weights[s] / sum(weights.values()) * total / bytes_of[s] for s in bytes_of}
    want = Counter()
    for r in rows:
        want[(r[0], r[3])] += copies(rates[r[3]], name(r))
    got = mixing.positions(llm_rows.odd_documents(spark)).collect()
    assert Counter((r["id"], r["source"]) for r in got) == +want
    assert sorted(r["position"] for r in got) == list(range(len(got)))


def test_rows_keep_their_columns(spark):
    docs = llm_rows.odd_documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}


def test_empty_table_and_empty_texts(spark):
    assert mixing.positions(llm_rows.no_documents(spark)).collect() == []
    rows = [(i, None, "s") for i in range(300)]
    n = mixing.positions(spark.createDataFrame(rows, "doc_id long, text string, source string")).count()
    assert n == sum(copies(1.0, i) for i in range(300))


def test_weights_set_the_shares(spark):
    rows = [(i, "x" * 100, "abc"[min(2, i % 10)]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = Counter(r["source"] for r in mixing.positions(docs, weights={"a": 3, "b": 1, "none": 5}).collect())
    assert "c" not in got
    assert abs(got["a"] / sum(got.values()) - 0.75) < 0.03 and abs(sum(got.values()) / 6000 - 1) < 0.05


def test_large_rates_do_not_underflow(spark):
    rows = [(i, "x" * (1 if i < 20 else 2000), "small" if i < 20 else "big") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = 40020 / 2 / 20
    got = Counter(r["id"] for r in mixing.positions(docs, weights={"small": 1, "big": 1}).collect() if r["source"] == "small")
    assert got == {i: copies(rate, i) for i in range(20)}


def test_many_sources_take_the_shuffled_join(spark, monkeypatch):
    docs = llm_rows.odd_documents(spark)
    want = sorted(mixing.positions(docs).collect(), key=repr)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(mixing.positions(docs).collect(), key=repr) == want


def test_windows_against_plain_sums():
    rng = random.Random(7)
    for rate in (401.0, 733.3, 5000.5):
        sums, total = [], 0.0
        for k in range(int(rate + 14 * rate**0.5 + 40)):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            sums.append(total)
        for draw in [0, 2**52 - 1, *(rng.randrange(2**52) for _ in range(300))]:
            got = mixing.inverse(rate, draw)
            near = (draw + 0.5) / 2**52
            # Equal but for draws nearer to a step than the sums are exact.
            assert (got == 0 or sums[got - 1] <= near + 1e-11) and (sums[min(got, len(sums) - 1)] >= near - 1e-11)


def test_very_large_rates_take_seconds():
    start = time.time()
    for rate in (1e7, 1e9, 1e12):
        drawn = [mixing.inverse(rate, (2**52 // 1000) * i) for i in range(1, 1000)]
        mean = sum(drawn) / len(drawn)
        assert drawn == sorted(drawn) and abs(mean - rate) < 0.1 * rate**0.5
        assert abs(mixing.inverse(rate, 2**51) - rate) < 2 + 1e-4 * rate**0.5
    assert time.time() - start < 30


def test_copies_of_one_document_are_made_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 50)
    rows = [(1, "x", "small"), (2, "y" * 5000, "big"), (3, "z", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.positions(docs, weights={"small": 1, "big": 1}).collect()
    want = copies(2501.0, 1)
    assert sorted(r["copy"] for r in got if r["id"] == 1) == list(range(1, want + 1))
    assert sorted(r["position"] for r in got) == list(range(len(got)))
